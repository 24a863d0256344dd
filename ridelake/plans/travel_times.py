"""Trip rows with cells, features of travel times, and the model fitted on them."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake import tables
from ridelake.functions import geo
from ridelake.functions.exact import r3
from ridelake.operators import eta
from ridelake.plans.reports import r
from ridelake.tables import with_tables

SQL: dict[str, str] = {}

#: A model of the kind that ``fit`` makes, for the query that stamps predictions.
STAMP = eta.Model(eta.FEATURES, [3000.0, 1.75, 0.1, -0.2], [1500.0, 0.56, 0.7, 0.7], [660.0, 120.5, 14.25, -3.5, 2.75])


MIDDLES = ["pickup_mid_lat", "pickup_mid_lon", "dropoff_mid_lat", "dropoff_mid_lon"]


def with_coords(trips: DataFrame, nodes: DataFrame) -> DataFrame:
    """Trips with the columns of their pickup's and their dropoff's node; the road graph's nodes are joined twice."""
    end = lambda side: nodes.select(*[F.col(c).alias(f"{side}_{c.removesuffix('_id')}") for c in nodes.columns])
    return trips.join(end("pickup"), "pickup_node").join(end("dropoff"), "dropoff_node")


def with_cells(nodes: DataFrame) -> DataFrame:
    """Nodes (node_id, lat, lon) with their cell and its centre, so these are found once for each node and not for each trip."""
    q, r_ = geo.axial("lat", "lon", geo.TRIP_M)
    placed = nodes.select("*", q.alias("q"), r_.alias("r"))
    cell, middle = geo.named("q", "r", geo.TRIP_M), geo.middle("q", "r", geo.TRIP_M)
    return placed.select("node_id", "lat", "lon", cell.alias("cell"), middle[0].alias("mid_lat"), middle[1].alias("mid_lon"))


def derived(trips: DataFrame, nodes: DataFrame) -> DataFrame:
    """The trip rows that are kept: waits, durations, cells; empty labels replaced. Beside them the centres of the cells."""
    t = with_coords(trips, with_cells(nodes))
    return t.select(
        "ride_id",
        F.coalesce(F.nullif("scenario", F.lit("")), F.lit("unknown")).alias("scenario"),
        F.coalesce(F.nullif("policy", F.lit("")), F.lit("unknown")).alias("policy"),
        F.coalesce(F.nullif("seed", F.lit(0)), F.lit(42)).alias("seed"),
        "match_ts_unix_ms",
        "pickup_cell",
        "dropoff_cell",
        (1 + (F.col("ride_id") % 4).cast("double") / 2).alias("surge"),
        ((F.col("pickup_ts_unix_ms") - F.col("request_ts_unix_ms")).cast("double") / 1000).alias("wait_time_s"),
        ((F.col("dropoff_ts_unix_ms") - F.col("pickup_ts_unix_ms")).cast("double") / 1000).alias("trip_duration_s"),
        *MIDDLES,
    )


def _trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(tables.trips(spark, sf_dir), tables.grid_nodes(spark))


def with_distance(t: DataFrame) -> DataFrame:
    """Metres between the centres of the pickup's and the dropoff's cell, by the centres that ``derived`` gives or, in stored
    rows, by the cells' names."""
    if not set(MIDDLES) <= set(t.columns):
        (a, b), (c, d) = geo.centre(F.col("pickup_cell")), geo.centre(F.col("dropoff_cell"))
        return t.withColumn("dist_m", geo.haversine(a, b, c, d))
    return t.withColumn("dist_m", geo.haversine(*MIDDLES)).drop(*MIDDLES)


def trips_with_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = with_coords(tables.trips(spark, sf_dir), tables.grid_nodes(spark))
    return t.select("ride_id", *[r3(c).alias(c) for c in ("pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon")])


_COORDS = """c AS (SELECT t.*, p.lat AS pickup_lat, p.lon AS pickup_lon, d.lat AS dropoff_lat, d.lon AS dropoff_lon
      FROM trips t JOIN grid_nodes p ON p.node_id = t.pickup_node JOIN grid_nodes d ON d.node_id = t.dropoff_node)"""
SQL["trips_with_coords"] = with_tables(
    f"+ {_COORDS} SELECT ride_id, {', '.join(f'{r(x)} AS {x}' for x in ('pickup_lat', 'pickup_lon', 'dropoff_lat', 'dropoff_lon'))} FROM c",
    "trips", "grid_nodes",
)


def trip_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trips(spark, sf_dir).drop(*MIDDLES).withColumns({c: r3(c) for c in ("wait_time_s", "trip_duration_s")})


_DERIVED = f"""{_COORDS}, t AS (SELECT ride_id, scenario, policy, seed, match_ts_unix_ms,
        {geo.cell_sql('pickup_lat', 'pickup_lon', geo.TRIP_M)} AS pickup_cell, {geo.cell_sql('dropoff_lat', 'dropoff_lon', geo.TRIP_M)} AS dropoff_cell,
        1 + (ride_id % 4)::DOUBLE / 2 AS surge, (pickup_ts_unix_ms - request_ts_unix_ms)::DOUBLE / 1000 AS wait_time_s,
        (dropoff_ts_unix_ms - pickup_ts_unix_ms)::DOUBLE / 1000 AS trip_duration_s FROM c)"""
SQL["trip_derive"] = with_tables(
    f"""+ {_DERIVED} SELECT ride_id, scenario, policy, seed, match_ts_unix_ms, pickup_cell, dropoff_cell, surge, {r('wait_time_s')} AS wait_time_s,
    {r('trip_duration_s')} AS trip_duration_s FROM t""",
    "trips", "grid_nodes",
)


def _lat(c: str) -> str:
    return f"({geo.TRIP_M} * 1.5 * split_part({c}, ':', 3)::DOUBLE / {geo.LAT_M} + {geo.CENTRE[0]})"


def _lon(c: str) -> str:
    x = f"({geo.TRIP_M} * ({sqrt(3)!r}::DOUBLE * split_part({c}, ':', 2)::DOUBLE + {sqrt(3) / 2!r}::DOUBLE * split_part({c}, ':', 3)::DOUBLE))"
    return f"({x} / {geo.LON_M} + ({geo.CENTRE[1]}))"


_FEATURES = f"""{_DERIVED}, g AS (SELECT *, {_lat('pickup_cell')} AS a, {_lon('pickup_cell')} AS b, {_lat('dropoff_cell')} AS c, {_lon('dropoff_cell')} AS d FROM t),
      h AS (SELECT *, pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2) AS x,
                   ((match_ts_unix_ms // 3600000) % 24) * {2 * pi / 24!r}::DOUBLE AS angle FROM g),
      f AS (SELECT ride_id, 2 * 6371000.0 * atan2(sqrt(x), sqrt(1 - x)) AS dist_m, surge, sin(angle) AS hour_sin, cos(angle) AS hour_cos, trip_duration_s
            FROM h WHERE trip_duration_s > 0)"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eta.features(with_distance(_trips(spark, sf_dir)))


def eta_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    return f.select("ride_id", *[r3(c).alias(c) for c in (*eta.FEATURES, "trip_duration_s")])


SQL["eta_features"] = with_tables(
    f"+ {_FEATURES} SELECT ride_id, {', '.join(f'{r(x)} AS {x}' for x in (*eta.FEATURES, 'trip_duration_s'))} FROM f", "trips", "grid_nodes"
)


def eta_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = eta.moments(_features(spark, sf_dir))
    return m.select("n", *[r3(c).alias(c) for c in m.columns if c != "n"])


SQL["eta_moments"] = with_tables(
    f"""+ {_FEATURES} SELECT count(*) AS n, {', '.join(f'{r(f"avg({x})")} AS mean_{x}, {r(f"stddev_pop({x})")} AS std_{x}' for x in eta.FEATURES)} FROM f""",
    "trips", "grid_nodes",
)


def eta_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted weights, one row for each feature and the intercept."""
    model = eta.fit(_features(spark, sf_dir))
    rows = [("intercept", 0.0, 1.0, model.weights[0])]
    rows += list(zip(model.feature_names, model.mean, model.std, model.weights[1:], strict=True))
    made = spark.createDataFrame([(n, float(m), float(s), float(w)) for n, m, s, w in rows], "feature string, mean double, std double, weight double")
    return made.select("feature", *[r3(c).alias(c) for c in ("mean", "std", "weight")])


def eta_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a given model predicts the trips' durations."""
    q = eta.quality(_features(spark, sf_dir), STAMP)
    return q.select("n", r3("rmse").alias("rmse_s"), r3("r2").alias("r2"))


_PREDICT = "greatest(0.0, " + f"{STAMP.weights[0]}::DOUBLE" + "".join(
    f" + {w}::DOUBLE * ({n} - ({m}::DOUBLE)) / {s}::DOUBLE" for n, m, s, w in zip(STAMP.feature_names, STAMP.mean, STAMP.std, STAMP.weights[1:], strict=True)
) + ")"
SQL["eta_quality"] = with_tables(
    f"""+ {_FEATURES}, e AS (SELECT trip_duration_s AS y, trip_duration_s - {_PREDICT} AS e FROM f)
    SELECT count(*) AS n, {r('sqrt(sum(e * e) / count(*))')} AS rmse_s, {r('1 - sum(e * e) / (var_pop(y) * count(*))')} AS r2 FROM e""",
    "trips", "grid_nodes",
)


def eta_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted duration that each trip is stamped with when matched."""
    return _features(spark, sf_dir).select("ride_id", r3(STAMP.predict()).alias("eta_predicted_s"), r3("trip_duration_s").alias("eta_actual_s"))


SQL["eta_stamp"] = with_tables(
    f"+ {_FEATURES} SELECT ride_id, {r(_PREDICT)} AS eta_predicted_s, {r('trip_duration_s')} AS eta_actual_s FROM f", "trips", "grid_nodes"
)

QUERIES = [trips_with_coords, trip_derive, eta_features, eta_moments, eta_fit, eta_quality, eta_stamp]
