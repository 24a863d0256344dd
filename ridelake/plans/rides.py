"""Queries on rides at a moment: states, gauges, positions, files, full matching costs, rides without a way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake import tables
from ridelake.functions import exposition, geo, histograms, times
from ridelake.functions.exact import r3
from ridelake.operators import matching, rides, roads
from ridelake.plans import marketplace, travel_times
from ridelake.plans.marketplace import NOW
from ridelake.plans.reports import r
from ridelake.storage import kept
from ridelake.tables import with_tables

SQL: dict[str, str] = {}


def ride_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rides.state_counts(tables.trips(spark, sf_dir), NOW, ["scenario", "policy"])


_MOMENTS = ["request_ts_unix_ms", "match_ts_unix_ms", "pickup_ts_unix_ms", "dropoff_ts_unix_ms"]
_BETWEEN = "".join(f"count(*) FILTER ({a} <= {NOW} AND {b} > {NOW}) AS {s}, " for s, a, b in zip(rides.STATES, _MOMENTS, _MOMENTS[1:], strict=False))
_BETWEEN += f"count(*) FILTER ({_MOMENTS[3]} <= {NOW}) AS completed"
SQL["ride_states"] = with_tables(f"SELECT scenario, policy, {_BETWEEN} FROM trips WHERE request_ts_unix_ms <= {NOW} GROUP BY scenario, policy", "trips")


def ride_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rides.losses(tables.trip_events(spark, sf_dir), ["scenario", "policy"])


SQL["ride_losses"] = with_tables(
    """SELECT scenario, policy, count(*) FILTER (topic = 'offer.declined') AS declined, count(*) FILTER (topic = 'trip.cancelled') AS cancelled,
    count(*) FILTER (topic = 'trip.requested') AS requested FROM trip_events GROUP BY scenario, policy""",
    "trip_events",
)


def surge_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiplier at every trip's pickup; 1 in cells without one."""
    raised = marketplace._surge(spark, sf_dir).where("surge > 1.0001")
    return rides.with_surge(marketplace._pickups(spark, sf_dir), raised).select("ride_id", "cell", r3("surge").alias("surge"))


SQL["surge_lookup"] = with_tables(
    f"""+ {marketplace._SURGE} SELECT ride_id, cell, {r('coalesce(surge, 1.0)')} AS surge FROM pickups
    LEFT JOIN (SELECT cell, surge FROM surge WHERE surge > 1.0001) USING (cell)""",
    "trips", "grid_nodes", "pings",
)


def fleet_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet's gauges as lines of text."""
    t = tables.trips(spark, sf_dir)
    asked, state = F.col("request_ts_unix_ms") <= NOW, rides.state_at(NOW)
    by_rides = t.agg(
        F.count(F.when(state.isin("assigned", "aboard"), 1)).alias("active_trips"),
        F.count(F.when(state == "pending", 1)).alias("pending_requests"),
        F.count(F.when(asked & (F.col("wait_time_s") > 300), 1)).alias("abandoned_requests"),
    )
    by_cells = marketplace.surge_fraction(spark, sf_dir).select("idle_drivers", "surge_fraction")
    return exposition.gauge_lines(by_cells.crossJoin(by_rides), "fleet")  # one row each


SQL["fleet_gauges"] = with_tables(
    f"""+ {marketplace._SURGE}, g AS (SELECT (SELECT sum(drivers)::BIGINT FROM surge) AS idle, (SELECT {r('coalesce(avg((surge > 1.05)::INT), 0)')} FROM surge) AS f,
        count(*) FILTER (match_ts_unix_ms <= {NOW} AND dropoff_ts_unix_ms > {NOW}) AS active,
        count(*) FILTER (request_ts_unix_ms <= {NOW} AND match_ts_unix_ms > {NOW}) AS pending,
        count(*) FILTER (request_ts_unix_ms <= {NOW} AND wait_time_s > 300) AS gone FROM trips)
    SELECT unnest(['fleet_idle_drivers ' || idle, 'fleet_surge_fraction ' || printf('%.3f', f), 'fleet_active_trips ' || active,
      'fleet_pending_requests ' || pending, 'fleet_abandoned_requests ' || gone]) AS line FROM g""",
    "trips", "grid_nodes", "pings",
)


def hist_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of waits as lines of text."""
    made = histograms.buckets(tables.trips(spark, sf_dir), ["scenario", "policy"], "wait_time_s", histograms.WAIT)
    return exposition.histogram_lines(made, "pickup_wait_seconds", ["scenario", "policy"])


_OF = """'{scenario="' || scenario || '",policy="' || policy || '"'"""
SQL["hist_text"] = with_tables(
    f"""+ b AS (SELECT scenario, policy, le, sum(CASE WHEN wait_time_s <= le THEN 1 ELSE 0 END)::BIGINT AS c
        FROM trips CROSS JOIN (VALUES {', '.join(f"({x}::DOUBLE)" for x in histograms.WAIT)}, ('inf'::DOUBLE)) v(le) GROUP BY ALL)
    SELECT 'pickup_wait_seconds_bucket' || {_OF} || ',le="' || CASE WHEN isinf(le) THEN '+Inf' ELSE le::BIGINT::VARCHAR END || '"}} ' || c AS line FROM b
    UNION ALL SELECT 'pickup_wait_seconds_sum' || {_OF} || '}} ' || printf('%.3f', {r('sum(wait_time_s::DECIMAL(18, 3))::DOUBLE')}) FROM trips GROUP BY scenario, policy
    UNION ALL SELECT 'pickup_wait_seconds_count' || {_OF} || '}} ' || count(*) FROM trips GROUP BY scenario, policy""",
    "trips",
)


def vehicle_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the vehicles with a rider aboard are now, on the straight line that their ride follows."""
    t = travel_times.with_coords(tables.trips(spark, sf_dir).where(rides.state_at(NOW) == "aboard"), tables.grid_nodes(spark))
    done = (NOW - F.col("pickup_ts_unix_ms")) / (F.col("dropoff_ts_unix_ms") - F.col("pickup_ts_unix_ms"))
    lat, lon = geo.along("pickup_lat", "pickup_lon", "dropoff_lat", "dropoff_lon", done)
    return t.select("ride_id", r3(lat).alias("lat"), r3(lon).alias("lon"))


_DONE = f"({NOW} - pickup_ts_unix_ms)::DOUBLE / (dropoff_ts_unix_ms - pickup_ts_unix_ms)::DOUBLE"
SQL["vehicle_positions"] = with_tables(
    f"""+ {travel_times._COORDS} SELECT ride_id, {r(f'pickup_lat + (dropoff_lat - pickup_lat) * ({_DONE})')} AS lat,
    {r(f'pickup_lon + (dropoff_lon - pickup_lon) * ({_DONE})')} AS lon FROM c WHERE pickup_ts_unix_ms <= {NOW} AND dropoff_ts_unix_ms > {NOW}""",
    "trips", "grid_nodes",
)


def trip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour files that trips go to, and when each one's first and last rides were asked for."""
    t = tables.trips(spark, sf_dir).groupBy(times.hour("dropoff_ts_unix_ms").alias("hour"))
    t = t.agg(F.count("*").alias("trips"), F.min("request_ts_unix_ms").alias("a"), F.max("request_ts_unix_ms").alias("b"))
    return t.select(F.concat(F.lit("trips_"), "hour").alias("file"), "trips", times.rfc3339("a").alias("first_request"), times.rfc3339("b").alias("last_request"))


_AT = "strftime(make_timestamp({} * 1000), '{}')"
SQL["trip_files"] = with_tables(
    f"""SELECT 'trips_' || h AS file, count(*) AS trips, {_AT.format('min(request_ts_unix_ms)', '%Y-%m-%dT%H:%M:%SZ')} AS first_request,
    {_AT.format('max(request_ts_unix_ms)', '%Y-%m-%dT%H:%M:%SZ')} AS last_request
    FROM (SELECT *, {_AT.format('dropoff_ts_unix_ms', '%Y-%m-%dT%H')} AS h FROM trips) GROUP BY h""",
    "trips",
)

PREMIUM, ETA_WEIGHT = 15.0, 0.1


def match_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full cost of every candidate pair: seconds to the pickup, less a premium for surge, and a share of the predicted trip."""
    near = marketplace._candidates(spark, sf_dir)[1]
    trips = travel_times._features(spark, sf_dir).select(F.col("ride_id").alias("request_id"), "surge", travel_times.STAMP.predict().alias("trip_s"))
    made = matching.cost_matrix(near.join(trips, "request_id"), PREMIUM, F.col("surge"), F.col("trip_s"), ETA_WEIGHT)
    return made.select("request_id", "driver_id", r3("cost").alias("cost_s"))


SQL["match_cost"] = with_tables(
    f"""+ {marketplace._NEAR}, {travel_times._FEATURES}
    SELECT t.ride_id AS request_id, driver_id,
      {r(f'dist / 11.0::DOUBLE - {PREMIUM}::DOUBLE * (surge - 1) + {ETA_WEIGHT}::DOUBLE * {travel_times._PREDICT}')} AS cost_s
    FROM (SELECT ride_id, pickup_node FROM trips) t JOIN (SELECT node_id, driver_id, dist_m AS dist FROM near) n ON n.node_id = t.pickup_node
    JOIN f ON f.ride_id = t.ride_id""",
    "trips", "grid_nodes", "pings",
)


def unroutable_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips that one-way streets leave without a way from pickup to dropoff."""
    streets = kept(tables.one_way(tables.street_edges(spark, sf_dir)))
    n = 2 * tables.read(spark, sf_dir, "part").count()
    t = tables.trips(spark, sf_dir).select("ride_id", (F.col("ride_id") * 31 % n).alias("from_node"), (F.col("ride_id") * 31 % n + F.col("pickup_node") % 7).alias("to_node"))
    cut = roads.unroutable(t, tables.street_nodes(spark, sf_dir), streets)
    return t.join(cut, ["from_node", "to_node"], "left_semi").select("ride_id")


SQL["unroutable_trips"] = with_tables(
    """+ reach AS (SELECT node_id AS a, node_id AS b FROM street_nodes UNION SELECT r.a, e.b FROM reach r JOIN oneway_edges e ON e.a = r.b),
      t AS (SELECT ride_id, ride_id * 31 % n AS x, ride_id * 31 % n + pickup_node % 7 AS y FROM trips, (SELECT count(*) AS n FROM street_nodes))
    SELECT ride_id FROM t WHERE x <> y AND NOT EXISTS (SELECT 1 FROM reach WHERE a = x AND b = y)""",
    "trips", "street_nodes", "oneway_edges",
).replace("WITH ", "WITH RECURSIVE ", 1)


def reposition_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idle cars of each fleet that are sent to a cell with a larger gap, one after the other."""
    t = F.col("request_ts_unix_ms")
    recent = marketplace._pickups(spark, sf_dir).where((t <= NOW) & (t >= NOW - 15 * 60_000)).select(F.col("scenario").alias("fleet"), "cell")
    cars = marketplace.latest_pings(tables.pings(spark, sf_dir)).where(F.col("state").isin("idle", "repositioning"))
    fleet = F.concat(F.lit("scn_"), (F.col("driver_id") % 3).cast("string"))
    placed = cars.select(fleet.alias("fleet"), "driver_id", geo.cell("lat", "lon", geo.SURGE_M).alias("cell"), (F.col("state") == "idle").alias("ready"))
    return matching.reposition_moves(recent, placed, rings=3)


QUERIES = [
    ride_states, ride_losses, surge_lookup, fleet_gauges, hist_text, vehicle_positions, trip_files, match_cost, unroutable_trips, reposition_moves,
]
