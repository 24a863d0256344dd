"""Queries on the marketplace: drivers and demand by cell, surge, candidates, matching, repositioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake import tables
from ridelake.functions import geo, market
from ridelake.functions.exact import r3
from ridelake.operators import matching, nested, ordered
from ridelake.plans.reports import r
from ridelake.storage import kept
from ridelake.tables import with_tables

SQL: dict[str, str] = {}

#: The moment at which the queries on the state of the market look at it.
NOW = 1_700_001_800_000
WINDOW_MS = 3000


def latest_pings(pings: DataFrame) -> DataFrame:
    """The last known position and state of every driver."""
    last = F.max(F.struct("event_id", "ts_ms", "lat", "lon", "state")).alias("last")
    return pings.groupBy("driver_id").agg(last).select("driver_id", "last.*")


_LAST = "last AS (SELECT * FROM pings QUALIFY row_number() OVER (PARTITION BY driver_id ORDER BY event_id DESC) = 1)"


def driver_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = latest_pings(tables.pings(spark, sf_dir))
    return p.select("driver_id", "event_id", r3("lat").alias("lat"), r3("lon").alias("lon"), "state")


SQL["driver_last"] = with_tables(f"+ {_LAST} SELECT driver_id, event_id, {r('lat')} AS lat, {r('lon')} AS lon, state FROM last", "pings")


def _active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides that are matched and not dropped off now; a ride's driver is drawn from its identifier."""
    t = tables.trips(spark, sf_dir).where((F.col("match_ts_unix_ms") <= NOW) & (F.col("dropoff_ts_unix_ms") > NOW))
    return t.select("ride_id", ((F.col("ride_id") * 17) % 1009).alias("driver_id"))


_ACTIVE = f"active AS (SELECT (ride_id * 17) % 1009 AS driver_id FROM trips WHERE match_ts_unix_ms <= {NOW} AND dropoff_ts_unix_ms > {NOW})"


def available_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.available(latest_pings(tables.pings(spark, sf_dir)), _active(spark, sf_dir))
    return found.select("driver_id", "state", geo.cell("lat", "lon", geo.TRIP_M).alias("cell"))


SQL["available_drivers"] = with_tables(
    f"""+ {_LAST}, {_ACTIVE} SELECT driver_id, state, {geo.cell_sql('lat', 'lon', geo.TRIP_M)} AS cell FROM last
    WHERE state IN ('idle', 'repositioning') AND driver_id NOT IN (SELECT driver_id FROM active)""",
    "pings", "trips",
)


def pending_after_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose rider has not been matched since."""
    e = tables.trip_events(spark, sf_dir)
    asked = e.where(F.col("topic") == "trip.requested").select("event_id", "rider_id")
    matched = e.where(F.col("topic") == "trip.matched").groupBy("rider_id").agg(F.max("event_id").alias("matched"))
    return asked.join(matched, (asked.rider_id == matched.rider_id) & (F.col("matched") > F.col("event_id")), "left_anti")


SQL["pending_after_match"] = with_tables(
    """SELECT event_id, rider_id FROM trip_events a WHERE topic = 'trip.requested'
    AND NOT EXISTS (SELECT 1 FROM trip_events b WHERE b.topic = 'trip.matched' AND b.rider_id = a.rider_id AND b.event_id > a.event_id)""",
    "trip_events",
)


def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tables.points(spark, sf_dir).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return p.groupBy(geo.cell("lat", "lon", geo.SURGE_M).alias("cell")).agg(F.count("*").alias("points"))


SQL["cell_counts"] = with_tables(
    f"SELECT cell, count(*) AS points FROM (SELECT {geo.cell_sql('lat', 'lon', geo.SURGE_M)} AS cell FROM points) GROUP BY cell", "points"
)


#: Levels above the finest cells: the fourth has regions of about the size of ``geo.REGION_M``.
LEVELS_UP = 4


def cell_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by nested cells of every level, counted once in the finest."""
    p = tables.points(spark, sf_dir).where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    finest = p.groupBy(nested.cell("lat", "lon").alias("cell")).agg(F.count("*").alias("points"))
    return nested.rolled_up(finest, "cell", "points", LEVELS_UP)


_T = "(((3 * q + r) % 7) + 7) % 7"
_UQ, _UR = (f"CASE {_T} " + " ".join(f"WHEN {i} THEN {s[k]}" for i, s in enumerate(nested.STEPS)) + " END" for k in (0, 1))
SQL["cell_rollup"] = with_tables(
    f"""+ named AS (SELECT {geo.cell_sql('lat', 'lon', geo.TRIP_M)} AS c FROM points),
      climb AS (SELECT 0 AS level, split_part(c, ':', 2)::BIGINT AS q, split_part(c, ':', 3)::BIGINT AS r, count(*) AS n, 1::BIGINT AS cells FROM named GROUP BY c
        UNION ALL SELECT level + 1, (3 * (q - uq) + (r - ur)) // 7, (2 * (r - ur) - (q - uq)) // 7, n, cells
          FROM (SELECT *, {_UQ} AS uq, {_UR} AS ur FROM climb) WHERE level < {LEVELS_UP})
    SELECT level, '{int(geo.TRIP_M)}/' || level || ':' || q || ':' || r AS cell, sum(n)::BIGINT AS points, sum(cells)::BIGINT AS cells FROM climb GROUP BY level, q, r""",
    "points",
).replace("WITH ", "WITH RECURSIVE ", 1)


def _pickups(spark: SparkSession, sf_dir: str, size: float = geo.SURGE_M) -> DataFrame:
    """Trips with the cell of their pickup; cells are found once for each node."""
    nodes = tables.grid_nodes(spark).select(F.col("node_id").alias("pickup_node"), geo.cell("lat", "lon", size).alias("cell"))
    return tables.trips(spark, sf_dir).join(nodes, "pickup_node")


_PICKUPS = f"""cells AS (SELECT node_id, {geo.cell_sql('lat', 'lon', geo.SURGE_M)} AS cell FROM grid_nodes),
      pickups AS (SELECT t.*, cell FROM trips t JOIN cells ON node_id = pickup_node)"""


def _open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, requests): riders that wait now, matched or not."""
    t = _pickups(spark, sf_dir)
    pending = t.where((F.col("request_ts_unix_ms") <= NOW) & (F.col("match_ts_unix_ms") > NOW))
    assigned = t.where((F.col("match_ts_unix_ms") <= NOW) & (F.col("pickup_ts_unix_ms") > NOW))
    return pending.unionByName(assigned).groupBy("cell").agg(F.count("*").alias("requests"))


_OPEN = f"""{_PICKUPS}, open AS (SELECT cell, count(*) AS requests FROM pickups WHERE request_ts_unix_ms <= {NOW} AND pickup_ts_unix_ms > {NOW} GROUP BY cell)"""


def open_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _open(spark, sf_dir)


SQL["open_demand"] = with_tables(f"+ {_OPEN} SELECT cell, requests FROM open", "trips", "grid_nodes")


def _surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cars = latest_pings(tables.pings(spark, sf_dir)).where(F.col("state").isin("idle", "repositioning"))
    cars = cars.groupBy(geo.cell("lat", "lon", geo.SURGE_M).alias("cell")).agg(F.count("*").alias("drivers"))
    both = _open(spark, sf_dir).join(cars, "cell", "full")
    n = lambda c: F.coalesce(c, F.lit(0))
    return both.select("cell", n("requests").alias("requests"), n("drivers").alias("drivers"), market.raw_surge(n("requests"), n("drivers")).alias("surge"))


def surge_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _surge(spark, sf_dir).withColumn("surge", r3("surge"))


_SURGE = f"""{_OPEN}, {_LAST}, cars AS (SELECT cell, count(*) AS drivers FROM (SELECT {geo.cell_sql('lat', 'lon', geo.SURGE_M)} AS cell FROM last
        WHERE state IN ('idle', 'repositioning')) GROUP BY cell),
      surge AS (SELECT cell, coalesce(requests, 0) AS requests, coalesce(drivers, 0) AS drivers,
        least(greatest(coalesce(requests, 0)::DOUBLE / greatest(coalesce(drivers, 0), 1), 1.0), 3.0) AS surge FROM open FULL JOIN cars USING (cell))"""
SQL["surge_raw"] = with_tables(f"+ {_SURGE} SELECT cell, requests, drivers, {r('surge')} AS surge FROM surge", "trips", "grid_nodes", "pings")


def surge_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauges of the fleet: cells with surge, their share above five percent, open requests and idle drivers."""
    s = _surge(spark, sf_dir).agg(
        F.count("*").alias("cells"),
        F.coalesce(F.avg((F.col("surge") > 1.05).cast("double")), F.lit(0.0)).alias("share"),
        F.sum("requests").alias("open_requests"),
        F.sum("drivers").alias("idle_drivers"),
    )
    return s.select("cells", r3(F.least(F.greatest("share", F.lit(0.0)), F.lit(1.0))).alias("surge_fraction"), "open_requests", "idle_drivers")


SQL["surge_fraction"] = with_tables(
    f"""+ {_SURGE} SELECT count(*) AS cells, {r('coalesce(avg((surge > 1.05)::INT), 0)')} AS surge_fraction, sum(requests)::BIGINT AS open_requests,
    sum(drivers)::BIGINT AS idle_drivers FROM surge""",
    "trips", "grid_nodes", "pings",
)


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, ts, raw): surge of each cell and minute, from the minute's requests and three drivers."""
    minute = F.floor(F.col("request_ts_unix_ms") / 60_000) * 60
    counted = _pickups(spark, sf_dir).groupBy("cell", minute.cast("double").alias("ts")).agg(F.count("*").alias("requests"))
    return counted.select("cell", "ts", market.raw_surge(F.col("requests"), F.lit(3)).alias("raw"))


def surge_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = market.smoothed(_ticks(spark, sf_dir), "cell")
    return s.select("cell", F.col("ts").cast("long").alias("ts"), r3("surge").alias("surge"))


_EMA = f"""{_PICKUPS}, ticks AS (SELECT cell, (request_ts_unix_ms // 60000) * 60 AS ts, least(greatest(count(*) / 3.0::DOUBLE, 1.0), 3.0) AS raw FROM pickups GROUP BY ALL),
      num AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ts) AS i, ts - lag(ts) OVER (PARTITION BY cell ORDER BY ts) AS dt FROM ticks),
      ema AS (SELECT cell, ts, i, CASE WHEN raw <= 1.001 THEN 1.0::DOUBLE ELSE raw END AS surge FROM num WHERE i = 1
        UNION ALL SELECT n.cell, n.ts, n.i, CASE WHEN e.surge + (1 - exp(-n.dt / 60.0::DOUBLE)) * (n.raw - e.surge) <= 1.001 THEN 1.0
          ELSE e.surge + (1 - exp(-n.dt / 60.0::DOUBLE)) * (n.raw - e.surge) END FROM ema e JOIN num n ON n.cell = e.cell AND n.i = e.i + 1)"""
SQL["surge_ema"] = with_tables(f"+ {_EMA} SELECT cell, ts, {r('surge')} AS surge FROM ema", "trips", "grid_nodes").replace("WITH ", "WITH RECURSIVE ", 1)


def surge_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the smoothed multipliers those that are reported: changes of over 0.05 since the last report, and one return to 1."""
    s = market.smoothed(_ticks(spark, sf_dir), "cell")
    told = market.reported(s.select("cell", "ts", "surge"), "cell", "ts", "surge", 1.0, market.REPORT, None)
    return told.select("cell", F.col("ts").cast("long").alias("ts"), r3("surge").alias("surge"))


SQL["surge_publish"] = with_tables(
    f"""+ {_EMA}, told AS (SELECT cell, ts, i, surge, surge > 1.0001 AS tell, CASE WHEN surge > 1.0001 THEN surge END AS last FROM ema WHERE i = 1
        UNION ALL SELECT cell, ts, i, surge, tell, CASE WHEN surge <= 1.0001 THEN NULL WHEN tell THEN surge ELSE last END FROM (
          SELECT e.cell, e.ts, e.i, e.surge, t.last, CASE WHEN e.surge <= 1.0001 THEN t.last IS NOT NULL ELSE t.last IS NULL OR abs(e.surge - t.last) > 0.05 END AS tell
          FROM told t JOIN ema e ON e.cell = t.cell AND e.i = t.i + 1))
    SELECT cell, ts, {r('surge')} AS surge FROM told WHERE tell""",
    "trips", "grid_nodes",
).replace("WITH ", "WITH RECURSIVE ", 1)


def weight_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slowdowns of the street at each pickup node that are reported: over ten percent from the last report."""
    t = tables.trips(spark, sf_dir)
    minute = (F.floor(F.col("pickup_ts_unix_ms") / 60_000) * 60).cast("double").alias("ts")
    cars = t.groupBy("pickup_node", minute).agg(F.count("*").alias("cars"))
    factor = F.least(1 + F.pow(F.greatest(F.col("cars") - 1, F.lit(0)) / 5.0, F.lit(2.0)), F.lit(5.0))
    told = market.reported(cars.select("pickup_node", "ts", (20 * factor).alias("weight_s")), "pickup_node", "ts", "weight_s", 20.0, None, 0.1)
    return told.select("pickup_node", F.col("ts").cast("long").alias("ts"), r3("weight_s").alias("weight_s"))


SQL["weight_changes"] = with_tables(
    f"""+ cars AS (SELECT pickup_node, (pickup_ts_unix_ms // 60000) * 60 AS ts, 20 * least(1 + pow(greatest(count(*) - 1, 0) / 5.0::DOUBLE, 2), 5.0) AS w FROM trips GROUP BY ALL),
      num AS (SELECT *, row_number() OVER (PARTITION BY pickup_node ORDER BY ts) AS i FROM cars),
      told AS (SELECT pickup_node, 0::BIGINT AS ts, 0::BIGINT AS i, 20.0::DOUBLE AS w, false AS tell, NULL::DOUBLE AS last FROM num WHERE i = 1
        UNION ALL SELECT pickup_node, ts, i, w, tell, CASE WHEN w <= 20 * 1.0001 THEN NULL WHEN tell THEN w ELSE last END FROM (
          SELECT n.pickup_node, n.ts, n.i, n.w, t.last, abs(n.w - coalesce(t.last, 20.0)) / coalesce(t.last, 20.0) > 0.1 AS tell
          FROM told t JOIN num n ON n.pickup_node = t.pickup_node AND n.i = t.i + 1))
    SELECT pickup_node, ts, {r('w')} AS weight_s FROM told WHERE tell""",
    "trips",
).replace("WITH ", "WITH RECURSIVE ", 1)


def surge_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last multiplier of every cell; cells back at 1 are gone."""
    s = market.smoothed(_ticks(spark, sf_dir), "cell").groupBy("cell").agg(F.max(F.struct("ts", "surge")).alias("last"))
    return s.where(F.col("last.surge") > 1.0001).select("cell", r3("last.surge").alias("surge"))


SQL["surge_last"] = with_tables(
    f"+ {_EMA} SELECT cell, {r('arg_max(surge, ts)')} AS surge FROM ema GROUP BY cell HAVING arg_max(surge, ts) > 1.0001", "trips", "grid_nodes"
).replace("WITH ", "WITH RECURSIVE ", 1)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = tables.grid_nodes(spark).withColumnRenamed("node_id", "pickup_node")
    t = tables.trips(spark, sf_dir).join(nodes, "pickup_node")
    return t.select(F.col("ride_id").alias("request_id"), "scenario", "policy", "seed", F.col("request_ts_unix_ms").alias("request_ts"), "lat", "lon")


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    requests = _requests(spark, sf_dir)
    cars = latest_pings(tables.pings(spark, sf_dir)).where(F.col("state").isin("idle", "repositioning"))
    return requests, matching.nearest(requests, cars)


def nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest available drivers of every request."""
    return _candidates(spark, sf_dir)[1].select("request_id", "driver_id", "rank", r3("dist_m").alias("dist_m"))


_X, _Y = f"((lon - ({geo.CENTRE[1]}::DOUBLE)) * {geo.LON_M}::DOUBLE)", f"((lat - {geo.CENTRE[0]}::DOUBLE) * {geo.LAT_M}::DOUBLE)"
_NEAR = f"""{_LAST}, cars AS (SELECT driver_id, {_X} AS dx, {_Y} AS dy FROM last WHERE state IN ('idle', 'repositioning')),
      spots AS (SELECT node_id, {_X} AS x, {_Y} AS y FROM grid_nodes),
      ranked AS (SELECT node_id, driver_id, sqrt((x - dx) * (x - dx) + (y - dy) * (y - dy)) AS dist_m FROM spots CROSS JOIN cars),
      near AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY dist_m, driver_id) AS rank FROM ranked QUALIFY rank <= 5)"""
SQL["nearest_k"] = with_tables(
    f"+ {_NEAR} SELECT ride_id AS request_id, driver_id, rank::INT AS rank, {r('dist_m')} AS dist_m FROM trips JOIN near ON node_id = pickup_node",
    "trips", "grid_nodes", "pings",
)


def cost_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of every candidate pair, less a premium where the request's seed stands for surge."""
    requests, near = _candidates(spark, sf_dir)
    surged = near.join(requests.select("request_id", (1 + F.col("seed") % 3 / 2).alias("surge")), "request_id")
    made = matching.cost_matrix(surged, 15.0, F.col("surge"))
    return made.select("request_id", "driver_id", r3("cost").alias("cost_s"))


SQL["cost_matrix"] = with_tables(
    f"""+ {_NEAR} SELECT ride_id AS request_id, driver_id, {r('dist_m / 11.0::DOUBLE - 15.0::DOUBLE * ((1 + (seed % 3) / 2.0::DOUBLE) - 1)')} AS cost_s
    FROM trips JOIN near ON node_id = pickup_node""",
    "trips", "grid_nodes", "pings",
)


def batch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matching window of every request, counted from the run's first one."""
    t = matching.windows(_requests(spark, sf_dir), ["scenario", "policy", "seed"], "request_ts", WINDOW_MS)
    return t.select("request_id", "batch_ms")


SQL["batch_windows"] = with_tables(
    f"""SELECT ride_id AS request_id, f + (ceil((request_ts_unix_ms - f) / {WINDOW_MS}.0) * {WINDOW_MS})::BIGINT AS batch_ms
    FROM (SELECT *, min(request_ts_unix_ms) OVER (PARTITION BY scenario, policy, seed) AS f FROM trips)""",
    "trips",
)

_BATCH = ["scenario", "policy", "seed", "batch_ms"]


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, near = _candidates(spark, sf_dir)
    requests = matching.windows(requests, _BATCH[:3], "request_ts", 10 * WINDOW_MS)
    costs = matching.cost_matrix(near)
    own = requests.select("request_id", "request_ts", *_BATCH, matching.region("lat", "lon").alias("region"))
    return kept(costs.join(own, "request_id"))


def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.greedy_match(_batches(spark, sf_dir), _BATCH).select("request_id", "driver_id", r3("cost").alias("cost_s"))


SQL["greedy_match"] = with_tables(
    f"""+ {_NEAR}, f AS (SELECT *, min(request_ts_unix_ms) OVER (PARTITION BY scenario, policy, seed) AS f FROM trips),
      own AS (SELECT *, f + (ceil((request_ts_unix_ms - f) / {10 * WINDOW_MS}.0) * {10 * WINDOW_MS})::BIGINT AS batch_ms FROM f),
      cands AS (SELECT node_id, list({{'d': driver_id, 'cost': dist_m / 11.0::DOUBLE}} ORDER BY dist_m / 11.0::DOUBLE, rank) AS cands FROM near GROUP BY node_id),
      num AS (SELECT ride_id, cands, dense_rank() OVER (ORDER BY scenario, policy, seed, batch_ms) AS b,
        row_number() OVER (PARTITION BY scenario, policy, seed, batch_ms ORDER BY request_ts_unix_ms, ride_id) AS i FROM own JOIN cands ON node_id = pickup_node),
      g AS (SELECT b, i, ride_id, cands[1] AS took, [cands[1].d] AS taken FROM num WHERE i = 1
        UNION ALL SELECT b, i, ride_id, took, CASE WHEN took IS NULL THEN taken ELSE list_append(taken, took.d) END FROM (
          SELECT n.b, n.i, n.ride_id, g.taken, list_filter(n.cands, lambda x: NOT list_contains(g.taken, x.d))[1] AS took FROM g JOIN num n ON n.b = g.b AND n.i = g.i + 1))
    SELECT ride_id AS request_id, took.d AS driver_id, {r('took.cost')} AS cost_s FROM g WHERE took IS NOT NULL""",
    "trips", "grid_nodes", "pings",
).replace("WITH ", "WITH RECURSIVE ", 1)


def hungarian_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By run: matched requests and their least total cost."""
    made = matching.batch_match(_batches(spark, sf_dir), _BATCH)
    t = made.groupBy("scenario", "policy", "seed").agg(F.count("*").alias("matched"), F.sum("cost").alias("total"))
    return t.select("scenario", "policy", "seed", "matched", r3("total").alias("total_s"))


def region_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = matching.region_match(_batches(spark, sf_dir), _BATCH)
    return made.select("request_id", "driver_id", "region", r3("cost").alias("cost_s"))


def abandoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that had waited more than five minutes when they were picked up."""
    t = tables.trips(spark, sf_dir)
    return matching.abandoned(t, F.col("wait_time_s"), 300.0).select("ride_id", r3("wait_time_s").alias("waited_s"))


SQL["abandoned"] = with_tables(f"SELECT ride_id, {r('wait_time_s')} AS waited_s FROM trips WHERE wait_time_s > 300", "trips")


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("request_ts_unix_ms")
    recent = _pickups(spark, sf_dir).where((t <= NOW) & (t >= NOW - 15 * 60_000))
    cars = latest_pings(tables.pings(spark, sf_dir)).where(F.col("state").isin("idle", "repositioning"))
    return matching.gaps(recent, cars.withColumn("cell", geo.cell("lat", "lon", geo.SURGE_M)))


def reposition_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir)


_GAPS = f"""{_PICKUPS}, {_LAST}, moves AS (SELECT cell, 1 AS d FROM pickups WHERE request_ts_unix_ms <= {NOW} AND request_ts_unix_ms >= {NOW - 900_000}
        UNION ALL SELECT {geo.cell_sql('lat', 'lon', geo.SURGE_M)}, -1 FROM last WHERE state IN ('idle', 'repositioning')),
      gaps AS (SELECT cell, sum(d)::BIGINT AS gap FROM moves GROUP BY cell)"""
SQL["reposition_gap"] = with_tables(f"+ {_GAPS} SELECT cell, gap FROM gaps", "trips", "grid_nodes", "pings")


def reposition_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an idle car of each cell should go: the largest gap within three rings."""
    return matching.reposition_targets(kept(_gaps(spark, sf_dir)), lambda c: geo.disk(c, 3))


def _cube(a: str, b: str) -> str:
    dq, dr = f"(split_part({a}, ':', 2)::INT - split_part({b}, ':', 2)::INT)", f"(split_part({a}, ':', 3)::INT - split_part({b}, ':', 3)::INT)"
    return f"greatest(abs({dq}), abs({dr}), abs({dq} + {dr}))"


SQL["reposition_targets"] = with_tables(
    f"""+ {_GAPS}, p AS (SELECT a.cell, b.cell AS target, a.gap AS here, b.gap AS target_gap, {_cube('a.cell', 'b.cell')} AS ring,
        split_part(b.cell, ':', 2)::INT - split_part(a.cell, ':', 2)::INT AS dq, split_part(b.cell, ':', 3)::INT - split_part(a.cell, ':', 3)::INT AS dr
        FROM gaps a JOIN gaps b ON {_cube('a.cell', 'b.cell')} <= 3),
      b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY cell ORDER BY target_gap DESC, ring, dq, dr) = 1)
    SELECT cell, target, target_gap FROM b WHERE cell <> target AND target_gap > 0 AND target_gap - here >= 2""",
    "trips", "grid_nodes", "pings",
)


def fleet_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of the fleet without its outliers: the values at the 5th and 95th percent of the drivers in order."""
    p = kept(latest_pings(tables.pings(spark, sf_dir)).select("driver_id", "lat", "lon"))
    found = [ordered.ranked(p, c) for c in ("lat", "lon")]
    n = p.count()
    at = lambda share: min(n - 1, int(n * share))
    made = None
    for c, rows in zip(("lat", "lon"), found, strict=True):
        ends = rows.where(F.col("rank").isin(at(0.05), at(0.95))).select(F.lit(c).alias("c"), F.col(c).alias("v"))
        made = ends if made is None else made.unionByName(ends)
    low, high = (lambda c: F.min(F.when(F.col("c") == c, F.col("v")))), (lambda c: F.max(F.when(F.col("c") == c, F.col("v"))))
    return made.agg(*(r3(f(c)).alias(f"{c}_{name}") for c in ("lat", "lon") for name, f in (("low", low), ("high", high))))


SQL["fleet_bounds"] = with_tables(
    f"""+ {_LAST}, l AS (SELECT list_sort(list(lat)) AS a, list_sort(list(lon)) AS b, count(*) AS n FROM last),
      i AS (SELECT *, least(n - 1, floor(n * 0.05)::BIGINT) + 1 AS lo, least(n - 1, floor(n * 0.95)::BIGINT) + 1 AS hi FROM l)
    SELECT {r('a[lo]')} AS lat_low, {r('a[hi]')} AS lat_high, {r('b[lo]')} AS lon_low, {r('b[hi]')} AS lon_high FROM i""",
    "pings",
)

QUERIES = [
    driver_last, available_drivers, pending_after_match, cell_counts, cell_rollup, open_demand, surge_raw, surge_fraction, surge_ema, surge_publish, weight_changes,
    surge_last, nearest_k, cost_matrix, batch_windows, greedy_match, hungarian_total, region_match, abandoned, reposition_gap, reposition_targets,
    fleet_bounds,
]
