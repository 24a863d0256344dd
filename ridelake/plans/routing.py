"""Queries on matching by road: drivers on the streets of the town, and the seconds they need to a pickup under traffic."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake import tables
from ridelake.functions.exact import r3
from ridelake.operators import matching
from ridelake.plans import marketplace, roads
from ridelake.plans.reports import r
from ridelake.storage import kept

SQL: dict[str, str] = {}

#: Places where riders wait.
RANKS = 16


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests at the taxi ranks of the town."""
    n = 2 * tables.read(spark, sf_dir, "part").count()
    t = tables.trips(spark, sf_dir).withColumn("node_id", F.col("pickup_node") % RANKS * (n // RANKS))
    t = t.join(tables.street_nodes(spark, sf_dir), "node_id").select("*", F.col("node_id").alias("rank_node"))
    return t.select(
        F.col("ride_id").alias("request_id"), "scenario", "policy", "seed", F.col("request_ts_unix_ms").alias("request_ts"), "lat", "lon", F.col("rank_node").alias("pickup_node")
    )


def _drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available drivers at a node, half of them on the street east of it, or west at the border."""
    n = 2 * tables.read(spark, sf_dir, "part").count()
    cars = marketplace.latest_pings(tables.pings(spark, sf_dir)).where(F.col("state").isin("idle", "repositioning"))
    a, e = F.col("node"), F.col("event_id")
    cars = cars.select("driver_id", "event_id", (e * 7 % n).alias("node"))
    side = F.when(((a + 1) % isqrt(n) != 0) & (a + 1 < n), 0).otherwise(1)
    moving = F.floor(e / 4) % 2 == 0
    cars = cars.select("driver_id", "node", F.when(moving, a * 4 + side).alias("edge_id"), (e % 10 / 10).alias("progress"))
    return cars.join(tables.street_nodes(spark, sf_dir).withColumnRenamed("node_id", "node"), "node")


def _routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    requests, drivers = _requests(spark, sf_dir), kept(_drivers(spark, sf_dir))
    edges = kept(roads._effective(spark, sf_dir))
    return requests, matching.routed(matching.nearest(requests, drivers), requests, drivers, edges)


def routed_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds by road from each of the five nearest drivers to every request."""
    return _routed(spark, sf_dir)[1].select("request_id", "driver_id", r3("cost").alias("cost_s"))


_TOWN = f"""{roads._EFFECTIVE}, {marketplace._LAST},
      size AS (SELECT count(*) AS n, floor(sqrt(count(*)))::BIGINT AS w FROM street_nodes),
      drv AS (SELECT driver_id, event_id, event_id * 7 % n AS node, event_id % 10 / 10.0::DOUBLE AS progress, n, w FROM last, size WHERE state IN ('idle', 'repositioning')),
      taxis AS (SELECT d.driver_id, d.node, coalesce(e.to_node, d.node) AS stop, coalesce((1 - progress) * e.weight_s, 0) AS lead, {marketplace._X} AS dx, {marketplace._Y} AS dy
        FROM drv d JOIN street_nodes ON node_id = d.node LEFT JOIN eff e ON event_id // 4 % 2 = 0
          AND e.edge_id = d.node * 4 + CASE WHEN (d.node + 1) % w <> 0 AND d.node + 1 < n THEN 0 ELSE 1 END),
      ranks AS (SELECT i, i * (n // {RANKS}) AS node, {marketplace._X} AS x, {marketplace._Y} AS y FROM range({RANKS}) t(i), size JOIN street_nodes ON node_id = i * (n // {RANKS})),
      near AS (SELECT i, ranks.node AS pickup, driver_id, stop, lead, row_number() OVER (PARTITION BY i ORDER BY sqrt((x - dx) * (x - dx) + (y - dy) * (y - dy)), driver_id) AS rank
        FROM ranks CROSS JOIN taxis QUALIFY rank <= 5),
      way AS (SELECT node AS target, node, 0::DOUBLE AS cost, 0 AS k FROM ranks
        UNION ALL SELECT target, node, min(cost), k + 1 FROM (
          SELECT w.target, e.from_node AS node, w.cost + e.weight_s AS cost, w.k FROM way w JOIN eff e ON e.to_node = w.node
          UNION ALL SELECT target, node, cost, k FROM way) GROUP BY target, node, k HAVING k < 3 * (SELECT w FROM size)),
      best AS (SELECT target, node, min(cost) AS cost FROM way WHERE node IN (SELECT stop FROM near) GROUP BY target, node),
      costs AS (SELECT i, driver_id, rank, round(lead + cost, 6) AS cost FROM near JOIN best ON target = pickup AND best.node = stop)"""
SQL["routed_costs"] = roads._recursive(
    f"+ {_TOWN} SELECT ride_id AS request_id, driver_id, {r('cost')} AS cost_s FROM trips JOIN costs ON i = pickup_node % {RANKS}", "street_nodes", "street_edges", "pings", "trips"
)


def routed_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each window in turn take the driver that is there first by road."""
    requests, costs = _routed(spark, sf_dir)
    own = matching.windows(requests, marketplace._BATCH[:3], "request_ts", 10 * marketplace.WINDOW_MS).select("request_id", "request_ts", *marketplace._BATCH)
    return matching.greedy_match(costs.join(own, "request_id"), marketplace._BATCH).select("request_id", "driver_id", r3("cost").alias("cost_s"))


_WINDOW = 10 * marketplace.WINDOW_MS
SQL["routed_greedy"] = roads._recursive(
    f"""+ {_TOWN}, fst AS (SELECT *, min(request_ts_unix_ms) OVER (PARTITION BY scenario, policy, seed) AS f FROM trips),
      own AS (SELECT *, f + (ceil((request_ts_unix_ms - f) / {_WINDOW}.0) * {_WINDOW})::BIGINT AS batch_ms FROM fst),
      cands AS (SELECT i, list({{'d': driver_id, 'cost': cost}} ORDER BY cost, rank) AS cands FROM costs GROUP BY i),
      num AS (SELECT ride_id, cands, dense_rank() OVER (ORDER BY scenario, policy, seed, batch_ms) AS b,
        row_number() OVER (PARTITION BY scenario, policy, seed, batch_ms ORDER BY request_ts_unix_ms, ride_id) AS j FROM own JOIN cands ON i = pickup_node % {RANKS}),
      g AS (SELECT b, j, ride_id, cands[1] AS took, [cands[1].d] AS taken FROM num WHERE j = 1
        UNION ALL SELECT b, j, ride_id, took, CASE WHEN took IS NULL THEN taken ELSE list_append(taken, took.d) END FROM (
          SELECT m.b, m.j, m.ride_id, g.taken, list_filter(m.cands, lambda x: NOT list_contains(g.taken, x.d))[1] AS took FROM g JOIN num m ON m.b = g.b AND m.j = g.j + 1))
    SELECT ride_id AS request_id, took.d AS driver_id, {r('took.cost')} AS cost_s FROM g WHERE took IS NOT NULL""",
    "street_nodes", "street_edges", "pings", "trips",
)

QUERIES = [routed_costs, routed_greedy]
