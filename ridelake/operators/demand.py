"""Demand of a scenario: rates over time, weights of road nodes, and seeded arrivals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelake.functions.geo import haversine
from ridelake.operators.ordered import ranked, running_total
from ridelake.storage import kept

Segments = Sequence[tuple[float, float]]


def rate_at(t: Column, segments: Segments) -> Column:
    """Requests per second at ``t`` seconds: linear between the segments' moments, flat outside them."""
    out = F.lit(float(segments[-1][1]))
    for (t0, a), (t1, b) in reversed(list(zip(segments, segments[1:], strict=False))):
        out = F.when(t < t1, F.lit(a) + F.lit(b - a) * (t - t0) / F.lit(t1 - t0) if t1 > t0 else F.lit(b)).otherwise(out)
    return F.when(t <= segments[0][0], F.lit(float(segments[0][1]))).otherwise(out)


def scaled(levels: DataFrame, scenario: str, segments: Segments) -> DataFrame:
    """(scenario, demand, t, rate): the scenario's segments at each demand level, named after it."""
    of = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(x)).alias("rate")) for t, x in segments])
    whole = F.col("demand") == F.floor("demand")
    level = F.when(whole, F.col("demand").cast("int").cast("string")).otherwise(F.col("demand").cast("string"))
    rows = levels.select(F.concat(F.lit(scenario + "_"), level, F.lit("x")).alias("scenario"), "demand", F.inline(of))
    return rows.withColumn("rate", F.col("demand") * F.col("rate"))


def hotspot_nodes(nodes: DataFrame, hotspots: Sequence[tuple[str, float, float, float, float]]) -> DataFrame:
    """(hotspot, weight, node_id): the nodes within each hotspot's radius, given as (name, lat, lon, radius_m, weight).

    A scenario names a handful of hotspots, so they stand in the plan as an array beside each node; a box around the circle
    spares most nodes the trigonometry.
    """
    of = F.array(*[
        F.struct(*[F.lit(x).alias(n) for x, n in zip(h, ("hotspot", "h_lat", "h_lon", "radius_m", "weight"), strict=True)]) for h in hotspots
    ])
    near = nodes.select("node_id", "lat", "lon", F.inline(of))
    box = F.col("radius_m") / 100_000
    near = near.where((F.abs(F.col("lat") - F.col("h_lat")) <= box) & (F.abs(F.col("lon") - F.col("h_lon")) <= box / F.cos(F.radians("h_lat")) + 1e-9))
    return near.where(haversine("lat", "lon", "h_lat", "h_lon") <= F.col("radius_m")).select("hotspot", "weight", "node_id")


def node_weights(nodes: DataFrame, hotspots: Sequence[tuple[str, float, float, float, float]]) -> DataFrame:
    """(node_id, weight): 1 for each node, and each hotspot's weight times all nodes, shared by the nodes inside.

    A hotspot that covers no node is an error: its share would go to the others without a word.
    """
    inside = hotspot_nodes(nodes, hotspots)
    n = nodes.count()
    counts = {r.hotspot: r["count"] for r in inside.groupBy("hotspot").count().collect()}
    if empty := [h[0] for h in hotspots if not counts.get(h[0])]:
        raise ValueError(f"no road nodes within hotspots {empty}")
    per = F.create_map(*[F.lit(x) for h in hotspots for x in (h[0], float(h[4]) * n / counts[h[0]])]) if hotspots else None
    if per is None:
        return nodes.select("node_id", F.lit(1.0).alias("weight"))
    added = inside.groupBy("node_id").agg(F.sum(per[F.col("hotspot")]).alias("added"))
    return nodes.select("node_id").join(added, "node_id", "left").select("node_id", (1 + F.coalesce("added", F.lit(0.0))).alias("weight"))


def cumulative(weights: DataFrame) -> DataFrame:
    """(node_id, weight, cum): running total of the weights in the order of nodes."""
    return running_total(weights, "node_id", "weight", "cum")


#: Bins of cumulative weights at most: a node with nearly all weight is listed in each, from an array of so many numbers.
MOST_BINS = 1 << 22


def binned(draws: DataFrame, cum: DataFrame, bins: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Draws (with __r, their place in the cumulative weights) and nodes (node_id, low, cum) by bins of equal weight; a node is listed in
    each bin that it spans. None without any weight.

    There are as many bins as nodes unless it is said otherwise, up to ``MOST_BINS``, so a draw meets about two nodes, however many there are.
    """
    total, n = cum.agg(F.max("cum"), F.count("*")).first()
    if (total or 0.0) <= 0:
        return None
    bins = bins or min(max(256, n), MOST_BINS)
    bin_of = lambda x: F.least(F.floor(x / total * bins), F.lit(bins - 1)).cast("int")
    low = F.col("cum") - F.col("weight")
    listed = cum.select("node_id", "cum", low.alias("low"), F.explode(F.sequence(bin_of(low), bin_of(F.col("cum")))).alias("bin"))
    return draws.withColumn("__r", F.col("u") * total).withColumn("bin", bin_of(F.col("__r"))), listed


def sample_nodes(draws: DataFrame, cum: DataFrame, bins: int | None = None) -> DataFrame:
    """(draw columns, node_id): for each draw ``u`` in [0, 1) the first node whose cumulative weight reaches
    ``u`` of the total. The range condition is checked within an equi-join on bins of equal weight.
    """
    if not (made := binned(draws, cum, bins)):
        return draws.withColumn("node_id", F.lit(None).cast("long"))
    hit = made[0].join(made[1], "bin").where((F.col("cum") >= F.col("__r")) & ((F.col("low") < F.col("__r")) | ((F.col("__r") == 0) & (F.col("low") <= 0))))
    return hit.select(*draws.columns, "node_id")


def arrivals(runs: DataFrame, segments: Segments, duration_s: float, step_s: float = 1.0) -> DataFrame:
    """(run columns, t, k): Poisson arrivals of every run (columns seed and demand), as one row for each request.

    Times come from Spark's own ranges; only the draw of a count for each step needs numpy. A step's generator is seeded by
    (seed, step), so the result does not depend on partitions or retries.
    """
    steps = int(duration_s / step_s)
    grid = runs.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    grid = grid.withColumn("mean", F.col("demand") * rate_at(F.col("step") * step_s, segments) * step_s)

    @F.pandas_udf("int")
    def drawn(seed: pd.Series, step: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([int(np.random.default_rng([s, i]).poisson(m)) for s, i, m in zip(seed, step, mean, strict=True)], dtype="int32")

    counted = grid.withColumn("n", drawn("seed", "step", "mean")).where("n > 0")
    return counted.select(*runs.columns, (F.col("step") * step_s).alias("t"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))


def spawn(nodes: DataFrame, n: int, seed: int) -> DataFrame:
    """(vehicle_id, node_id): ``n`` vehicles on distinct nodes, those of least hash with the seed."""
    drawn = nodes.select("node_id", F.xxhash64(F.lit(seed), "node_id").alias("h")).orderBy("h", "node_id").limit(n)
    return drawn.select((F.row_number().over(Window.orderBy("h", "node_id")) - 1).alias("vehicle_id"), "node_id")


def with_ends(draws: DataFrame, pickups: DataFrame, dropoffs: DataFrame) -> DataFrame:
    """(draw columns, pickup_node, dropoff_node): both ends of each arrival by the cumulative weights of nodes.

    Draws have u_pickup, u_dropoff and u_again in [0, 1). A dropoff that falls on the pickup is drawn once more by u_again, and then stands.
    """
    drawn = lambda rows, u, cum, name: sample_nodes(rows.withColumn("u", F.col(u)), cum).withColumnRenamed("node_id", name).drop("u")
    made = kept(drawn(drawn(draws, "u_pickup", pickups, "pickup_node"), "u_dropoff", dropoffs, "dropoff_node"))
    same = F.coalesce(F.col("pickup_node") == F.col("dropoff_node"), F.lit(False))
    again = drawn(made.where(same).drop("dropoff_node"), "u_again", dropoffs, "dropoff_node")
    return made.where(~same).unionByName(again)


def spawn_by_weight(weights: DataFrame, n: int, seed: int = 0, u: Column | None = None) -> DataFrame:
    """(vehicle_id, node_id): ``n`` vehicles on distinct nodes, drawn one after the other by the weights of the nodes that are left.

    Each node waits for -ln(u) / weight, and those that come first are the draws in their order. ``u`` in (0, 1] is drawn from the seed and
    the node. Where fewer than ``n`` nodes have a weight, the other vehicles are drawn from all of them again, with repeats.
    """
    chance = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 53)) + 1) / float(1 << 53)
    u = chance("node_id") if u is None else u
    waits = kept(weights.where("weight > 0").select("node_id", "weight", (-F.log(u) / F.col("weight")).alias("wait")))
    first = ranked(waits, "wait", "vehicle_id").where(F.col("vehicle_id") < n).select(F.col("vehicle_id").cast("long"), "node_id")
    there = waits.count()
    if not 0 < there < n:
        return first
    rest = weights.sparkSession.range(there, n).select(F.col("id").alias("vehicle_id"), (chance("id") - 1.0 / (1 << 53)).alias("u"))
    return first.unionByName(sample_nodes(rest, kept(cumulative(waits.select("node_id", "weight")))).select("vehicle_id", "node_id"))
