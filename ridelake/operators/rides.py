"""The state of rides and of the fleet at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A ride's states in the order it goes through them.
STATES = ["pending", "assigned", "aboard", "completed"]


def state_at(now: int | Column) -> Column:
    """The state of a ride at ``now`` (milliseconds); null before its request."""
    now = F.lit(now) if isinstance(now, int) else now
    reached = [F.col(f"{c}_ts_unix_ms") <= now for c in ("request", "match", "pickup", "dropoff")]
    out = F.when(reached[3], STATES[3])
    for i in (2, 1, 0):
        out = out.when(reached[i], STATES[i])
    return out


def state_counts(rides: DataFrame, now: int, keys: list[str]) -> DataFrame:
    """(keys, a column for each state): rides by their state."""
    placed = rides.withColumn("__state", state_at(now)).where("__state IS NOT NULL").groupBy(*keys)
    return placed.agg(*[F.count(F.when(F.col("__state") == s, 1)).alias(s) for s in STATES])


def losses(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, declined, cancelled, requested): how often offers were declined and rides cancelled."""
    n = lambda topic: F.count(F.when(F.col("topic") == topic, 1))
    return events.groupBy(*keys).agg(n("offer.declined").alias("declined"), n("trip.cancelled").alias("cancelled"), n("trip.requested").alias("requested"))


def with_surge(rides: DataFrame, surge: DataFrame, cell: str = "cell") -> DataFrame:
    """``rides`` with the multiplier of their cell; 1 where the cell has none, or where a ride has no cell."""
    known = surge.select(F.col("cell").alias("__cell"), F.col("surge").alias("__surge"))
    return rides.join(known, F.col(cell) == F.col("__cell"), "left").withColumn("surge", F.coalesce("__surge", F.lit(1.0))).drop("__cell", "__surge")
