"""Histograms with cumulative buckets, and quantiles read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the buckets, in seconds.
WAIT = [1, 5, 10, 20, 40, 60, 90, 120, 180, 300, 600]
DURATION = [30, 60, 120, 300, 600, 1200, 1800, 3600]


def label(col: str) -> Column:
    """A metric's label; missing and empty ones are ``unknown``."""
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit("unknown"))


def buckets(df: DataFrame, keys: list[str], value: str, bounds: list[int]) -> DataFrame:
    """(keys, le, count, sum, n): per bound the number of values up to it; the last bound is infinite.

    Values are counted once by the first bucket they fall into, so the shuffle carries one row for each key, bucket
    and task; the cumulative counts come from the few sums.
    """
    first = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        first = F.when(F.col(value) <= bounds[i], i).otherwise(first)
    own = df.where(F.col(value).isNotNull()).groupBy(*keys, first.alias("bucket"))
    own = own.agg(F.count("*").alias("c"), F.sum(value).alias("s"))
    counts = own.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "c"))).alias("held"), F.sum("s").alias("sum"), F.sum("c").alias("n")
    )
    held = lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long"))
    upto = lambda i: F.aggregate(F.sequence(F.lit(0), i), F.lit(0).cast("long"), lambda s, j: s + held(j))
    rows = F.transform(
        F.array(*[F.lit(float(b)) for b in bounds], F.lit(float("inf"))), lambda b, i: F.struct(b.alias("le"), upto(i).alias("count"))
    )
    return counts.select(*keys, "sum", "n", F.inline(rows))


def quantile(hist: DataFrame, keys: list[str], q: float) -> DataFrame:
    """The ``q`` quantile of histograms (keys, le, count): linear within the bucket it falls into, as dashboards
    compute it; in the infinite bucket the last finite bound."""
    order = Window.partitionBy(*keys).orderBy("le")
    n = F.max("count").over(Window.partitionBy(*keys))
    ranked = hist.select(
        *keys, "le", "count", F.lag("le", 1, 0.0).over(order).alias("lo"), F.lag("count", 1, 0).over(order).alias("below"), (q * n).alias("rank")
    )
    hit = ranked.where((F.col("count") >= F.col("rank")) & (F.col("count") > 0)).groupBy(*keys)
    hit = hit.agg(F.min(F.struct("le", "lo", "below", "count", "rank")).alias("b"))
    inside = F.col("b.lo") + (F.col("b.le") - F.col("b.lo")) * (F.col("b.rank") - F.col("b.below")) / (F.col("b.count") - F.col("b.below"))
    return hit.select(*keys, F.when(F.col("b.le") == float("inf"), F.col("b.lo")).otherwise(inside).alias("quantile"))
