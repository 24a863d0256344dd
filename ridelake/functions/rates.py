"""Rates of counters that only grow, but start again when their process does, over sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rates(samples: DataFrame, keys: list[str], at: str = "ts_ms", value: str = "value", window_ms: int = 60_000, step_ms: int = 15_000) -> DataFrame:
    """(keys, t_ms, rate): growth a second within ``window_ms`` up to each multiple of ``step_ms``.

    A value below the one before means that the counter began again at nought. The growth between the first and the last sample is drawn out
    to the window's ends as dashboards do it: by no more than half a usual distance where an end is over 1.1 of these away, and
    not to before the counter was nought. Moments with fewer than two samples have no rate; samples without a moment or a value don't
    count, and equal ones count once. Each sample goes to the few windows that it lies in, so a series is spread over many groups
    and a group holds what one window has.
    """
    first = (F.ceil(F.col(at) / step_ms) * step_ms).cast("long")
    end = F.col(at) + (window_ms - 1)
    spread = samples.where(F.col(at).isNotNull() & F.col(value).isNotNull()).withColumn("t_ms", F.explode(F.when(first <= end, F.sequence(first, end.cast("long"), F.lit(step_ms).cast("long")))))
    met = spread.groupBy(*keys, "t_ms").agg(F.array_sort(F.collect_set(F.struct(F.col(at).cast("long").alias("at"), F.col(value).cast("double").alias("v")))).alias("s"))
    met = met.where(F.size("s") > 1)
    before_reset = F.aggregate(F.sequence(F.lit(1), F.size("s") - 1), F.lit(0.0), lambda sum_, i: sum_ + F.when(F.col("s")[i].v < F.col("s")[i - 1].v, F.col("s")[i - 1].v).otherwise(0.0))
    a, b = F.col("s")[0], F.element_at("s", -1)
    found = met.select(*keys, "t_ms", F.size("s").alias("n"), a.at.alias("from_ms"), b.at.alias("to_ms"), a.v.alias("began"), (b.v - a.v + before_reset).alias("grown"))
    return found.where("to_ms > from_ms").select(*keys, "t_ms", _drawn_out(window_ms).alias("rate"))


def _drawn_out(window_ms: int) -> Column:
    grown, length = F.col("grown"), (F.col("to_ms") - F.col("from_ms")).cast("double")
    usual = length / (F.col("n") - 1)
    reach = lambda gap: F.when(gap >= usual * 1.1, usual / 2).otherwise(gap)
    before = reach((F.col("from_ms") - (F.col("t_ms") - window_ms)).cast("double"))
    nought = length * F.col("began") / grown
    before = F.when((grown > 0) & (F.col("began") >= 0) & (nought < before), nought).otherwise(before)
    after = reach((F.col("t_ms") - F.col("to_ms")).cast("double"))
    return grown * ((length + before + after) / length) / (window_ms / 1000)


def summed(made: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, le, count): rates of buckets (column le) put together, never falling from one bound to the next, for ``histograms.quantile``."""
    total = made.groupBy(*keys, "le").agg(F.round(F.sum("rate"), 9).alias("count"))
    return total.withColumn("count", F.max("count").over(Window.partitionBy(*keys).orderBy("le").rowsBetween(Window.unboundedPreceding, 0)))
