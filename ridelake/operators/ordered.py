"""Running totals and dense numbers over a whole table, without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelake.storage import counted

def splits_of(df: DataFrame, order: str, ranges: int) -> list:
    """At most ``ranges`` - 1 values that part ``order`` into ranges of about as many rows."""
    at = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(order, at, 20 * ranges)).first()[0] if at else None
    return sorted(set(found or []))


def range_of(order: Column, splits: list) -> Column:
    """Number of the range that a value falls into. The splits are few, so the search is an expression."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(order > F.lit(splits[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(splits))


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on ``keys``, where a missing key equals a missing key."""
    named = right.select(*[F.col(c).alias(f"__key_{c}") if c in keys else F.col(c) for c in right.columns])
    same = [left[c].eqNullSafe(named[f"__key_{c}"]) for c in keys]
    return (left.join(named, same, how) if same else left.crossJoin(named)).drop(*[f"__key_{c}" for c in keys])


def running_total(df: DataFrame, order: str, value: str | Column, name: str, by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows up to this one, by ``order`` (unique, not null), within ``by``.

    Rows are dealt into ranges of the order; each range is summed up by itself and then begins at the
    total of the ranges before it. So a single key of ``by``, or none, still spreads over all ranges.
    """
    spark = df.sparkSession
    ranges = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splits = splits_of(df, order, ranges)
    value = F.col(value) if isinstance(value, str) else value
    placed = df.withColumn("__range", range_of(F.col(order), splits)).withColumn("__value", value)
    totals = placed.groupBy("__range", *by).agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", *by, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__range", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = placed.withColumn("__within", F.sum("__value").over(inside))
    joined = beside(summed, starts, ["__range", *by])
    return joined.select(*df.columns, (F.col("__start") + F.col("__within")).alias(name))


def dense_ids(df: DataFrame, order: str, name: str = "dense_id", by: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive numbers from 0 in the order of a unique column, within ``by``."""
    made = running_total(df, order, F.lit(1).cast("long"), name, by)
    return made.withColumn(name, F.col(name) - 1)


def ranked(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """Numbers from 0 in the order of a column that may have ties, which are numbered in any order. Each range is numbered by itself."""
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.withColumn("__range", range_of(F.col(order), splits_of(df, order, ranges)))
    counts = placed.groupBy("__range").count()
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1
    joined = placed.withColumn(name, inside).join(starts, "__range")
    return joined.withColumn(name, F.col(name) + F.col("__start")).select(*df.columns, name)


#: Distinct values of all groups together that may meet in one task, a hundred bytes each.
FEW = 1_000_000


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], also: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """(keys, a column for each of ``shares``): exact percentiles of each group that has a value, linear between neighbours.

    ``also``: further aggregates from the same pass, each as an aggregate over the rows and one over the column of its own name that puts these together;
    then groups without a value come too. Equal values are counted first, once. If no more than ``FEW`` values are left, a group's counts meet; beyond
    that the counts are dealt into ranges of values, so that no task holds a whole group, and what meets for a group are two
    values of each percentile from every range. Results are equal.
    """
    also = also or {}
    rows = df if also else df.where(F.col(value).isNotNull())
    made, seen = counted(rows.groupBy(*keys, value).agg(F.count("*").alias("__c"), *[part.alias(name) for name, (part, _) in also.items()]), n=F.count("*"))
    more = [whole.alias(name) for name, (_, whole) in also.items()]
    if seen["n"] <= FEW:
        found = made.groupBy(*keys).agg(F.percentile(value, list(map(float, shares.values())), F.col("__c")).alias("__p"), *more)
        return found.select(*keys, *[F.col("__p")[i].alias(name) for i, name in enumerate(shares)], *also)
    found = _by_ranges(made.where(F.col(value).isNotNull()), keys, value, shares)
    return beside(made.groupBy(*keys).agg(*more), found, keys, "left").select(*keys, *shares, *also) if also else found


def _by_ranges(counts: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    splits = splits_of(counts, value, max(1, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = counts.withColumn("__range", range_of(F.col(value), splits))
    totals = ranged.groupBy("__range", *keys).agg(F.sum("__c").alias("__sum"))  # a row for each range of a group
    group = Window.partitionBy(*keys)
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", *keys, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"), (F.sum("__sum").over(group) - 1).alias("__last"))
    within = F.sum("__c").over(Window.partitionBy("__range", *keys).orderBy(value))
    placed = beside(ranged.withColumn("__within", within), starts, ["__range", *keys]).withColumn("__upto", F.col("__start") + F.col("__within"))
    after = lambda at: F.min(F.when(F.col("__upto") > at, F.col(value)))
    at = {name: F.lit(float(share)) * F.col("__last") for name, share in shares.items()}
    ends = [after(side(x)).alias(f"__{end}_{name}") for name, x in at.items() for end, side in (("lo", F.floor), ("hi", F.ceil))]
    found = placed.groupBy(*keys).agg(F.max("__last").alias("__last"), *ends)

    def between(name: str, x: Column) -> Column:
        lo, hi, part = F.col(f"__lo_{name}"), F.col(f"__hi_{name}"), x - F.floor(x)
        return F.when(lo == hi, lo).otherwise(lo * (1 - part) + hi * part)

    return found.select(*keys, *[between(name, x).alias(name) for name, x in at.items()])
