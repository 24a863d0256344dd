"""Statistics of paired experiments as column expressions and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.functions.exact import total
from ridelake.operators.ordered import percentiles

#: 97.5th percentile of Student's t for 1 to 30 degrees of freedom.
T975 = [
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
]
#: 97.5th percentile of the normal distribution.
Z975 = 1.959963984540054


def t975(df: Column) -> Column:
    """Student's t quantile: the table up to 30 degrees of freedom, an expansion around the normal one beyond."""
    z, v = Z975, df.cast("double")
    far = F.lit(z) + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v * v)
    return F.when(df <= len(T975), F.try_element_at(F.array(*map(F.lit, T975)), df.cast("int"))).otherwise(far)


def t_interval(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, lo and hi of a 95 % interval for the mean; with fewer than two values the mean itself."""
    made = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.stddev_samp(value).alias("sd")
    )
    half = F.when(F.col("n") < 2, 0.0).otherwise(t975(F.col("n") - 1) * F.col("sd") / F.sqrt("n"))
    return made.select(*keys, "n", "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def log_factorial(n: Column) -> Column:
    """ln n!, by summing logarithms; Spark has no log-gamma."""
    steps = F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + F.log(x.cast("double")))


def sign_test(wins: Column, n: Column) -> Column:
    """Exact two-sided p-value of ``wins`` in ``n`` trials at even odds, in log space; 1 without trials."""
    k = F.greatest(wins, n - wins)
    term = lambda i: log_factorial(n) - log_factorial(i) - log_factorial(n - i) - n * F.log(F.lit(2.0))
    top = term(k)
    tail = F.aggregate(F.sequence(k.cast("int"), n.cast("int")), F.lit(0.0), lambda s, i: s + F.exp(term(i) - top))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(top) * tail))


def nice_ceil(x: Column) -> Column:
    """The next 1, 2 or 5 times a power of ten; 1 for nothing or less."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    steps = F.transform(F.array(*map(F.lit, [1.0, 2.0, 5.0, 10.0])), lambda m: m * base)
    return F.when(x <= 0, 1.0).otherwise(F.coalesce(F.array_min(F.filter(steps, lambda s: s >= x)), 10 * base))


def paired_differences(waits: DataFrame, base: str, pair: list[str], decimals: int | None = None) -> DataFrame:
    """Each other policy's mean wait minus that of ``base``, for every pair of runs where both have riders. Waits of at most ``decimals``
    decimals are summed exactly."""
    means = waits.groupBy(*pair, "policy").agg(mean("wait_seconds", decimals).alias("mean_wait"))
    own = means.where(F.col("policy") == base).select(*pair, F.col("mean_wait").alias("base_wait"))
    others = means.where(F.col("policy") != base).withColumnRenamed("mean_wait", "alt_wait")
    return others.join(own, pair).withColumn("diff", F.col("alt_wait") - F.col("base_wait"))


def mean(value: str, decimals: int | None = None) -> Column:
    """The mean as an aggregate; values of at most ``decimals`` decimals are summed exactly."""
    return F.when(F.count(value) > 0, total(value, decimals).cast("double") / F.count(value))


def summary(df: DataFrame, keys: list[str], value: str, decimals: int | None = None) -> DataFrame:
    """n, mean, p50 and p95 by ``keys``; 0 where there is no value. Percentiles are exact and interpolate. Values of at most
    ``decimals`` decimals are summed exactly."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    also = {"n": (F.count(value), F.sum("n")), "total": (total(value, decimals), F.sum("total"))}
    found = percentiles(df, keys, value, {"p50": 0.5, "p95": 0.95}, also)
    average = F.when(F.col("n") > 0, F.col("total").cast("double") / F.col("n"))
    return found.select(*keys, "n", zero(average).alias("mean"), zero(F.col("p50")).alias("p50"), zero(F.col("p95")).alias("p95"))
