"""Histograms and gauges as lines of the text format that metric collectors scrape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.functions.exact import r3


def escaped(value: Column) -> Column:
    """A label's value with backslashes, quotes and line ends written as escapes."""
    value = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(value, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def _labelled(names: list[str], *more: Column) -> Column:
    own = [F.concat(F.lit(f'{n}="'), escaped(F.col(n)), F.lit('"')) for n in names]
    return F.concat(F.lit("{"), F.concat_ws(",", *own, *more), F.lit("}"))


def histogram_lines(hist: DataFrame, metric: str, labels: list[str]) -> DataFrame:
    """(line): a bucket line for each row of ``hist`` (labels, le, count, sum, n), and sum and count of each set of labels."""
    last = F.col("le") == float("inf")
    bound = F.when(last, "+Inf").when(F.col("le") == F.floor("le"), F.col("le").cast("long").cast("string")).otherwise(F.col("le").cast("string"))
    name = lambda part: F.lit(f"{metric}_{part}")
    bucket = F.concat(name("bucket"), _labelled(labels, F.concat(F.lit('le="'), bound, F.lit('"'))), F.lit(" "), F.col("count").cast("string"))
    total = F.when(last, F.concat(name("sum"), _labelled(labels), F.lit(" "), F.format_string("%.3f", r3("sum"))))
    n = F.when(last, F.concat(name("count"), _labelled(labels), F.lit(" "), F.col("n").cast("string")))
    return hist.select(F.explode(F.array(bucket, total, n)).alias("line")).where("line IS NOT NULL")


def gauge_lines(gauges: DataFrame, prefix: str) -> DataFrame:
    """(line): one for each column of a single row; whole numbers as they are, others with three decimals."""
    whole = {f.name: f.dataType.typeName() in ("long", "integer") for f in gauges.schema}
    text = lambda c: F.col(c).cast("string") if whole[c] else F.format_string("%.3f", r3(c))
    return gauges.select(F.explode(F.array(*[F.concat(F.lit(f"{prefix}_{c} "), text(c)) for c in gauges.columns])).alias("line"))
