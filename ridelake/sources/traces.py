"""Trip rows in Parquet, laid out by scenario and policy so that a query reads only the runs it asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridelake.schemas import TRIP_KEY, TRIPS


def conform(trips: DataFrame) -> DataFrame:
    """The columns of ``TRIPS`` in order; missing ones are null."""
    return trips.select(*[(F.col(f.name) if f.name in trips.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TRIPS])


def write(trips: DataFrame, path: str, mode: str = "append") -> None:
    conform(trips).write.mode(mode).partitionBy("scenario", "policy").parquet(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All trip rows below ``path``; files that cannot be read are passed over, as those of a crashed writer."""
    read = spark.read.schema(TRIPS).option("ignoreCorruptFiles", True).option("recursiveFileLookup", False)
    return read.parquet(path).select(*TRIPS.fieldNames())


def keys(spark: SparkSession, path: str) -> DataFrame:
    """What identifies the stored trips; only these columns are read."""
    return scan(spark, path).select(*TRIP_KEY)


def newest(spark: SparkSession, path: str, most: int) -> DataFrame:
    """What identifies the trips in the newest files below ``path``: files are taken from the last written one backwards, until
    they hold ``most`` trips."""
    read = spark.read.schema(TRIPS).option("ignoreCorruptFiles", True).parquet(path)
    rows = read.select(*TRIP_KEY, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_modification_time").alias("__at"))
    files = rows.groupBy("__file", "__at").count()
    before = Window.orderBy(F.desc("__at"), F.desc("__file")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    taken = files.withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).where(F.col("__before") < most)
    return rows.join(taken.select("__file"), "__file", "left_semi").select(*TRIP_KEY)
