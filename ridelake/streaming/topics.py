"""Topics of the event bus: a folder of files for each, or Kafka where its connector is installed.

Reading is at least once and in order within a key, as with a broker. A file-backed topic
can be read from its beginning, from now, or from a moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridelake.schemas import fields

#: What a topic's files hold, like a broker's records.
RECORDS = fields("key STRING, value STRING, timestamp TIMESTAMP")
DEAD = "dead."


def partition_key(kind: str, id_: str | Column) -> Column:
    """``trip:<id>``, ``driver:<id>`` or ``cell:<name>``: what keeps a thing's events in order."""
    return F.concat(F.lit(f"{kind}:"), (F.col(id_) if isinstance(id_, str) else id_).cast("string"))


def records(events: DataFrame, key: Column, timestamp: Column) -> DataFrame:
    """Events as records: all columns as JSON under a key."""
    return events.select(key.alias("key"), F.to_json(F.struct(*events.columns)).alias("value"), timestamp.cast("timestamp").alias("timestamp"))


def publish(made: DataFrame, base: str, topic: str, partitions: int = 4) -> None:
    """Append records to a topic; records of a key go to one file, in order of time."""
    dealt = made.repartition(partitions, "key").sortWithinPartitions("key", "timestamp")
    dealt.write.mode("append").parquet(f"{base}/{topic}")


def publish_kafka(made: DataFrame, topic: str, servers: str, checkpoint: str):  # needs the connector
    """Write a stream of records to a broker, acknowledged by all replicas."""
    out = made.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    return out.option("kafka.acks", "all").option("kafka.linger.ms", "50").option("checkpointLocation", checkpoint).start()


def subscribe(spark: SparkSession, base: str, topic: str, max_files: int | None = None, since: str | None = None) -> DataFrame:
    """A stream of a topic's records from its beginning; ``since`` leaves out files written before a moment
    (``yyyy-MM-ddTHH:mm:ss``), which replays from there with a new checkpoint."""
    reader = spark.readStream.schema(RECORDS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if since:
        reader = reader.option("modifiedAfter", since)
    return reader.parquet(f"{base}/{topic}")


def replay(spark: SparkSession, base: str, topic: str) -> DataFrame:
    """All records of a topic as a table."""
    return spark.read.schema(RECORDS).parquet(f"{base}/{topic}")


def replay_difference(replayed: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): what storing a replay would do. ``added`` rows are in the replay alone, ``missing`` ones in the store alone,
    ``changed`` ones in both with other values. Rows with equal keys are told apart by their values; nothing is written."""
    tally = lambda df, side: df.select(*keys, F.xxhash64(*sorted(c for c in df.columns if c not in keys)).alias("__h"), F.lit(side).alias("__side"))
    both = tally(replayed, 1).unionByName(tally(stored, -1)).groupBy(*keys, "__h").agg(F.sum("__side").alias("d")).where("d != 0")
    sides = both.groupBy(*keys).agg(F.max("d").alias("most"), F.min("d").alias("least"))
    change = F.when((F.col("most") > 0) & (F.col("least") < 0), "changed").when(F.col("most") > 0, "added").otherwise("missing")
    return sides.select(*keys, change.alias("change"))


def decode(rows: DataFrame, schema: StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(decoded, dead): rows whose ``value`` is JSON of the schema, with its fields, and the others unchanged."""
    # a field of its own catches what can't be parsed; a value may be an object without any known field
    marked = StructType([*schema.fields]).add("__broken", "string")
    parsed = rows.withColumn("__p", F.from_json(F.col(value), marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}))
    broken = F.col("__p").isNull() | F.col("__p.__broken").isNotNull() | F.col(value).isNull()
    keep = [c for c in rows.columns if c not in schema.fieldNames()]
    good = parsed.where(~broken).select(*keep, *[F.col(f"__p.{f.name}").alias(f.name) for f in schema])
    return good, parsed.where(broken).select(*rows.columns)
