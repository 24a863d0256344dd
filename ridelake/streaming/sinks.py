"""Sinks of streams: idempotent trip files, dead letters, snapshots.

A batch is written under its own number, so one that is tried again after a failure replaces what it wrote before.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ridelake.schemas import TRIP_KEY, TRIPS
from ridelake.sources import traces
from ridelake.streaming.topics import DEAD, decode


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def append_new(batch: DataFrame, path: str, batch_id: int) -> None:
    """Write the trips of a batch that no earlier batch and no other writer has stored.

    ``path`` holds a folder ``batch=<n>`` for each; the batch's own folder does not count as stored, so a second try gives
    the same result. Within it trips lie by the hour of their dropoff, which is part of what identifies them (hour 0 for those
    without). So only the key columns of the hours that the batch touches are read, however long the store has grown.
    """
    spark = batch.sparkSession
    new = traces.conform(batch).dropDuplicates(TRIP_KEY).withColumn("hour", F.coalesce(F.floor(F.col("dropoff_ts_unix_ms") / 3_600_000), F.lit(0)).cast("long"))
    if _exists(spark, path):
        hours = [r[0] for r in new.select("hour").distinct().collect()]  # a stream's batch holds few
        stored = spark.read.schema(StructType([*TRIPS.fields, StructField("batch", LongType()), StructField("hour", LongType())])).option("ignoreCorruptFiles", True)
        known = stored.parquet(path).where((F.col("batch") != batch_id) & F.col("hour").isin(hours)).select(*TRIP_KEY)
        same = [new[c].eqNullSafe(known[c]) for c in TRIP_KEY]
        new = new.join(known, same, "left_anti")
    new.write.mode("overwrite").partitionBy("hour").parquet(f"{path}/batch={batch_id}")


def retried(write: Callable[[], None], tries: int | None = None, first_s: float = 0.1, most_s: float = 5.0) -> None:
    """Call ``write`` until it succeeds, waiting twice as long each time. It goes on for ever unless ``tries`` is given; then the
    last failure is the batch's."""
    wait = first_s
    for i in count():
        try:
            return write()
        except Exception:
            if tries is not None and i == tries - 1:
                raise
            time.sleep(wait)
            wait = min(2 * wait, most_s)


def trip_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store a stream of trips, each once, whatever is delivered again."""

    def each(batch: DataFrame, batch_id: int) -> None:
        retried(lambda: append_new(batch, path, batch_id))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decoded_sink(stream: DataFrame, schema: StructType, base: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Write a topic's decoded events below ``base``, and those that can't be decoded, unchanged, to its dead letters."""

    def each(batch: DataFrame, batch_id: int) -> None:
        good, dead = decode(batch, schema)
        dead.write.mode("overwrite").parquet(f"{base}/{DEAD}{topic}/batch={batch_id}")
        good.write.mode("overwrite").parquet(f"{base}/{topic}.decoded/batch={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot_json(state: DataFrame, path: str) -> None:
    """Write a small live state (a row for each cell or driver) as one file of JSON lines, replacing the one before."""
    state.select(F.to_json(F.struct(*state.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def snapshot(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run an aggregated stream over what is there and return its last result.

    Every batch writes the whole result under its number; the last one is read.
    """
    last: list[int] = []

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{batch_id}")
        last.append(batch_id)

    query = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not last:
        return stream.sparkSession.createDataFrame([], stream.schema)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/{last[-1]}")
