"""What the operators of this subpackage share: tables, shared storage, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name of the column of documents that holds the text, and of its identifier.
ID, TEXT = "doc_id", "text"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint folder.

    Only a session on one machine that names no such folder (a test) gets a
    temporary one; on a cluster that would be each machine's own disk, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/ridelake-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, n: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, survives lost executors and is computed once however
    often it is read. ``n``: files to write, as it comes by default.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    (df if n is None else df.coalesce(n)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the folder of a table made by ``stored`` that no later step reads."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def ascii_lower(col):
    """Lower-case A-Z only, as the contracts on hosts and words ask."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slices(batches, limit: int = 8 << 20):
    """Arrow batches cut so that each has about ``limit`` bytes at most.

    A batch of very long texts would otherwise need memory in proportion to
    the number of rows Spark puts into it.
    """
    for batch in batches:
        rows = max(1, min(batch.num_rows, int(batch.num_rows * limit / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str = TEXT) -> list[str]:
    """The texts of a batch; a null counts as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def schema_with(df: DataFrame, keep: list[str], **added: str) -> T.StructType:
    """The fields ``keep`` of ``df`` and then the added ones, given as name=type."""
    out = T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in keep])
    for name, kind in added.items():
        out = out.add(T.StructField(name, T.DataType.fromDDL(kind), True))
    return out
