"""Places that all executors share, and tables kept there to cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    A session on one machine that names none (a test) gets a temporary folder; on a cluster that would be each machine's own
    disk, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/ridelake-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, safe when executors are lost."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
    """``kept(df)``, and aggregates over its rows that are taken while it is written."""
    seen = Observation()
    table = kept(df.observe(seen, *[c.alias(name) for name, c in figures.items()]))
    return table, seen.get


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by ``kept`` that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
