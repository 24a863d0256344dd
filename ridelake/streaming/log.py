"""Topics as logs with offsets: records numbered within partitions, read from any offset or moment on, as tables and as streams.

``append`` writes one batch of records and then its commit, a small file that says for each partition which offsets the batch holds, from
when to when, and how many bytes. Only committed batches are seen. A key's records are in one partition, in order of time within a batch.

``spark.read.format("topic_log")`` and ``spark.readStream.format("topic_log")`` (after ``register``) give (partition, offset, key, value, timestamp).
Options: ``from``: earliest, latest, a moment (``2024-01-02T03:04:05Z``: in each partition the first record that is not older), or JSON of offsets by
partition; for tables ``until``, the same, exclusive (latest); for streams ``least_bytes`` (0) and ``wait_s`` (10): a batch is
held back until it has so many bytes or the first of it has waited so long, and ends with the batch that reaches them. A partition is one task, so a key
stays in order. A stream resumes from the offsets in its checkpoint; a new checkpoint with another ``from`` is a replay.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import datasource as D
from pyspark.sql import functions as F


SCHEMA = "partition int, offset long, key string, value string, timestamp timestamp"
_ARROW = pa.schema([("partition", pa.int32()), ("offset", pa.int64()), ("key", pa.string()), ("value", pa.string()), ("timestamp", pa.timestamp("us", "UTC"))])


def append(made: DataFrame, path: str, partitions: int = 4) -> None:
    """Number records (key, value, timestamp) behind those of a log and commit them. The first append fixes the number of partitions.

    Writers take turns: a second one that numbers from the same end finds the commit's name taken and ends with an error, its records unseen.
    """
    commits = Log(path).commits()
    heads = _heads(commits)
    partitions = len(commits[0][1]) if commits else partitions
    folder = f"batch-{uuid.uuid4().hex}"
    rows = made.select("key", "value", F.col("timestamp").cast("timestamp").alias("timestamp"))
    rows = rows.withColumn("partition", F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int"))
    start = F.element_at(F.create_map(*[x for p in range(partitions) for x in (F.lit(p), F.lit(heads.get(p, 0)).cast("long"))]), F.col("partition"))
    order = Window.partitionBy("partition").orderBy("timestamp", "key", "value")
    numbered = rows.withColumn("offset", start + F.row_number().over(order) - 1)
    numbered.select("offset", "key", "value", "timestamp", "partition").write.partitionBy("partition").parquet(f"{path}/{folder}")
    written = made.sparkSession.read.schema(SCHEMA).parquet(f"{path}/{folder}")
    ms = F.unix_millis("timestamp")
    size = F.sum(F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0)))
    found = {r.partition: r for r in written.groupBy("partition").agg(F.min("offset").alias("a"), F.max("offset").alias("b"), F.min(ms).alias("t"), F.max(ms).alias("u"), size.alias("n")).collect()}
    entries = []
    for p in range(partitions):
        r, head = found.get(p), heads.get(p, 0)
        entries.append([p, r.a, r.b + 1, r.t, r.u, r.n, folder] if r else [p, head, head, None, None, 0, folder])
    _create(made.sparkSession, f"{path}/_log/{len(commits):012d}.json", json.dumps(entries))


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A new file; an error if there is one of this name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(place, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _heads(commits: list[tuple[str, list]]) -> dict[int, int]:
    return {e[0]: e[2] for _, entries in commits for e in entries}


class Log:
    """The commits of a log, each read once."""

    def __init__(self, path: str):
        self.path, self.known = path, {}

    def commits(self) -> list[tuple[str, list]]:
        fs, path = pa.fs.FileSystem.from_uri(self.path)
        for x in fs.get_file_info(pa.fs.FileSelector(f"{path}/_log", allow_not_found=True)):
            if x.base_name.endswith(".json") and x.base_name not in self.known:
                self.known[x.base_name] = json.loads(fs.open_input_file(x.path).read() or b"null")
        return [(k, v) for k, v in sorted(self.known.items()) if v]

    def seek(self, at: str) -> dict[str, int]:
        """Offsets by partition (as text, for JSON) of a place in the log."""
        commits = self.commits()
        heads = _heads(commits)
        if at == "latest":
            found = heads
        elif at == "earliest":
            found = dict.fromkeys(heads, 0)
        elif at.lstrip().startswith("{"):
            found = dict.fromkeys(heads, 0) | {int(k): int(v) for k, v in json.loads(at).items()}
        else:
            ms = round(datetime.fromisoformat(at).timestamp() * 1000)
            found = dict(heads)
            for _, entries in reversed(commits):
                for p, first, _, _, last_ms, _, folder in entries:
                    if last_ms is not None and last_ms >= ms:
                        found[p] = min(b.column("offset")[i].as_py() for b in self.records(folder, p, first, 1 << 62) for i, t in enumerate(b.column("timestamp").cast(pa.int64()).to_pylist()) if t // 1000 >= ms)
        return {str(p): o for p, o in sorted(found.items())}

    def pieces(self, start: dict, end: dict) -> list[Stretch]:
        """For each partition the stretches of batches between two places."""
        out = []
        for p, hi in end.items():
            lo = start.get(p, 0)
            held = [(e[6], max(lo, e[1]), min(hi, e[2])) for _, entries in self.commits() for e in entries if str(e[0]) == p and max(lo, e[1]) < min(hi, e[2])]
            if held:
                out.append(Stretch(int(p), held))
        return out

    def records(self, folder: str, partition: int, lo: int, hi: int):
        """Arrow batches of one partition of a batch, in order of offsets."""
        fs, path = pa.fs.FileSystem.from_uri(self.path)
        files = pa.dataset.dataset(f"{path}/{folder}/partition={partition}", filesystem=fs, format="parquet")
        for batch in files.to_batches(filter=(pa.dataset.field("offset") >= lo) & (pa.dataset.field("offset") < hi)):
            if batch.num_rows:
                columns = [pa.array([partition] * batch.num_rows, pa.int32()), *(batch.column(n) for n in _ARROW.names[1:])]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


@dataclass
class Stretch(D.InputPartition):
    """What one task reads: a partition, and (folder, first offset, end) of its batches."""

    partition: int
    batches: list[tuple[str, int, int]]


class TopicLog(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return TableReader(self.options)

    def streamReader(self, schema):
        return StreamReader(self.options)


class TableReader(D.DataSourceReader):
    def __init__(self, options):
        self.log, self.at, self.until = Log(options["path"]), options.get("from", "earliest"), options.get("until", "latest")

    def partitions(self):
        return self.log.pieces(self.log.seek(self.at), self.log.seek(self.until)) or [Stretch(0, [])]

    def read(self, partition: Stretch):
        for folder, lo, hi in partition.batches:
            yield from self.log.records(folder, partition.partition, lo, hi)


class StreamReader(D.DataSourceStreamReader):
    def __init__(self, options):
        self.log, self.at = Log(options["path"]), options.get("from", "earliest")
        self.least, self.wait = int(options.get("least_bytes", 0)), float(options.get("wait_s", 10))
        self.end: dict[str, int] | None = None
        self.since: float | None = None

    def initialOffset(self) -> dict:
        self.end = self.log.seek(self.at)
        return self.end

    def latestOffset(self) -> dict:
        if self.end is None:  # resumed: what a checkpoint holds is not told, so this batch takes what there is
            self.end = self.log.seek("latest")
            return self.end
        held, reach = 0, dict(self.end)
        for _, entries in self.log.commits():
            for p, first, behind, _, _, size, _ in entries:
                done = reach.get(str(p), 0)
                if behind > done:
                    held += size * (behind - max(first, done)) // max(1, behind - first)
                    reach[str(p)] = behind
            if self.least and held >= self.least:
                break
        if reach == self.end:
            self.since = None
            return self.end
        now = time.monotonic()
        self.since = now if self.since is None else self.since
        if held >= self.least or now - self.since >= self.wait:
            self.end, self.since = reach, None
        return self.end

    def partitions(self, start: dict, end: dict):
        return self.log.pieces(start, end)

    def read(self, partition: Stretch):
        for folder, lo, hi in partition.batches:
            yield from self.log.records(folder, partition.partition, lo, hi)

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TopicLog)


def offsets(spark: SparkSession, path: str, at: str) -> dict[int, int]:
    """The offset of each partition at a place: earliest, latest, or a moment."""
    return {int(p): o for p, o in Log(path).seek(at).items()}


def replay(spark: SparkSession, path: str, at: str = "earliest", until: str = "latest") -> DataFrame:
    """The records between two places as a table: the dry run of a replay, for ``topics.replay_difference``."""
    register(spark)
    return spark.read.format("topic_log").option("from", at).option("until", until).load(path)


def subscribe(spark: SparkSession, path: str, at: str = "earliest", least_bytes: int = 0, wait_s: float = 10.0) -> DataFrame:
    register(spark)
    return spark.readStream.format("topic_log").option("from", at).option("least_bytes", str(least_bytes)).option("wait_s", str(wait_s)).load(path)
