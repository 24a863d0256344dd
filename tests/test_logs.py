"""Topic logs by offset, moment and bytes, and surge state that leaves."""

from __future__ import annotations

import json
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from ridelake.plans import streams
from ridelake.streaming import live, log, topics


def publish(spark, path, rows, partitions=3):
    made = spark.createDataFrame(rows, "key string, value string, ms long").repartition(2)
    log.append(made.select("key", "value", F.timestamp_millis("ms").alias("timestamp")), path, partitions)


def as_tuples(df):
    return sorted(tuple(x) for x in df.select("key", "value").collect())


def test_replay_from_offsets_and_moments(spark, tmp_path):
    path = f"file://{tmp_path}/trips"
    assert log.replay(spark, path).count() == 0
    first = [(f"k{i % 7}", f"a{i}", 1_700_000_000_000 + i * 1000) for i in range(40)]
    publish(spark, path, first)
    publish(spark, path, [])
    second = [(f"k{i % 7}", f"b{i}", 1_700_000_040_000 + i * 1000) for i in range(40)] + [("k1", None, 1_700_000_099_000)]
    publish(spark, path, second)
    whole = log.replay(spark, path).orderBy("partition", "offset").collect()
    by = {}
    for x in whole:
        by.setdefault(x.partition, []).append(x)
    assert sorted((x.key, x.value or "") for x in whole) == sorted((k, v or "") for k, v, _ in first + second)
    for held in by.values():  # numbered without gaps, in order of time
        assert [x.offset for x in held] == list(range(len(held))) and [x.timestamp for x in held] == sorted(x.timestamp for x in held)
    assert len({x.partition for x in whole if x.key == "k3"}) == 1
    heads = log.offsets(spark, path, "latest")
    assert heads == {p: len(by.get(p, [])) for p in range(3)} and log.offsets(spark, path, "earliest") == dict.fromkeys(range(3), 0)
    # a moment between two records of one file gives exactly the later ones
    for ms in (1_700_000_017_500, 1_700_000_040_000, 1_700_000_063_001):
        at = time.strftime("%Y-%m-%dT%H:%M:%S", time.gmtime(ms // 1000)) + f".{ms % 1000:03d}+00:00"
        assert as_tuples(log.replay(spark, path, at).fillna("")) == sorted((k, v or "") for k, v, t in first + second if t >= ms)
        assert as_tuples(log.replay(spark, path, "earliest", at)) == sorted((k, v) for k, v, t in first + second if t < ms)
    some = json.dumps({p: n - 2 for p, n in heads.items() if n > 2})
    assert log.replay(spark, path, some).count() == sum(min(n, 2) for n in heads.values())
    changes = topics.replay_difference(log.replay(spark, path).select("partition", "offset", "value"), log.replay(spark, path, "earliest", some).select("partition", "offset", "value"), ["partition", "offset"])
    assert {x.change for x in changes.collect()} == {"added"} and changes.count() == log.replay(spark, path, some).count()


def test_a_second_writer_at_the_same_end_is_refused(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    publish(spark, path, [("a", "1", 1)])
    old = log.Log(path).commits()
    publish(spark, path, [("a", "2", 2)])
    monkeypatch.setattr(log.Log, "commits", lambda self: old)
    with pytest.raises(Exception, match="exist"):
        publish(spark, path, [("a", "3", 3)])
    monkeypatch.undo()
    assert as_tuples(log.replay(spark, path)) == [("a", "1"), ("a", "2")]


def test_streams_begin_anywhere_and_resume(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    publish(spark, path, [("a", "old", 1000), ("b", "new", 5000)])

    def drained(name, at):
        query = log.subscribe(spark, path, at).writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{tmp_path}/{name}.ck").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return as_tuples(spark.table(name))

    assert drained("s1", "earliest") == [("a", "old"), ("b", "new")]
    assert drained("s2", "1970-01-01T00:00:02Z") == [("b", "new")]
    assert drained("s3", "latest") == []
    heads = json.dumps(log.offsets(spark, path, "latest"))
    publish(spark, path, [("c", "later", 9000)])
    assert drained("s4", heads) == [("c", "later")]
    out, ck = f"file://{tmp_path}/out", f"file://{tmp_path}/out.ck"
    for rows in ([], [("d", "last", 10_000)]):  # two runs on one checkpoint
        if rows:
            publish(spark, path, rows)
        query = log.subscribe(spark, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).start()
        query.processAllAvailable()
        query.stop()
    assert as_tuples(spark.read.parquet(out)) == [("a", "old"), ("b", "new"), ("c", "later"), ("d", "last")]


def test_batches_wait_for_bytes_or_time(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for i in range(4):
        publish(spark, path, [("key", "x" * 97, i)], partitions=1)
    reader = log.StreamReader({"path": path, "least_bytes": "150", "wait_s": "0.3"})
    assert reader.initialOffset() == {"0": 0}
    assert reader.latestOffset() == {"0": 2} and reader.latestOffset() == {"0": 4}
    publish(spark, path, [("key", "y", 9)], partitions=1)
    assert reader.latestOffset() == {"0": 4}  # four bytes are not enough
    time.sleep(0.35)
    assert reader.latestOffset() == {"0": 5} and reader.latestOffset() == {"0": 5}
    assert log.StreamReader({"path": path, "least_bytes": "1000"}).latestOffset() == {"0": 5}


def test_surge_state_leaves(spark, tmp_path):
    """A cell that is back at 1, and one whose ticks stop above 1, are forgotten; the latter is reported at 1 first."""
    ticks = [("back", 10.0, 3.0), ("stops", 20.0, 2.0), ("back", 30.0, 1.0), ("back", 700.0, 1.0), ("late", 5000.0, 1.0), ("late", 9000.0, 1.0)]
    path = f"file://{tmp_path}/ticks"
    for i in range(0, 6, 1):
        spark.createDataFrame(ticks[i : i + 1], "cell string, ts double, raw double").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    stream = live.surge_stream(spark.readStream.schema("cell string, ts double, raw double").option("maxFilesPerTrigger", 1).parquet(path))
    query = stream.writeStream.format("memory").queryName("gone").outputMode("append").option("checkpointLocation", f"{path}.ck").start()
    try:
        query.processAllAvailable()
        states = query.lastProgress.stateOperators[0].numRowsTotal
    finally:
        query.stop()
    got = sorted((x.cell, x.ts, round(x.surge, 6)) for x in spark.table("gone").collect())
    assert ("stops", 20.0, 2.0) in got and ("stops", 1280.0, 1.0) in got and ("back", 10.0, 3.0) in got
    assert [x for x in got if x[0] == "back"][-1][2] == 1.0 and not [x for x in got if x[0] == "late"]
    assert states == 1  # the cell that has just ticked


def test_matches_fall_into_the_minutes_of_the_sql(spark, tmp_path):
    """Milliseconds are rounded, so a match in the last half millisecond belongs to the next minute; minutes are cut towards 1970."""
    con = duckdb.connect()
    parts = [1_704_067_379_999_499, 1_704_067_379_999_500, 1_704_067_380_000_000, -120_000_001, -60_000_500, -60_000_499, -59_999_500, -59_999_499, -1, 0, 59_999_999, 60_000_000]
    rows = ", ".join(f"({i}, make_timestamp({us}), {i}, 'click')" for i, us in enumerate([*parts, *parts[:5]]))
    con.sql(f"COPY (FROM (VALUES {rows}, (30, NULL, 3, 'click'), (31, make_timestamp(5), 3, 'view')) t(event_id, ts, user_id, event_type)) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(streams.SQL["match_rate"]).fetchall()
    got = streams.match_rate(spark, str(tmp_path)).select("policy", "minute_ms", "matches").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
