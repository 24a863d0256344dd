"""Map files: packed numbers, blocks of other writers, round trips, files that are cut short."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from ridelake.operators import roads
from ridelake.sources import maps


def frame(name: bytes, blob: bytes) -> bytes:
    header = maps.message((1, name), (3, len(blob)))
    return len(header).to_bytes(4, "big") + header + blob


def test_known_bytes():
    """Numbers whose bytes are written out by hand."""
    assert list(maps.numbers(b"\x00\x01\x7f\x80\x01\xac\x02" + b"\xff" * 9 + b"\x01")) == [0, 1, 127, 128, 300, 2**64 - 1]
    assert list(maps.summed(b"\x02\x01\x04\x06")) == [1, 0, 2, 5]
    assert maps.packed([300, 0, 2**64 - 1]) == b"\xac\x02\x00" + b"\xff" * 9 + b"\x01"
    assert maps.message((1, 150), (2, b"testing")) == b"\x08\x96\x01\x12\x07testing"
    assert len(maps.numbers(b"")) == 0 and len(maps.summed(b"")) == 0
    values = np.array([5, -7, 2**40, -(2**62), 0], np.int64)
    assert list(maps.summed(maps.differences(values))) == list(values)


def test_reads_blocks_of_another_layout(spark, tmp_path):
    """Plain nodes, coarse steps with offsets, an unpacked blob, relations and unknown blobs between, pieces smaller than a blob."""
    zig = lambda v: (v << 1) ^ (v >> 63)
    node = maps.message((1, zig(-4)), (8, zig(37_000)), (9, zig(-122_000) & (2**64 - 1)))
    strings = maps.message((1, b""), (1, b"highway"), (1, "Straße".encode()))
    way = maps.message((1, 9), (2, b"\x01"), (3, b"\x02"), (8, maps.differences([-4, 12, 10])), (4, maps.message((1, 3))))
    relation = maps.message((4, maps.message((1, 77))))
    first = maps.message((1, strings), (2, maps.message((1, node))), (2, relation), (17, 1_000_000), (19, 500_000_000), (20, 2**64 - 250_000_000))
    second = maps.message((1, strings), (2, maps.message((3, way))), (2, b""))
    header = maps.message((4, b"OsmSchema-V0.6"), (5, b"Sort.Type_then_ID"))
    parts = [(b"OSMHeader", maps.message((1, header))), (b"OSMData", maps.message((1, first))), (b"Other", b"\x0a\x01x")]
    parts.append((b"OSMData", maps.message((2, len(second)), (3, zlib.compress(second)))))
    file = tmp_path / "a.osm.pbf"
    file.write_bytes(b"".join(frame(*p) for p in parts))
    for split in (1, 1 << 20):
        assert rows(maps.nodes(spark, f"file://{file}", split)) == [(-4, 37.5, -122.25)]
        assert rows(maps.ways(spark, f"file://{file}", split)) == [(9, [-4, 12, 10], {"highway": "Straße"})]
    assert maps.nodes(spark, f"file://{file}", 1).rdd.getNumPartitions() == 4


@pytest.mark.parametrize(("cut", "what"), [(-3, "ends within a blob"), (0, "HistoricalInformation")])
def test_faulty_files_are_errors(spark, tmp_path, cut, what):
    header = maps.message((4, b"HistoricalInformation"))
    data = frame(b"OSMHeader", maps.message((1, header)))
    (tmp_path / "a.pbf").write_bytes(data[: len(data) + cut])
    with pytest.raises(Exception, match=what):
        maps.nodes(spark, f"file://{tmp_path}").collect()


def test_round_trip_feeds_segments(spark, tmp_path, monkeypatch):
    """Written by several tasks and blocks, with odd rows: no tags, no nodes, a null value, negative identifiers, columns on top."""
    n = 20_000
    points = spark.range(n).select((F.col("id") - 5).alias("osm_id"), (37.5 + F.col("id") / 10_000_000).alias("lat"), (-122 - F.col("id") % 7 / 1000).alias("lon"), F.lit("x").alias("extra"))
    path = f"file://{tmp_path}/map"
    maps.write(points.repartition(3), path, "nodes")
    given = [(-3, [1, 2, 3], {"highway": "primary", "name": "東"}), (1, [], {}), (2, None, None), (3, [7], {"a": ""}), (2**62, [-5, 9, 1], {"highway": "service", "oneway": "yes"})]
    ways = spark.createDataFrame([*given, (4, [3, 1], {"highway": "x", "b": None})], maps.KINDS["ways"])
    maps.write(ways.repartition(2), path, "ways")
    assert rows(maps.nodes(spark, path, 1)) == rows(points.drop("extra"))
    want = [(a, b or [], c or {}) for a, b, c in given] + [(4, [3, 1], {"highway": "x"})]
    assert sorted((r[0], r[1], r[2]) for r in maps.ways(spark, path).collect()) == sorted(want)
    plain, found = (roads.segments(roads.drivable(w), p)[1] for w, p in ((ways.where("nodes IS NOT NULL"), points), (maps.ways(spark, path), maps.nodes(spark, path))))
    assert len(rows(found)) == 6 and rows(found) == rows(plain)


def test_empty_tables_and_missing_places(spark, tmp_path):
    path = f"file://{tmp_path}/empty"
    maps.write(spark.createDataFrame([], maps.KINDS["nodes"]), path, "nodes")
    assert maps.nodes(spark, path).count() == 0 and maps.ways(spark, path).count() == 0
    with pytest.raises(Exception, match="nodes need osm_id, lat, lon"):
        maps.write(spark.createDataFrame([(1, None, 2.0)], maps.KINDS["nodes"]), path, "nodes")
    assert maps.nodes(spark, path).count() == 0


def test_long_blocks_are_halved(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(maps, "MOST_BLOB", 2000)
    table = pa.table({"osm_id": np.arange(5000), "lat": np.linspace(0, 1, 5000), "lon": np.linspace(1, 0, 5000)})
    made = list(maps.blocks(table, "nodes"))
    back = np.concatenate([b["osm_id"].to_numpy() for m in made for b in maps.elements(m, "nodes")])
    assert len(made) > 1 and list(back) == list(range(5000))
