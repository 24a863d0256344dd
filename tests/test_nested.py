"""Nested cells: every level is divided among its parents, shapes lie where they should, sets of cells shrink and spread again."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ridelake.functions import geo
from ridelake.operators import nested


def test_parents_and_children(spark):
    r = random.Random(6)
    names = [f"174/{r.randrange(1, 6)}:{r.randrange(-10**9, 10**9)}:{r.randrange(-10**9, 10**9)}" for _ in range(100)] + ["174/1:0:0"]
    df = spark.createDataFrame([(x,) for x in names], "cell string")
    below = df.select("cell", F.explode(nested.children("cell")).alias("child"))
    assert below.select("child").distinct().count() == 7 * len(names)
    assert below.where(nested.parent("child") != F.col("cell")).count() == 0
    # every cell of a patch has one parent, and every inner parent seven of them
    patch = spark.createDataFrame([(f"174/0:{q}:{s}",) for q in range(-20, 21) for s in range(-20, 21)], "cell string")
    counts = patch.groupBy(nested.parent("cell").alias("p")).count()
    inner = counts.select("count", *[nested.middle("p")[c].alias(c) for c in ("lat", "lon")]).where(geo.planar("lat", "lon", F.lit(geo.CENTRE[0]), F.lit(geo.CENTRE[1])) < 3500)
    assert {x["count"] for x in inner.collect()} == {7} and inner.count() > 20 and counts.agg(F.max("count")).first()[0] == 7
    up = df.select(nested.parent("cell", 3), nested.parent(nested.parent(nested.parent("cell"))), nested.parent("cell", 0), "cell").collect()
    assert all(a == b and c == d for a, b, c, d in up)
    null = spark.range(1).select(*[f(F.lit(None).cast("string")) for f in (nested.parent, nested.children, nested.middle, nested.boundary)], nested.cell(F.lit(None).cast("double"), F.lit(1.0), 2)).first()
    assert list(null) == [None] * 5
    assert spark.range(1).select(nested.children(F.lit("174/0:1:2"))).first()[0] == []


def test_shapes(spark):
    """Middles of children lie a step from their parent's, the corners an edge; a position is near its cell's middle at every level."""
    r = random.Random(7)
    df = spark.createDataFrame([(37.76 + r.gauss(0, 0.2), -122.44 + r.gauss(0, 0.2)) for _ in range(200)], "lat double, lon double")
    for up in range(4):
        edge = 174 * 7 ** (up / 2)
        at = df.withColumn("cell", nested.cell("lat", "lon", up)).withColumn("m", nested.middle("cell"))
        assert at.select(F.max(geo.planar("lat", "lon", F.col("m.lat"), F.col("m.lon")))).first()[0] <= edge * 1.6
        corners = at.select("m", F.explode(nested.boundary("cell")).alias("b")).select(geo.planar("m.lat", "m.lon", "b.lat", "b.lon").alias("d"))
        assert corners.count() == 1200 and corners.agg(F.min("d"), F.max("d")).first() == pytest.approx((edge, edge))
        if up:
            inner = at.select("m", F.posexplode(nested.children("cell"))).select("pos", "m", nested.middle("col").alias("c"))
            d = inner.groupBy(F.col("pos") > 0).agg(F.min(x := geo.planar("m.lat", "m.lon", "c.lat", "c.lon")), F.max(x)).collect()
            step = edge / 7**0.5 * 3**0.5
            assert sorted((round(a, 3), round(b, 3)) for _, a, b in d) == [(0, 0), (round(step, 3), round(step, 3))]
    # level 0 is the plain cell
    plain = df.select(nested.cell("lat", "lon"), geo.cell("lat", "lon", 174.0)).collect()
    assert all(a == "174/0:" + b.split(":", 1)[1] for a, b in plain)


def test_sets_of_cells(spark):
    big = spark.createDataFrame([("174/3:5:-7",)], "cell string")
    fine = nested.spread(big)
    assert fine.distinct().count() == 343
    more = fine.unionByName(fine.limit(3)).unionByName(spark.createDataFrame([("174/0:900:1",), (None,)], "cell string"))
    assert rows(nested.compacted(more)) == [("174/0:900:1",), ("174/3:5:-7",)]
    lost = fine.where(F.col("cell") != fine.first().cell)
    small = nested.compacted(lost)
    assert small.count() == 18 and rows(nested.spread(small)) == rows(lost)
    assert nested.compacted(big.limit(0)).count() == 0 and nested.spread(big.limit(0)).count() == 0


def test_sums_of_every_level(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(37.7 + r.random() / 10, -122.5 + r.random() / 10) for _ in range(500)] + [(None, 1.0)], "lat double, lon double")
    counts = df.groupBy(nested.cell("lat", "lon").alias("c")).count()
    got = {(x.level, x.cell): (x["count"], x.cells) for x in nested.rolled_up(counts, "c", "count", 3).collect()}
    for up in range(4):
        want = {x.c: x["count"] for x in df.where("lat IS NOT NULL").groupBy(nested.cell("lat", "lon", up).alias("c")).count().collect()}
        assert {c: n for (level, c), (n, _) in got.items() if level == up} == want
