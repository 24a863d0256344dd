"""Floods by large cells against plain shortest paths."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_search import frames, plain, plain_components, street_grid

from ridelake import storage
from ridelake.operators import components, floods, matching, roads, search


def test_few_tables_for_a_graph_that_a_task_can_hold(spark, monkeypatch):
    """A street of 20 000 nodes was crossed in five cells of 4096, with two tables for each."""
    n, made, real = 20_000, [], storage.kept
    for module in (storage, floods, search):
        monkeypatch.setattr(module, "kept", lambda df: made.append(1) or real(df))
    i = F.col("id")
    street = spark.range(n - 1).select(i.alias("edge_id"), i.alias("from_node"), (i + 1).alias("to_node"), (1 + i % 3).cast("double").alias("base_weight_s"))
    found = roads.routes(street, spark.createDataFrame([(0,), (n - 100,)], "source long"))
    assert len(made) <= 5
    got = found.groupBy("source").agg(F.count("*"), F.max("cost"))
    assert rows(got) == [(0, n, float(sum(1 + k % 3 for k in range(n - 1)))), (n - 100, 100, float(sum(1 + k % 3 for k in range(n - 100, n - 1))))]


@pytest.mark.parametrize("turned", [False, True])
def test_pairs_share_the_floods_of_the_end_with_fewer_nodes(spark, turned):
    """In cells of 60 nodes, with goals that can't be reached, that are not there, and that are where they start."""
    width, r = 20, random.Random(5)
    edges = street_grid(width, keep=0.8)
    e, _ = frames(spark, edges, width)
    e = e.withColumn("edge_id", F.col("edge_id") - 700)
    ends = [3, 390, 401, 9999]
    asked = [(a, r.randrange(width * width)) for a in ends for _ in range(12)] + [(3, 3), (3, 402), (9999, 9999), (390, -7)]
    asked = [(b, a) if turned else (a, b) for a, b in asked]
    best = {a: plain(edges, a) for a, _ in asked}
    pairs = spark.createDataFrame([*asked, asked[0], (None, 3), (3, None)], "from_node long, to_node long")
    made = floods.costs(e, pairs, "base_weight_s", cell=lambda node: F.floor(node / 60))
    assert rows(made) == sorted({(a, b, best[a].get(b)) for a, b in asked}, key=repr)


def test_last_edges_lead_back(spark):
    """Over many cells, with edges of negative numbers and many equal costs."""
    width = 12
    edges = [(i, a, b, float(10 + w % 3)) for i, (_, a, b, w) in enumerate(street_grid(width))]
    e, _ = frames(spark, edges, width)
    e = e.withColumn("edge_id", F.col("edge_id") - 300)
    found = roads.routes(e, spark.createDataFrame([(0,)], "source long"), cell=lambda node: F.floor(node / 30)).collect()
    best = plain(edges, 0)
    smallest = {b: min((i - 300 for i, x, y, w in edges if y == b and x in best and best[x] + w == best[b]), default=None) for b in best}
    assert {x.node: (x.cost, x.via) for x in found} == {b: (c, smallest[b] if b else None) for b, c in best.items()}


def test_routed_without_bounds(spark):
    """The same costs as towards the goal."""
    e = spark.createDataFrame([(0, 1, 2, 900.0), (1, 2, 0, 900.0), (2, 3, 0, 40.0), (3, 4, 3, 20.0), (4, 0, 5, 10.0)], "edge_id long, from_node long, to_node long, weight_s double")
    requests = spark.createDataFrame([(100, 0), (101, 0)], "request_id long, pickup_node long")
    drivers = spark.createDataFrame([(1, 1, None, None), (2, 3, None, None), (3, 4, 3, 0.75), (4, 5, None, None)], "driver_id long, node long, edge_id long, progress double")
    asked = spark.createDataFrame([(r, d, d) for r in (100, 101) for d in (1, 2, 3, 4)], "request_id long, driver_id long, rank int")
    near = search.bounds(e, [0, 1], "weight_s")
    assert rows(matching.routed(asked, requests, drivers, e)) == rows(matching.routed(asked, requests, drivers, e, near))


@pytest.mark.parametrize("nodes_of_a_cell", [7, 40, 1000])
def test_components_across_cells(spark, nodes_of_a_cell):
    """Parts inside a cell, parts through several, and what only leads in or out."""
    r, n = random.Random(4), 150
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(170)] + [(i, i + 1) for i in range(40, 60)] + [(60, 40), (5, 6), (6, 5), (149, 0)]
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "node_id long")
    e = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_id long, from_node long, to_node long")
    got = {x.node_id: x.component for x in components.strong_components(nodes, e, hops=2, cell=lambda c: F.floor(c / nodes_of_a_cell)).collect()}
    assert got == plain_components(n + 2, pairs)


def test_few_tables_for_components_of_a_cell(spark, monkeypatch):
    """What a task can hold is decided by it."""
    made, real = [], storage.kept
    for module in (storage, components):
        monkeypatch.setattr(module, "kept", lambda df: made.append(1) or real(df))
    n, r = 300, random.Random(8)
    pairs = [(r.randrange(n), r.randrange(n)) for _ in range(400)]
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node_id long")
    e = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_id long, from_node long, to_node long")
    got = {x.node_id: x.component for x in components.strong_components(nodes, e).collect()}
    assert got == plain_components(n, pairs) and len(made) <= 5
