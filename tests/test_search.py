"""Searches by cells against plain shortest paths."""

from __future__ import annotations

import heapq
import random
from math import inf

import pytest
from pyspark.sql import functions as F

from ridelake import storage
from ridelake.operators import components, matching, roads, search


def plain(edges, source):
    out = {}
    for _, a, b, w in edges:
        out.setdefault(a, []).append((b, w))
    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        cost, a = heapq.heappop(heap)
        if cost > best[a]:
            continue
        for b, w in out.get(a, ()):
            if cost + w < best.get(b, inf):
                best[b] = cost + w
                heapq.heappush(heap, (cost + w, b))
    return best


def street_grid(width, seed=1, keep=0.9):
    """(edge_id, a, b, w) of a grid of which some streets are missing in one direction, and a part that cannot be left."""
    r, edges = random.Random(seed), []
    for a in range(width * width):
        for b in (a + 1 if (a + 1) % width else None, a - 1 if a % width else None, a + width, a - width):
            if b is not None and 0 <= b < width * width and r.random() < keep:
                edges.append((len(edges), a, b, float(r.randrange(10, 30))))
    edges += [(len(edges), 0, width * width, 5.0), (len(edges) + 1, width * width, width * width + 1, 5.0)]
    return edges


def frames(spark, edges, width):
    e = spark.createDataFrame([(i, a, b, w) for i, a, b, w in edges], "edge_id long, from_node long, to_node long, base_weight_s double").repartition(3)
    nodes = spark.createDataFrame([(i, 37.7 + i // width * 0.003, -122.4 + i % width * 0.003) for i in range(width * width + 2)], "node_id long, lat double, lon double")
    return e, nodes


def in_strips(node):
    return F.floor(node / 120)


@pytest.mark.parametrize("cell", [search.by_identifier, in_strips])
def test_routes_equal_plain_search(spark, cell, monkeypatch):
    monkeypatch.setattr(search, "SOURCES", 2)
    width = 20
    edges = street_grid(width)
    e, _ = frames(spark, edges, width)
    found = search.routes(e.unionByName(e.limit(1).withColumn("base_weight_s", F.lit(inf))), spark.createDataFrame([(0,), (301,), (375,), (401,), (9999,), (0,)], "source long"), cell=cell)
    got = {}
    for x in found.collect():
        got.setdefault(x.source, {})[x.node] = x.cost
    assert got == {s: plain(edges, s) for s in (0, 301, 375, 401, 9999)}


@pytest.mark.parametrize("within", [1.0, 3.0])
def test_pairs_towards_the_goal(spark, within):
    width, cell = 24, lambda node: F.floor(node / 300)
    edges = street_grid(width, keep=0.85)
    e, nodes = frames(spark, edges, width)
    marks = search.landmarks(nodes)
    near = search.bounds(e, marks, cell=cell)
    r = random.Random(3)
    asked = [(r.randrange(width * width), r.randrange(width * width)) for _ in range(40)] + [(7, 7), (577, 0), (0, 577), (5, 12345), (None, 3)]
    pairs = spark.createDataFrame(asked + asked[:3], "from_node long, to_node long")
    best = {s: plain(edges, s) for s, _ in asked if s is not None}
    flood = sum(len(best[s]) for s, _ in asked[:40])
    costs, labels = search.between(e, pairs, near, within=within, cell=cell)
    got = {(x.from_node, x.to_node): (x.pair_id, x.cost) for x in costs.collect()}
    assert set(got) == {p for p in asked if p[0] is not None}
    for (s, t), (_, cost) in got.items():
        want = best[s].get(t)
        assert (cost is None) == (want is None) and (cost is None or want <= cost * (1 + 1e-9) <= want * within * (1 + 1e-8)), (s, t)
    assert labels.count() < flood / 3
    ends = costs.where("cost IS NOT NULL").select(F.col("pair_id").alias("source"), F.col("to_node").alias("target"))
    ways = {}
    for x in roads.route_edges(labels, e, ends).collect():
        ways.setdefault(x.source, {})[x.pos] = edges[x.edge_id]
    for (s, t), (pair, cost) in got.items():
        if cost and s != t:
            way = [ways[pair][i] for i in sorted(ways[pair], reverse=True)]
            assert way[0][1] == s and way[-1][2] == t and all(x[2] == y[1] for x, y in zip(way, way[1:], strict=False))
            assert sum(x[3] for x in way) <= cost * (1 + 1e-9)


def test_bounds_hold_and_know_where_there_is_no_way(spark):
    width = 8
    edges = street_grid(width, keep=0.7)
    e, nodes = frames(spark, edges, width)
    near = search.bounds(e, search.landmarks(nodes, 4))
    x, y = near.toDF("a", "fa", "ba"), near.toDF("b", "fb", "bb")
    made = x.crossJoin(y).select("a", "b", search.least_rest(F.col("fa"), F.col("ba"), F.col("fb"), F.col("bb")).alias("rest"))
    best = {n: plain(edges, n) for n in range(width * width + 2)}
    for p in made.collect():
        assert p.rest <= best[p.a].get(p.b, inf) * (1 + 1e-9)


def test_empty_searches(spark):
    e, _ = frames(spark, street_grid(4), 4)
    none = spark.createDataFrame([], "from_node long, to_node long")
    near = search.bounds(e, [0, 15])
    costs, labels = search.between(e, none, near)
    assert costs.count() == labels.count() == 0
    assert search.routes(e, none.select(F.col("from_node").alias("source"))).count() == 0
    assert search.routes(e.limit(0), spark.createDataFrame([(3,)], "source long")).collect()[0][:3] == (3, 3, 0.0)


def plain_components(n, pairs):
    """The largest node of each node's component, by reach in both directions."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def reach(a):
        seen, stack = {a}, [a]
        while stack:
            new = out.get(stack.pop(), set()) - seen
            seen |= new
            stack += new
        return seen

    to = [reach(a) for a in range(n)]
    return {a: max(b for b in to[a] if a in to[b]) for a in range(n)}


@pytest.mark.parametrize("seed", range(2))
def test_components_of_mixed_graphs(spark, seed):
    """Loops, loops on chains, two-way streets, chains that end, and a random middle."""
    r = random.Random(seed)
    n = 120
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range((50, 75, 110)[seed])]
    pairs += [(60 + i, 60 + (i + 1) % 9) for i in range(9)] + [(70 + i, 71 + i) for i in range(12)] + [(83 + i, 84 + i) for i in range(7)] + [(84 + i, 83 + i) for i in range(7)]
    pairs += [(95, 96), (96, 97), (97, 5), (5, 95), (100, 101), (101, 102), (102, 100), (102, 103), (103, 104), (104, 102), (65, 70), (82, 83), (90, 110), (110, 111), (111, 3)]
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node_id long")
    e = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_id long, from_node long, to_node long")
    got = {x.node_id: x.component for x in components.strong_components(nodes, e, hops=2).collect()}
    assert got == plain_components(n, pairs)


@pytest.mark.parametrize("both", [False, True])
def test_tables_grow_with_the_logarithm_of_a_chain(spark, both, monkeypatch):
    """A chain of dead ends numbered downwards, and one of streets in both directions."""
    made = []
    real = storage.kept
    for module in (storage, components):
        monkeypatch.setattr(module, "kept", lambda df: made.append(1) or real(df))
    counts = []
    for n in (30, 1000):
        made.clear()
        pairs = [(i + 1, i) for i in range(n)] + [(i, i + 1) for i in range(n) if both]
        nodes = spark.createDataFrame([(i,) for i in range(n + 1)], "node_id long")
        e = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_id long, from_node long, to_node long")
        got = {x.component for x in components.strong_components(nodes, e).collect()}
        assert got == ({n} if both else set(range(n + 1)))
        counts.append(len(made))
    assert counts[1] <= counts[0] + 14


def test_the_driver_that_is_there_first_by_road_is_taken(spark):
    """The nearest driver is across a river; one farther off has a street. A third is on an edge it must finish, a fourth cannot come."""
    e = [(0, 1, 2, 900.0), (1, 2, 0, 900.0), (2, 3, 0, 40.0), (3, 4, 3, 20.0), (4, 0, 5, 10.0)]
    e = spark.createDataFrame(e, "edge_id long, from_node long, to_node long, weight_s double")
    near = search.bounds(e, [0, 1], "weight_s")
    requests = spark.createDataFrame([(100, 0), (101, 0)], "request_id long, pickup_node long")
    drivers = spark.createDataFrame([(1, 1, None, None), (2, 3, None, None), (3, 4, 3, 0.75), (4, 5, None, None), (5, 0, None, None)], "driver_id long, node long, edge_id long, progress double")
    asked = spark.createDataFrame([(r, d, d) for r in (100, 101) for d in (1, 2, 3, 4)] + [(101, 5, 5)], "request_id long, driver_id long, rank int")
    made = matching.routed(asked, requests, drivers, e, near)
    got = {(x.request_id, x.driver_id): x.cost for x in made.collect()}
    assert got == {(r, d): c for r in (100, 101) for d, c in ((1, 1800.0), (2, 40.0), (3, 45.0))} | {(101, 5): 0.0}
    taken = matching.greedy_match(made.withColumn("batch", F.lit(1)).withColumn("request_ts", F.col("request_id")), ["batch"])
    assert sorted((x.request_id, x.driver_id) for x in taken.collect()) == [(100, 2), (101, 5)]
