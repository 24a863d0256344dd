"""Least-cost ways over road graphs too large for one machine.

Nodes are dealt into cells of neighbouring identifiers. A task takes the edges of a cell and what has reached its
nodes, searches on inside the cell in order of cost, and hands what leaves it to the cells behind. So a round crosses a
whole cell, not one edge, and the number of rounds is that of cells on a way. Many sources are dealt into buckets, so a
task holds the edges of one cell and the labels of one source in it, whatever the number of sources or nodes.

``between`` answers pairs. It searches towards the goal: distances from and to a few landmarks, stored once for each node, bound
from below what is left of a way, and a label whose cost and bound are over the pair's limit goes no further. The limit
starts just above the bound for the whole way and is raised for pairs that it was too low for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from math import ceil, cos, inf, pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.operators.floods import by_stretch, routes
from ridelake.storage import counted, dropped, kept

#: Nodes of a cell, and sources that share a task.
CELL, SOURCES = 4096, 256
#: Room for rounding in sums of costs.
SLACK = 1 + 1e-9

_ROW = "cell long, bucket int, source long, kind int, a long, b long, cost double, via long, most double, ahead array<double>, back array<double>"
_LABEL = "cell long, source long, node long, cost double, via long, most double, goal boolean"
_EDGE, _GOAL, _KNOWN, _OPEN = range(4)


def by_identifier(node: Column) -> Column:
    return F.floor(node / CELL)


def landmarks(nodes: DataFrame, count: int = 8) -> list[int]:
    """Nodes at the rim: for each of ``count`` directions the farthest one, by lat and lon."""
    along = lambda k: F.col("lat") * cos(2 * pi * k / count) + F.col("lon") * sin(2 * pi * k / count)
    row = nodes.where("lat IS NOT NULL AND lon IS NOT NULL").agg(*[F.max_by("node_id", F.struct(along(k), F.col("node_id"))).alias(f"n{k}") for k in range(count)]).first()
    return sorted({x for x in row if x is not None})


def bounds(edges: DataFrame, marks: list[int], weight: str = "base_weight_s", cell: Callable[[Column], Column] = by_stretch) -> DataFrame:
    """(node, ahead, back): the costs from each landmark to a node and from the node to each, infinite where there is no way."""
    # both directions in one search: the second copy of the graph is turned round and has odd identifiers
    a, b, half = F.col("from_node"), F.col("to_node"), lambda c: F.floor(F.col(c) / 2)
    both = edges.select("edge_id", weight, F.explode(F.array(F.struct((a * 2).alias("from_node"), (b * 2).alias("to_node")), F.struct((b * 2 + 1).alias("from_node"), (a * 2 + 1).alias("to_node")))).alias("e"))
    start = edges.sparkSession.createDataFrame([(2 * m + back,) for m in marks for back in (0, 1)], "source long")
    found = routes(both.select("edge_id", weight, "e.*"), start, weight, lambda c: cell(F.floor(c / 2)) * 2 + F.pmod(c, F.lit(2)))
    found = found.select(half("source").alias("source"), half("node").alias("node"), "cost", (F.pmod("node", F.lit(2)) == 1).alias("back"))
    to = lambda back: F.map_from_entries(F.collect_list(F.when(F.col("back") == back, F.struct("source", "cost"))))
    by_node = found.groupBy("node").agg(to(False).alias("f"), to(True).alias("t"))
    array = lambda m: F.array(*[F.coalesce(F.try_element_at(m, F.lit(x).cast("long")), F.lit(inf)) for x in marks])
    return kept(by_node.select("node", array("f").alias("ahead"), array("t").alias("back")))


def least_rest(ahead: Column, back: Column, goal_ahead: Column, goal_back: Column) -> Column:
    """A lower bound of the cost from one node to another, infinite if there is no way."""
    gap = lambda x, y: F.array_max(F.filter(F.zip_with(x, y, lambda p, q: F.when(p < inf, q - p)), lambda d: d.isNotNull()))
    return F.greatest(F.lit(0.0), gap(ahead, goal_ahead), gap(goal_back, back))


def between(
    edges: DataFrame, pairs: DataFrame, near: DataFrame, weight: str = "base_weight_s", within: float = 1.0, cell: Callable[[Column], Column] = by_identifier
) -> tuple[DataFrame, DataFrame]:
    """The distinct pairs (from_node, to_node) of ``pairs`` with pair_id and cost (null without a way), and the labels (source: the pair,
    node, cost, via) from which ``roads.route_edges`` takes the edges.

    ``near``: the table of ``bounds`` for weights of which none is above the present one, so bounds for free flow hold under traffic.
    ``within``: 1 for least costs; with a larger one the first way is taken that costs at most so many times the lower bound, and so the least cost.
    """
    asked = pairs.select(F.col("from_node").cast("long"), F.col("to_node").cast("long")).where("from_node IS NOT NULL AND to_node IS NOT NULL").distinct()
    asked = kept(asked.withColumn("pair_id", F.monotonically_increasing_id()))
    near = _filled(near)
    placed = asked
    for end in ("from_node", "to_node"):
        placed = placed.join(near(end, f"{end}_ahead", f"{end}_back"), end, "left")
    full = lambda c: F.coalesce(F.col(c), near.none)
    rest = least_rest(full("from_node_ahead"), full("from_node_back"), full("to_node_ahead"), full("to_node_back"))
    goals = asked.select("pair_id").limit(0)
    placed = placed.select("pair_id", "from_node", "to_node", full("to_node_ahead").alias("ahead"), full("to_node_back").alias("back"), rest.alias("rest"))
    open_ = kept(placed.where("rest < double('infinity')"))
    steps = _steps(edges, weight, cell, near)
    done, labels = goals.withColumn("cost", F.lit(0.0)), None
    # what is not found below a limit costs more, so a way below the next limit is within the factor between the two
    limits = [(1.2, 1.0), (inf, 1.0)] if within <= 1 else [(min(1.2, within), within), (within, within), (inf, 1.0)]
    for limit, factor in limits:
        bound = F.lit(inf) if limit == inf else F.col("rest") * limit * SLACK
        goals = open_.select(F.col("pair_id").alias("source"), F.col("to_node").alias("target"), "ahead", "back")
        start = open_.select(F.col("pair_id").alias("source"), F.col("from_node").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("via"), bound.alias("most"))
        found = _searched(steps, start, goals, cell, factor)
        ends = found.select(F.col("source").alias("pair_id"), F.col("node").alias("to_node"), "cost")
        reached = kept(open_.join(ends, ["pair_id", "to_node"]).select("pair_id", "cost"))
        labels = found if labels is None else labels.join(open_.select(F.col("pair_id").alias("source")), "source", "left_anti").unionByName(found)
        done = done.unionByName(reached)
        open_, seen = counted(open_.join(reached.select("pair_id"), "pair_id", "left_anti"), n=F.count("*"))
        if not seen["n"]:
            break
    return asked.join(done, "pair_id", "left"), labels


class _filled:
    """The table of bounds under other names, and the bounds of a node that no landmark reaches or is reached from."""

    def __init__(self, near: DataFrame):
        size = near.select(F.size("ahead")).first()
        self.table, self.none = near, F.array_repeat(F.lit(inf), size[0] if size else 0)

    def __call__(self, node: str, ahead: str, back: str) -> DataFrame:
        return self.table.select(F.col("node").alias(node), F.col("ahead").alias(ahead), F.col("back").alias(back))


def _steps(edges: DataFrame, weight: str, cell: Callable[[Column], Column], near: _filled | None = None) -> DataFrame:
    """The edges by cell, with the bounds of their ends."""
    e = edges.where(F.col(weight) < inf).select(
        cell(F.col("from_node")).alias("cell"), F.col("from_node").cast("long").alias("a"), F.col("to_node").cast("long").alias("b"), F.col(weight).cast("double").alias("cost"), F.col("edge_id").cast("long").alias("via")
    )
    if near is not None:
        e = e.join(near("b", "ahead", "back"), "b", "left").withColumns({x: F.coalesce(x, near.none) for x in ("ahead", "back")})
    return kept(e)


def _searched(steps: DataFrame, start: DataFrame, goals: DataFrame | None, cell: Callable[[Column], Column], within: float = 1.0) -> DataFrame:
    """The labels (source, node, cost, via) that spread from ``start``, round by round."""
    c = F.col
    front, seen = counted((start if "most" in start.columns else start.withColumn("most", F.lit(inf))).select("source", "node", "cost", "via", "most"), n=F.count("*"))
    bucket = F.pmod(F.xxhash64("source"), F.lit(max(1, ceil(seen["n"] / SOURCES)))).cast("int")
    row = lambda df, kind, **more: df.select("cell", "bucket", *[(more[c] if c in more else F.lit(None)).cast(t).alias(c) for c, t in (f.rsplit(" ", 1) for f in _ROW.split(", ")[2:]) if c != "kind"], F.lit(kind).alias("kind"))
    names = [f.split()[0] for f in _ROW.split(", ")]
    best = F.min(F.struct("cost", F.coalesce("via", F.lit(-1)).alias("via"))).alias("m")
    rounds: list[DataFrame] = []
    known = front.limit(0)
    while seen["n"]:
        opened = front.withColumns({"cell": cell(c("node")), "bucket": bucket})
        who = opened.select("cell", "source").distinct()
        arrays = {"ahead": c("ahead"), "back": c("back")} if goals is not None else {}
        label = {"source": c("source"), "a": c("node"), "cost": c("cost"), "via": c("via")}
        known_here = known.withColumns({"cell": cell(c("node")), "bucket": bucket}).join(who, ["cell", "source"], "left_semi")
        rows = row(steps.join(opened.select("cell", "bucket").distinct(), "cell"), _EDGE, a=c("a"), b=c("b"), cost=c("cost"), via=c("via"), **arrays)
        rows = rows.unionByName(row(known_here, _KNOWN, **label)).unionByName(row(opened, _OPEN, most=c("most"), **label))
        if goals is not None:
            rows = rows.unionByName(row(goals.join(who, "source").withColumn("bucket", bucket), _GOAL, source=c("source"), b=c("target"), **arrays))
        rows = rows.repartition("cell", "bucket").sortWithinPartitions("cell", "bucket", F.asc_nulls_first("source"), "kind", "a")
        made = kept(rows.select(*names).mapInArrow(lambda batches: _spread(batches, within), _LABEL))
        rounds.append(made)
        leaving = made.where(cell(c("node")) != c("cell")).groupBy("source", "node").agg(best, F.min("most").alias("most")).select("source", "node", "m.cost", "m.via", "most")
        if goals is not None:  # a pair that has come to its goal goes no further, or only where that can still be cheaper
            got = made.where("goal").groupBy("source").agg(F.min("cost").alias("got"))
            leaving = leaving.join(got, "source", "left_anti" if within > 1 else "left")
            if within <= 1:
                leaving = leaving.select("source", "node", "cost", "via", F.least("most", c("got") * SLACK).alias("most")).where("cost <= most")
        known = known.unionByName(made.where(cell(c("node")) == c("cell")).select("source", "node", "cost", "via", "most"))
        front, seen = counted(leaving, n=F.count("*"))
    every = known if not rounds else rounds[0]
    for made in rounds[1:]:
        every = every.unionByName(made)
    out = kept(every.groupBy("source", "node").agg(best).select("source", "node", "m.cost", F.when(c("m.via") >= 0, c("m.via")).alias("via")))
    dropped(*rounds)
    return out


class _Cell:
    """The edges of a cell, in order of their first node."""

    def __init__(self, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches)
        a, self.b, self.w, self.via = (t.column(n).to_numpy() for n in ("a", "b", "cost", "via"))
        bounds_ = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)] if len(a) else []
        self.at = {int(a[i]): (i, j) for i, j in zip(bounds_, bounds_[1:], strict=False)}
        self.b, self.w, self.via = self.b.tolist(), self.w.tolist(), self.via.tolist()
        self.near = []
        for name in ("ahead", "back"):
            arrays = t.column(name).combine_chunks()
            flat = arrays.flatten().to_numpy(zero_copy_only=False)
            self.near.append(flat.reshape(len(a), -1) if len(a) and not arrays.null_count and len(flat) else None)

    def rest(self, ahead: list[float] | None, back: list[float] | None) -> list[float] | None:
        """For each edge a lower bound of the cost from its end to the goal."""
        if ahead is None or self.near[0] is None:
            return None
        with np.errstate(invalid="ignore"):
            gap = np.fmax(np.array(ahead) - self.near[0], self.near[1] - np.array(back))
            return np.fmax(np.nanmax(np.where(np.isnan(gap), -inf, gap), axis=1), 0.0).tolist()


def _on(cell: _Cell, known: dict, opened: list, goal: tuple | None, limit: float, within: float) -> dict:
    """{node: (cost, via)} of the labels that get better in one cell for one source, and none above ``limit``."""
    target, ahead, back = goal or (None, None, None)
    rest = cell.rest(ahead, back)
    out: dict = {}
    heap = []
    for node, cost, via in opened:
        if node not in known or cost < known[node][0]:
            known[node] = out[node] = (cost, via)
            heap.append((cost, cost, node))
    heapify(heap)
    while heap:
        _, cost, node = heappop(heap)
        if node == target and within > 1:
            break
        if cost > known[node][0] or cost > limit or node == target:
            continue
        for i in range(*cell.at.get(node, (0, 0))):
            b, far = cell.b[i], cost + cell.w[i]
            left = rest[i] if rest else 0.0
            if far + left > limit:
                continue
            was = known.get(b)
            if was is None or far < was[0]:
                known[b] = out[b] = (far, cell.via[i])
                if b == target and within <= 1:
                    limit = min(limit, far * SLACK)
                elif b in cell.at or b == target:
                    heappush(heap, (far + within * left, far, b))
            elif far == was[0] and was[1] is not None and cell.via[i] < was[1]:
                known[b] = out[b] = (far, cell.via[i])
    return out


def _spread(batches: Iterator[pa.RecordBatch], within: float) -> Iterator[pa.RecordBatch]:
    """One round: of each cell and bucket first the edges, then for each source its goal, what is known of it, and what has come."""
    place, edges, cell = None, [], None
    source, goal, known, opened, limit = None, None, {}, [], inf
    out: list[tuple] = []

    def closed():
        if source is not None:
            found = _on(cell, known, opened, goal, limit, within)
            out.extend((place[0], source, node, cost, via, limit, goal is not None and node == goal[0]) for node, (cost, via) in found.items())

    for batch in batches:
        keys = list(zip(batch.column("cell").to_pylist(), batch.column("bucket").to_pylist(), strict=True))
        sources, kinds, a, b, cost, via, most = (batch.column(n).to_pylist() for n in ("source", "kind", "a", "b", "cost", "via", "most"))
        i = 0
        while i < len(keys):
            if keys[i] != place:
                closed()
                place, edges, cell, source = keys[i], [], None, None
            if kinds[i] == _EDGE:
                j = i
                while j < len(keys) and keys[j] == place and kinds[j] == _EDGE:
                    j += 1
                edges.append(batch.slice(i, j - i))
                i = j
                continue
            cell = cell or _Cell(edges or [batch.slice(0, 0)])
            if sources[i] != source:
                closed()
                source, goal, known, opened, limit = sources[i], None, {}, [], inf
            if kinds[i] == _GOAL:
                goal = (b[i], batch.column("ahead")[i].as_py(), batch.column("back")[i].as_py())
            elif kinds[i] == _KNOWN:
                if a[i] not in known or cost[i] < known[a[i]][0]:
                    known[a[i]] = (cost[i], via[i])
            else:
                opened.append((a[i], cost[i], via[i]))
                limit = min(limit, most[i])
            i += 1
        if len(out) > 50_000:
            yield _labels(out)
            out.clear()
    closed()
    yield _labels(out)


def _labels(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 7
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cell", "source", "node", "cost", "via", "most", "goal"])
