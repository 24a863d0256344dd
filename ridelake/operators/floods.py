"""Least costs from few places to very many, over road graphs too large for one machine.

Nodes are dealt into cells of neighbouring identifiers, as many as a task can hold. A task takes the edges of a cell and, source by source, the
labels with which the cell is entered, floods the cell with them and hands on what leaves it. Between rounds only these labels are
stored, those of nodes at the rims of cells; a cell is flooded again when it is entered at a lower cost. So there are about as many rounds as
cells on a way, a task holds the edges of one cell and the labels of one source in it, and a graph of one cell takes one round.

``routes`` then floods each cell a last time for all its nodes. ``costs`` answers pairs: they share the floods of the end
that has fewer distinct nodes, and a flood goes no further than the dearest of its goals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from math import ceil, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.storage import counted, kept, shared_dir

#: Nodes of a cell; sources for each task of a cell, as long as there are not more tasks than partitions; folders of edges.
CELL, SOURCES, PARTS = 1 << 18, 8, 64
#: Nodes that a flood takes one by one before it goes on in arrays: most of very many floods are small.
NEAR = 500

_ROW = "cell long, bucket int, source long, kind int, a long, b long, cost double, via long, there long"
_LABEL = "cell long, source long, node long, cost double, via long, goal boolean"
_EDGE, _BOUND, _GOAL, _OPEN = range(4)
#: In place of an edge: of a label that has none, because it starts there, and of one that is not known yet.
_START, _NONE = -(1 << 63), (1 << 63) - 1


def by_stretch(node: Column) -> Column:
    return F.floor(node / CELL)


def routes(edges: DataFrame, sources: DataFrame, weight: str = "base_weight_s", cell: Callable[[Column], Column] = by_stretch) -> DataFrame:
    """(source, node, cost, via): least cost from every source (column source) to every node it reaches, and the last edge.

    Of equal costs the smaller edge is taken. Edges of infinite weight are closed.
    """
    steps = _Steps(edges, weight, cell)
    entries = _rounds(steps, sources.select("source").distinct(), None, cell)
    best = entries.groupBy("cell", "source", "node").agg(F.min(F.struct("cost", "via")).alias("m")).select("cell", "source", "node", "m.cost", "m.via")
    best, seen = counted(best, n=F.count("*"))
    made = _flooded(steps, best.withColumn("bucket", steps.bucket(sources.select("source").distinct().count())), None, "all") if seen["n"] else best
    return kept(made.select("source", "node", "cost", F.when(F.col("via") != _START, F.col("via")).alias("via")))


def costs(edges: DataFrame, pairs: DataFrame, weight: str = "base_weight_s", cell: Callable[[Column], Column] = by_stretch) -> DataFrame:
    """(from_node, to_node, cost) of the distinct ``pairs`` without missing ends: the least cost, null without a way."""
    ends = [F.col(c).cast("long").alias(c) for c in ("from_node", "to_node")]
    asked = kept(pairs.select(*ends).where("from_node IS NOT NULL AND to_node IS NOT NULL").distinct())
    n = asked.agg(F.count_distinct("from_node"), F.count_distinct("to_node")).first()
    source, target = ("from_node", "to_node") if n[0] <= n[1] else ("to_node", "from_node")
    if source == "to_node":
        edges = edges.select("edge_id", weight, F.col("to_node").alias("from_node"), F.col("from_node").alias("to_node"))
    goals = asked.select(F.col(source).alias("source"), F.col(target).alias("target"))
    found = _rounds(_Steps(edges, weight, cell), asked.select(F.col(source).alias("source")).distinct(), goals, cell)
    found = found.groupBy(F.col("source").alias(source), F.col("node").alias(target)).agg(F.min("cost").alias("cost"))
    return asked.join(found, ["from_node", "to_node"], "left").select("from_node", "to_node", "cost")


class _Steps:
    """The edges by cell, in folders of which a round reads those of the cells that are entered."""

    def __init__(self, edges: DataFrame, weight: str, cell: Callable[[Column], Column]):
        spark = edges.sparkSession
        e = edges.where(F.col(weight) < inf).select(
            cell(F.col("from_node")).alias("cell"), F.col("from_node").cast("long").alias("a"), F.col("to_node").cast("long").alias("b"),
            F.col(weight).cast("double").alias("cost"), F.col("edge_id").cast("long").alias("via"), cell(F.col("to_node")).alias("there"),
        )
        path = shared_dir(spark)
        e = e.withColumn("part", F.pmod("cell", F.lit(PARTS)).cast("int"))
        e.repartition("part").write.partitionBy("part").parquet(path)
        self.table = spark.read.schema(e.schema).parquet(path)
        # a cell's edges go to each of its tasks, so there are no more tasks in all than partitions
        self.tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, self.table.select("cell").distinct().count()))

    def bucket(self, sources: int) -> Column:
        return F.pmod(F.xxhash64("source"), F.lit(max(1, min(ceil(sources / SOURCES), self.tasks)))).cast("int")

    def of(self, opened: DataFrame, parts: list[int]) -> DataFrame:
        return self.table.where(F.col("part").isin(parts)).join(opened.select("cell", "bucket").distinct(), "cell")


def _flooded(steps: _Steps, entries: DataFrame, goals: DataFrame | None, wanted: str, parts: list[int] | None = None) -> DataFrame:
    """Labels (cell, source, node, cost, via, goal) of the cells that are entered by ``entries`` (cell, bucket, source, node, cost, via, and most, the
    cost beyond which a label is of no use): of all nodes inside, or of goals and of nodes behind the rim."""
    fields = [f.split() for f in _ROW.split(", ")]

    def row(df: DataFrame, kind: int, **more: Column) -> DataFrame:
        """Nulls would turn whole numbers into doubles, so a row has none but an edge's source."""
        of = lambda c: more[c] if c in more else F.col(c) if c in df.columns else F.lit(kind if c == "kind" else None if c == "source" else 0)
        return df.select(*[of(c).cast(t).alias(c) for c, t in fields])

    rows = row(steps.of(entries, list(range(PARTS)) if parts is None else parts), _EDGE)
    rows = rows.unionByName(row(entries, _OPEN, a=F.col("node")))
    if goals is not None:
        who = entries.groupBy("cell", "bucket", "source").agg(F.min("most").alias("most"))
        rows = rows.unionByName(row(who, _BOUND, cost=F.coalesce("most", F.lit(inf))))
        rows = rows.unionByName(row(who.join(goals, ["cell", "source"]), _GOAL, a=F.col("target"), b=F.col("n")))
    dealt = rows.repartition("cell", "bucket").sortWithinPartitions("cell", "bucket", F.asc_nulls_first("source"), "kind")
    return dealt.mapInArrow(lambda batches: _spread(batches, wanted == "all"), _LABEL)


def _rounds(steps: _Steps, sources: DataFrame, goals: DataFrame | None, cell: Callable[[Column], Column]) -> DataFrame:
    """Without goals the labels (cell, source, node, cost, via) by which cells are entered, at least the best of each node; with
    ``goals`` (source, target) labels of these, at least the best."""
    c = F.col
    own = {"cell": F.pmod("cell", F.lit(PARTS))}
    start = sources.select(cell(c("source")).alias("cell"), c("source").cast("long").alias("source"), c("source").cast("long").alias("node"), F.lit(0.0).alias("cost"), F.lit(_START).alias("via"), F.lit(False).alias("goal"))
    front, seen = counted(start, n=F.count("*"), parts=F.collect_set(own["cell"]))
    bucket = steps.bucket(seen["n"])
    if goals is not None:
        n = goals.groupBy("source").agg(F.count("*").alias("n"))
        goals = kept(goals.join(n, "source").withColumn("cell", cell(c("target"))))
    fronts = [front]
    while seen["n"]:
        every = fronts[0]
        for f in fronts[1:]:
            every = every.unionByName(f)
        known = every.where("NOT goal").groupBy("cell", "source", "node").agg(F.min(F.struct("cost", "via")).alias("m")).select("cell", "source", "node", "m.cost", "m.via")
        entries = known.join(front.where("NOT goal").select("cell", "source").distinct(), ["cell", "source"], "left_semi").withColumn("bucket", bucket)
        if goals is not None:
            # once every goal of a source has a label, the dearest bounds what is of use
            got = every.where("goal").groupBy("source", "node").agg(F.min("cost").alias("cost")).groupBy("source").agg(F.count("*").alias("has"), F.max("cost").alias("dearest"))
            got = got.join(n, "source").where("has = n").select("source", "dearest")
            entries = entries.join(got, "source", "left").withColumnRenamed("dearest", "most")
        made = _flooded(steps, entries, goals, "rim", seen["parts"])
        best = made.groupBy("cell", "source", "node", "goal").agg(F.min(F.struct("cost", "via")).alias("m")).select("cell", "source", "node", "goal", "m.cost", "m.via")
        before = known.select("cell", "source", "node", c("cost").alias("was"), c("via").alias("was_via"), F.lit(False).alias("goal"))
        best = best.join(before, ["cell", "source", "node", "goal"], "left").where("was IS NULL OR cost < was OR cost = was AND via < was_via")
        front = best.select("cell", "source", "node", "cost", "via", "goal", (~c("goal") & (c("was").isNull() | (c("cost") < c("was")))).alias("opens"))
        table, seen = counted(front, n=F.count(F.when(c("opens"), 1)), parts=F.collect_set(F.when(c("opens"), own["cell"])))
        fronts.append(table.drop("opens"))
        front = table.where("opens").drop("opens")
    every = fronts[0]
    for f in fronts[1:]:
        every = every.unionByName(f)
    return every.where(F.lit(True) if goals is None else c("goal")).drop("goal")


class _Cell:
    """The graph of one cell and of the nodes behind its rim, which have no edges here."""

    def __init__(self, cell: int, edges: list[list[np.ndarray]]):
        none = [[np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64, np.int64)]]
        a, b, w, via, there = (np.concatenate(x) for x in zip(*(edges or none), strict=True))
        self.nodes = np.unique(np.concatenate([a, b]))
        at, to = np.searchsorted(self.nodes, a), np.searchsorted(self.nodes, b)
        order = np.argsort(at, kind="stable")
        at, self.to, self.w, self.via = at[order], to[order], w[order], via[order]
        n = len(self.nodes)
        self.first = np.searchsorted(at, np.arange(n + 1))
        self.many = np.diff(self.first)
        self.cells = np.full(n, cell, np.int64)
        self.cells[to] = there
        self.outside = self.cells != cell
        self.width = float(np.median(w)) if len(w) else 0.0
        self.cost, self.waits = np.full(n, inf), np.zeros(n, bool)
        self.lists: tuple[list, list, list] | None = None
        self.mark, self.last = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def places(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of nodes, and which of them are here."""
        at = np.minimum(np.searchsorted(self.nodes, nodes), max(0, len(self.nodes) - 1))
        here = self.nodes[at] == nodes if len(self.nodes) else np.zeros(len(nodes), bool)
        return at, here

    def _edges(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The edges of nodes, and how many each has."""
        many = self.many[at]
        return np.repeat(self.first[at] - np.cumsum(many) + many, many) + np.arange(many.sum()), many

    def _once(self, at: np.ndarray) -> np.ndarray:
        self.mark[at] = np.arange(len(at))
        return at[self.mark[at] == np.arange(len(at))]

    def flood(self, at: np.ndarray, cost: np.ndarray, most: float, goals: np.ndarray | None) -> np.ndarray:
        """Lower ``self.cost`` from these nodes on; the nodes that are reached. Beyond ``most``, or the dearest of ``goals`` where all are
        here, nothing is followed. Nodes go in steps of about one edge's cost, so few are taken twice."""
        if len(at) < NEAR:
            open_, first = self._nearest(at, cost, most, goals)
        else:
            np.minimum.at(self.cost, at, cost)
            open_ = first = self._once(at)
        self.waits[open_] = True
        reached = [first]
        while open_.size:
            here = self.cost[open_]
            low = here.min()
            if goals is not None:
                most = min(most, self.cost[goals].max())
            if low > most:
                self.waits[open_] = False
                break
            now = here <= low + self.width
            at, open_ = open_[now], open_[~now]
            self.waits[at] = False
            edges, many = self._edges(at)
            far, to = np.repeat(here[now], many) + self.w[edges], self.to[edges]
            less = (far < self.cost[to]) & (far <= most)
            far, to = far[less], to[less]
            np.minimum.at(self.cost, to, far)
            new = self._once(to[~self.waits[to]])
            self.waits[new] = True
            reached.append(new)
            open_ = np.concatenate([open_, new])
        return self._once(np.concatenate(reached))

    def _nearest(self, at: np.ndarray, cost: np.ndarray, most: float, goals: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Flood the first ``NEAR`` nodes one by one; the nodes from which it goes on, and those that are reached."""
        if self.lists is None:
            self.lists = (self.first.tolist(), self.to.tolist(), self.w.tolist())
        first, to, w = self.lists
        best: dict[int, float] = {}
        for i, c in zip(at.tolist(), cost.tolist(), strict=True):
            best[i] = min(c, best.get(i, inf))
        heap = [(c, i) for i, c in best.items()]
        heapify(heap)
        left = None if goals is None else set(goals.tolist())
        for _ in range(NEAR):
            if not heap or heap[0][0] > most or left is not None and not left:
                heap = []
                break
            c, i = heappop(heap)
            if c > best[i]:
                continue
            if left is not None:
                left.discard(i)
            for k in range(first[i], first[i + 1]):
                far, j = c + w[k], to[k]
                if far <= most and far < best.get(j, inf):
                    best[j] = far
                    heappush(heap, (far, j))
        reached = np.fromiter(best, np.int64, len(best))
        self.cost[reached] = np.fromiter(best.values(), np.float64, len(best))
        return np.array([i for c, i in dict.fromkeys(heap) if c == best[i]], np.int64), reached

    def last_edges(self, reached: np.ndarray, at: np.ndarray, cost: np.ndarray, via: np.ndarray) -> np.ndarray:
        """By place, of the nodes just reached: the smallest edge that brings a node's cost, or the one that an entry came by."""
        out = self.last
        out[reached] = _NONE
        edges, many = self._edges(reached)
        to = self.to[edges]
        on = np.repeat(self.cost[reached], many) + self.w[edges] == self.cost[to]
        np.minimum.at(out, to[on], self.via[edges][on])
        on = cost == self.cost[at]
        np.minimum.at(out, at[on], via[on])
        return out


def _spread(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Of each cell and bucket first the edges, then for each source its bound, its goals and the labels that enter."""
    place, edges, cell, source, rows, out = None, [], None, None, [], []
    numbers = lambda batch, names: [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
    whole_numbers = lambda x, n: x if isinstance(x, np.ndarray) else np.full(n, x, np.int64)

    def label(cells: np.ndarray | int, nodes: np.ndarray, cost: np.ndarray, via: np.ndarray | int, goal: bool = False) -> None:
        n = len(nodes)
        out.append([whole_numbers(cells, n), whole_numbers(source, n), nodes, cost, whole_numbers(via, n), np.full(n, goal)])

    def closed() -> None:
        if not rows:
            return
        kind, a, b, cost, via = (np.concatenate(x) for x in zip(*rows, strict=True))
        rows.clear()
        mine, asked = kind == _OPEN, kind == _GOAL
        most, guided = cost[kind == _BOUND].min(initial=inf), bool((kind == _BOUND).any())
        nodes, cost, via, goals = a[mine], cost[mine], via[mine], a[asked]
        (at, here), (goal_at, goal_here) = cell.places(nodes), cell.places(goals)
        all_here = len(goals) > 0 and len(goals) == b[asked][0] and goal_here.all()
        reached = cell.flood(at[here], cost[here], most, goal_at if all_here else None)
        shown = reached[cell.outside[reached] != whole]
        if len(shown):  # with goals only costs are asked for
            label(cell.cells[shown], cell.nodes[shown], cell.cost[shown], _START if guided else cell.last_edges(reached, at[here], cost[here], via[here])[shown])
        if whole:
            label(place[0], nodes[~here], cost[~here], via[~here])
        elif len(goals):
            met = goal_at[goal_here]
            met = met[cell.cost[met] < inf]
            if len(met):
                label(place[0], cell.nodes[met], cell.cost[met], _START, True)
            if not here.all():
                lone = np.isin(nodes, goals) & ~here
                label(place[0], nodes[lone], cost[lone], _START, True)
        cell.cost[reached] = inf

    for batch in batches:
        cells, buckets = numbers(batch, ("cell", "bucket"))
        sources, given = batch.column("source").fill_null(0).to_numpy(), batch.column("source").is_valid().to_numpy(zero_copy_only=False)
        new = np.any([x[1:] != x[:-1] for x in (cells, buckets, sources, given)], axis=0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if (here := (int(cells[i]), int(buckets[i]))) != place:
                closed()
                place, edges, cell, source = here, [], None, None
            part = batch.slice(i, j - i)
            if not given[i]:
                edges.append(numbers(part, ("a", "b", "cost", "via", "there")))
                continue
            if source != sources[i]:
                closed()
                source = int(sources[i])
            if cell is None:
                cell, edges = _Cell(place[0], edges), []
            rows.append(numbers(part, ("kind", "a", "b", "cost", "via")))
            if sum(len(x[0]) for x in out) > 50_000:
                yield _labels(out)
                out.clear()
    closed()
    yield _labels(out)


def _labels(out: list[list[np.ndarray]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.bool_())
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cell", "source", "node", "cost", "via", "goal"])
