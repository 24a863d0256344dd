"""Strongly connected parts of directed graphs, in rounds that grow with the logarithm of a chain.

Cells of neighbouring nodes are condensed first, each by a task: what lies on no way from the cell's rim to its rim is decided there, the parts of
the rest go on as one node each. Of what is left, what decides itself goes first: nodes joined in both directions are one, nodes that nothing leads to, or that lead nowhere, are parts of
their own together with the chains behind them, and a chain of nodes with one way in and one way out is one edge. Chains are
followed by doubling. What is left is split by pivots drawn at random: each node takes the largest pivot that reaches it, and of
the nodes of one pivot those that reach it back are its part. State lies in the shared folder and is deleted once it is used up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.operators.floods import by_stretch
from ridelake.storage import counted, dropped, kept


def looked_back(back: DataFrame) -> DataFrame:
    """(item, to, steps, least) from (item, prev): the first item of the chain behind each, how far it is, and the smallest
    item passed. In a loop, which has no first item, ``to`` is some item of it.

    Pointer jumping: each round doubles the stretch that an item looks back over, so a chain of n items takes log n joins.
    """
    start = back.select("item", F.coalesce("prev", "item").alias("to"), F.col("prev").isNotNull().cast("long").alias("steps"), F.least("item", F.coalesce("prev", "item")).alias("least"))
    state, size = counted(start, n=F.count("*"), moved=F.count(F.when(F.col("steps") > 0, 1)))
    # fewer items move each round while a chain is open; in a loop all move for ever, and once no smallest item changes it has been passed whole
    before = size["moved"]
    for _ in range(size["n"].bit_length() if before else 0):
        far = state.select(F.col("item").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"))
        after, now = counted(
            state.join(far, "to").select(
                "item", F.col("to2").alias("to"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("least", "least2").alias("least"), (F.col("steps2") > 0).alias("more")
            ),
            moved=F.count(F.when(F.col("more"), 1)),
            least=F.sum(F.col("least").cast("decimal(38,0)")),
        )
        dropped(state)
        state = after
        if now == before or not now["moved"]:
            break
        before = now
    return state.select("item", "to", "steps", "least")


def undirected(pairs: DataFrame) -> DataFrame:
    """(node, root): the connected parts of pairs (a, b) that are there in both directions, named by their smallest node.

    Each round halves the way to the root and hangs roots below the smallest root beside their part, so rounds grow with the logarithm.
    """
    state = kept(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root"), F.lit(None).cast("long").alias("was")))
    while True:
        far = state.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = state.join(far, "root").select("node", "root", "far")
        beside = pairs.join(jumped.select(F.col("node").alias("b"), "far"), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("beside"))
        met = jumped.join(beside, "node").select("node", "root", F.least("far", "beside").alias("new"))
        below = met.groupBy(F.col("root").alias("node")).agg(F.min("new").alias("below"))
        after, seen = counted(
            met.join(below, "node", "left").select("node", F.least("new", "below").alias("root"), F.col("root").alias("was")), changed=F.count(F.when(F.col("root") != F.col("was"), 1))
        )
        dropped(state)
        state = after
        if not seen["changed"]:
            return state.select("node", "root")


def _renamed(pairs: DataFrame, root: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(root.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("root", end)).select("a", "b")
    return pairs.where("a != b").distinct()


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _without(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end)), end, "left_anti")
    return pairs.select("a", "b")


def _dead_ends(pairs: DataFrame) -> DataFrame | None:
    """(node): nodes that nothing leads to, and the chains behind them whose nodes have no other way in; None if there are none."""
    into = pairs.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("n"), F.min("a").alias("a"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    back, seen = counted(
        ends.join(into, "node", "left").select(F.col("node").alias("item"), F.when(F.col("n") == 1, F.col("a")).alias("prev"), F.col("n").isNull().alias("first")),
        first=F.count(F.when(F.col("first"), 1)),
    )
    if not seen["first"]:
        return None
    first = back.where("first").select(F.col("item").alias("to"))
    return looked_back(back.select("item", "prev")).join(first, "to", "left_semi").select(F.col("item").alias("node"))


def _chains(pairs: DataFrame, least: int) -> tuple[DataFrame, DataFrame] | None:
    """(node, head, tail) of the nodes with one way in and one way out: where their chain comes from and leads to; and (node, root) of those
    that are a loop of their own. None if there are fewer than ``least``."""
    into = pairs.groupBy(F.col("b").alias("item")).agg(F.count("*").alias("n"), F.min("a").alias("before"))
    out = pairs.groupBy(F.col("a").alias("item")).agg(F.count("*").alias("n"), F.min("b").alias("behind"))
    only, seen = counted(into.where("n = 1").join(out.where("n = 1"), "item").where("before != behind").select("item", "before", "behind"), n=F.count("*"))
    if seen["n"] < least:
        return None
    ends = []
    for side in ("before", "behind"):
        inner = only.select(F.col("item").alias(side), F.lit(True).alias("inner"))
        back = kept(only.join(inner, side, "left").select("item", side, F.when(F.col("inner"), F.col(side)).alias("prev")))
        first = back.where("prev IS NULL").select(F.col("item").alias("to"), F.col(side).alias("end"))
        ends.append(kept(looked_back(back.select("item", "prev")).join(first, "to", "left").select("item", "end", "least")))
    head, tail = ends
    chains = head.join(tail.select("item", F.col("end").alias("tail")), "item").where("end IS NOT NULL").select(F.col("item").alias("node"), F.col("end").alias("head"), "tail")
    return kept(chains), head.where("end IS NULL").select(F.col("item").alias("node"), F.col("least").alias("root"))


def reached(edges: DataFrame, start: DataFrame, hops: int = 4) -> DataFrame:
    """(node, part): nodes reached from ``start`` (node, part) along edges (a, b) inside the same part.

    Frontiers grow ``hops`` steps to a job.
    """
    found = front = kept(start.select("node", "part").distinct())
    while True:
        new = step = front
        for _ in range(hops):
            step = step.join(edges, (F.col("node") == F.col("a")) & (F.col("part") == F.col("edge_part"))).select(F.col("b").alias("node"), "part").distinct()
            new = new.unionByName(step)
        front, seen = counted(new.distinct().join(found, ["node", "part"], "left_anti"), n=F.count("*"))
        if not seen["n"]:
            return found
        found = kept(found.unionByName(front))


def _split(pairs: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the parts of this round's pivots, and the pairs that are left to split."""
    pivot = lambda n: F.struct(F.xxhash64(n).alias("drawn"), F.col(n).alias("node"))
    colour = kept(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", pivot("node").alias("colour"), F.lit(None).alias("was")))
    while True:
        state = colour.select("node", "colour", F.col("colour").alias("was"))
        for _ in range(hops):
            via = state.join(pairs, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "colour", F.lit(None).alias("was"))
            state = state.unionByName(via).groupBy("node").agg(F.max("colour").alias("colour"), F.max("was").alias("was"))
        after, seen = counted(state, changed=F.count(F.when(F.col("colour") != F.col("was"), 1)))
        dropped(colour)
        colour = after
        if not seen["changed"]:
            break
    of = lambda end, name: colour.select(F.col("node").alias(end), F.col("colour.node").alias(name))
    within = kept(pairs.join(of("a", "edge_part"), "a").join(of("b", "part_b"), "b").where("edge_part = part_b").select("a", "b", "edge_part"))
    roots = colour.where("node = colour.node").select("node", F.col("node").alias("part"))
    found = reached(within.select(F.col("b").alias("a"), F.col("a").alias("b"), "edge_part"), roots, hops).select("node", F.col("part").alias("root"))
    return found, kept(_without(within, found))


_INSIDE, _OUT, _IN = range(3)


def _condensed(pairs: DataFrame, cell: Callable[[Column], Column]) -> DataFrame:
    """(node, root, open): the parts of each cell by itself, named by their largest node, and whether a way from another cell to another cell
    leads through. A pair between cells is known in both."""
    a, b = cell(F.col("a")), cell(F.col("b"))
    row = lambda c, kind: F.struct(c.alias("cell"), F.lit(kind).alias("kind"))
    at = F.when(a == b, F.array(row(a, _INSIDE))).otherwise(F.array(row(a, _OUT), row(b, _IN)))
    dealt = pairs.select("a", "b", F.inline(at)).repartition("cell").sortWithinPartitions("cell")
    return kept(dealt.mapInArrow(_condense, "node long, root long, open boolean"))


def _condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    place, rows = None, []
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)] if len(cells) else []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if cells[i] != place and rows:
                yield _parts(*(np.concatenate(x) for x in zip(*rows, strict=True)))
                rows = []
            place = cells[i]
            rows.append([batch.column(n).slice(i, j - i).to_numpy() for n in ("a", "b", "kind")])
    if rows:
        yield _parts(*(np.concatenate(x) for x in zip(*rows, strict=True)))


def _parts(a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """The parts of one cell."""
    nodes = np.unique(np.concatenate([a[kind != _IN], b[kind != _OUT]]))
    n = len(nodes)
    x, y = (np.searchsorted(nodes, e[kind == _INSIDE]) for e in (a, b))
    ahead, back = _neighbours(n, x, y), _neighbours(n, y, x)
    part = np.array(_tarjan(n, *ahead), np.int64)
    root = np.zeros(n, np.int64)
    root[part] = nodes  # nodes ascend, so the largest of a part stays
    through = _reach(n, *ahead, np.searchsorted(nodes, b[kind == _IN])) & _reach(n, *back, np.searchsorted(nodes, a[kind == _OUT]))
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root[part]), pa.array(through)], ["node", "root", "open"])


def _neighbours(n: int, x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    order = np.argsort(x, kind="stable")
    return np.searchsorted(x[order], np.arange(n + 1)).tolist(), y[order].tolist()


def _reach(n: int, first: list[int], to: list[int], start: np.ndarray) -> np.ndarray:
    seen, stack = bytearray(n), start.tolist()
    while stack:
        i = stack.pop()
        if not seen[i]:
            seen[i] = 1
            stack += [j for j in to[first[i] : first[i + 1]] if not seen[j]]
    return np.frombuffer(bytes(seen), np.uint8).astype(bool)


def _tarjan(n: int, first: list[int], to: list[int]) -> list[int]:
    """The number of each node's strongly connected part."""
    low, part, at = [0] * n, [-1] * n, first[:n]
    found, parts, stack = 0, 0, []
    for start in range(n):
        if low[start]:
            continue
        found += 1
        low[start], way, number = found, [start], {start: found}
        stack.append(start)
        while way:
            i = way[-1]
            if at[i] < first[i + 1]:
                j = to[at[i]]
                at[i] += 1
                if not low[j]:
                    found += 1
                    low[j] = number[j] = found
                    way.append(j)
                    stack.append(j)
                elif part[j] < 0 and low[j] < low[i]:
                    low[i] = low[j]
                continue
            way.pop()
            if way and low[i] < low[way[-1]]:
                low[way[-1]] = low[i]
            if low[i] == number[i]:
                while True:
                    j = stack.pop()
                    part[j] = parts
                    if j == i:
                        break
                parts += 1
    return part


def strong_components(nodes: DataFrame, edges: DataFrame, hops: int = 4, cell: Callable[[Column], Column] = by_stretch) -> DataFrame:
    """(node_id, component): strongly connected components, named by their largest node."""
    all_ = lambda df: counted(df, n=F.count("*"))
    pairs, seen = all_(edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")).where("a != b").distinct())
    layers: list[tuple[str, DataFrame]] = []
    if seen["n"]:
        local = _condensed(pairs, cell)
        layers.append(("one", local.select("node", "root")))
        for end in ("a", "b"):
            pairs = pairs.join(local.where("open").select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end)
        pairs, seen = all_(pairs.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a != b").distinct())
    while n := seen["n"]:
        both, seen_both = all_(pairs.join(_turned(pairs), ["a", "b"], "left_semi"))
        if seen_both["n"]:
            layers.append(("one", undirected(both)))
            pairs, seen = all_(_renamed(pairs, layers[-1][1]))
        for turn in (lambda p: p, _turned):
            if (dead := _dead_ends(turn(pairs))) is not None:
                pairs, seen = all_(_without(pairs, dead))
        if made := _chains(pairs, max(1, seen["n"] // 8)):
            chains, loops = made
            layers += [("part", loops), ("chain", chains)]
            across = chains.select(F.col("head").alias("a"), F.col("tail").alias("b")).where("a != b")
            pairs, seen = all_(_without(_without(pairs, chains), loops).unionByName(across).distinct())
        if seen["n"] > n // 2:
            found, pairs = _split(pairs, hops)
            layers.append(("part", found))
            seen = {"n": pairs.count()}
    found = nodes.select(F.col("node_id").alias("node"), F.col("node_id").alias("root")).limit(0)
    for kind, layer in reversed(layers):  # what was decided last is known first
        if kind == "part":
            more = layer.select("node", "root")
        elif kind == "one":
            known = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
            more = layer.where("node != root").join(known, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        else:
            side = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
            more = layer.join(side("head"), "head", "left").join(side("tail"), "tail", "left")
            more = more.select("node", F.coalesce("head_root", "head").alias("root"), F.coalesce("tail_root", "tail").alias("other")).where("root = other").select("node", "root")
        found = kept(found.unionByName(more))
    rooted = kept(nodes.select("node_id").distinct().join(found.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("root", "node_id").alias("root")))
    names = rooted.groupBy("root").agg(F.max("node_id").alias("component"))
    return rooted.join(names, "root").select("node_id", "component")
