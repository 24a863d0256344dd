"""Near-duplicate documents: an exact Jaccard self-join on word shingles.

Two documents link when the sets of their ``WORDS``-word shingles have a Jaccard likeness
of ``PERCENT`` / 100 or more. The method is a prefix filter with adaptive
multi-match prefixes: under one order of all shingles, rare ones first, a set of n
shingles that shares t of them with a partner has one of these among its first n - t + 1, and
l of them among its first n - t + l. A document whose prefix meets many others gets a
larger l, so a longer prefix and more matches required before the texts are compared.

1. Shingles with a hash below ``share`` of its range go to their places with the name of their set. Those of
   two sets or more are counted for each set; a set with too few of them has no partner, and most documents
   end here. Nothing grows on the driver or in a broadcast: shingles found in many documents of a bounded sample
   count as repeated wherever they stand and aren't sent, which keeps their lists out of single tasks.
2. The rest, one document for each distinct set, is counted with all of its shingles. The exact
   counts give the order.
3. Sets meet under the shingles of their prefixes. A row has the set's size and ``cap``, the largest partner for which
   its place is still in the prefix; partners x, y need n_x <= cap_y and n_y <= cap_x.
   Each set is compared with one leader at a time, the one that meets most others; a large group of near copies falls
   into one component in this step. Rows that no set of another component can match are dropped, by
   the largest cap and the least size of the other components under the shingle. Rounds go on while they link.
4. Sets of different components that are left, and share enough of their prefixes, are compared with each other.
   Pairs within a component are not made.
5. Components by label propagation with pointer jumping.

Sets are compared whole, as 64-bit hashes of the shingles.

Defined results: null texts and texts without words have the empty set, are
linked with nothing and are components of their own. Fewer than ``WORDS`` words are one
shingle. Documents with equal sets are linked. A component is named by its
smallest doc_id; a null doc_id counts as the largest. Repeated rows each come back. ``one_of_each`` keeps one row of each
component, that of least doc_id, one of them if rows share it, and every row without words; all columns pass through,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.llm.common import ID, TEXT, drop_stored, schema_with, slices, stored

WORDS = 5
PERCENT = 75
#: Odd constants of the hashes.
BASE, STEP, SALT = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
MASK = (1 << 64) - 1
#: Bytes of text that are hashed at a time: a worker holds about fifty times as many for it.
PART = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Shingler:
    """Hashes of words and shingles, over many texts at a time."""

    def __init__(self):
        self.size = 0
        self.grow(2 * PART)

    def grow(self, n: int) -> None:
        if n > self.size:
            self.size = n
            self.up, self.down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start of every word of UTF-8 text, A-Z lower-cased."""
        b = np.frombuffer(data, np.uint8)
        self.grow(len(b) + 1)
        upper = (b >= 65) & (b <= 90)
        gap = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        value = (b + (upper * 32).astype(np.uint8)).astype(np.uint64) + np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * self.up[: len(b)], dtype=np.uint64)])
        return mixed((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64)), start

    def words_of(self, text: bytes) -> np.ndarray:
        """Hashes of the words of one text of any length, in parts that end between words."""
        found, at = [], 0
        while at < len(text):
            end = min(len(text), at + PART)
            while end < len(text) and text[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
                end += 1
            found.append(self.words(text[at:end])[0])
            at = end
        return np.concatenate(found) if found else np.empty(0, np.uint64)

    @staticmethod
    def sets(words: np.ndarray) -> np.ndarray:
        """Sorted distinct shingle hashes of one sequence of word hashes."""
        k = min(WORDS, len(words))
        if not k:
            return words
        n = len(words) - k + 1
        total = np.full(n, (SALT * k) & MASK, np.uint64)
        for j in range(k):
            total += words[j : j + n] * np.uint64(pow(STEP, j + 1, 1 << 64))
        return np.unique(mixed(total))

    def shingles(self, texts: list[str | None]):
        """The set of each text, in order."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            data = (text or "").encode("utf-8", "replace")
            if size + len(data) > PART and group:
                yield from self._together(group)
                group, size = [], 0
            if len(data) > PART:
                yield self.sets(self.words_of(data))
                continue
            group.append(data)
            size += len(data) + 1
        yield from self._together(group)

    def _together(self, group: list[bytes]):
        if not group:
            return
        words, start = self.words(b"\n".join(group))
        begins = np.cumsum([0, *(len(x) + 1 for x in group)])
        cut = np.searchsorted(start, begins)
        for a, b in zip(cut, cut[1:], strict=False):
            yield self.sets(words[a:b])


def needed(n: int) -> int:
    """Least number of shingles that a set of n shares with a partner."""
    return (PERCENT * n + 99) // 100


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _among(h: np.ndarray, sorted_ones: np.ndarray) -> np.ndarray:
    if not len(sorted_ones):
        return np.zeros(len(h), bool)
    return sorted_ones[np.minimum(np.searchsorted(sorted_ones, h), len(sorted_ones) - 1)] == h


def _name(h: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def _short(name: bytes) -> int:
    """64 bits of a name. Two sets that share them cost time only."""
    return int.from_bytes(name[:8], "little", signed=True)


def frequent(docs: DataFrame, below: int, sample_docs: int, often: int, most: int) -> np.ndarray:
    """Sorted hashes below ``below`` found in ``often`` documents or more of a sample of about ``sample_docs``; ``most`` at most.

    They only spare the shuffle its longest lists; which ones are in the sample doesn't change a result.
    """
    n = docs.count()
    sample = docs.select(TEXT) if n <= sample_docs else docs.select(TEXT).sample(sample_docs / n, 1)

    def run(batches):
        shingler = Shingler()
        for batch in slices(batches, 1 << 20):
            for h in shingler.shingles(batch.column(TEXT).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(h[h <= np.uint64(below)]))], names=["h"])

    counted = sample.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= often)
    top = counted.orderBy(F.desc("count"), "h").limit(most).select("h").toArrow()
    return np.sort(top["h"].to_numpy().view(np.uint64))


def _sent(docs: DataFrame, below: int, hot) -> DataFrame:
    """(h, f): the counted shingles of every set, once for each set and task."""

    def run(batches):
        shingler, seen = Shingler(), set()
        for batch in slices(batches, 1 << 20):
            hs, fs = [], []
            for h in shingler.shingles(batch.column(TEXT).to_pylist()):
                f = _short(_name(h))
                if f in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(f)
                h = h[: np.searchsorted(h, np.uint64(below), side="right")]  # sets are sorted
                h = h[~_among(h, hot.value)]
                hs.append(h)
                fs.append(np.full(len(h), f, np.int64))
            if hs:
                h, f = _signed(np.concatenate(hs)), np.concatenate(fs)
                for at in range(0, len(h), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(h[at : at + 50_000]), pa.array(f[at : at + 50_000])], names=["h", "f"])

    return docs.select(TEXT).mapInArrow(run, "h long, f long")


def _repeated(batches):
    """(f, rep) of rows (h, f) in the order of h: for each f the number of its rows whose h another f has too.

    Of a run of equal h that goes on in the next batch no more than one row is held.
    """
    held_h = held_f = None
    known = False
    for batch in batches:
        if not batch.num_rows:
            continue
        h, f = batch.column("h").to_numpy(), batch.column("f").to_numpy()
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        low, high = np.minimum.reduceat(f, start), np.maximum.reduceat(f, start)
        many, before = low != high, []
        if held_h is not None and h[0] == held_h:
            if not many[0] and not known:
                many[0] = held_f != low[0]
            many[0] |= known
            if many[0] and not known:
                before = [held_f]
        held_h, known = h[-1], bool(many[-1])
        held_f = None if known else low[-1]
        each = np.repeat(many, np.diff(np.append(start, len(h))))
        sub_h, sub_f = h[each], f[each]
        order = np.lexsort((sub_f, sub_h))
        sub_h, sub_f = sub_h[order], sub_f[order]
        if len(sub_h):
            sub_f = sub_f[np.concatenate([[True], (sub_h[1:] != sub_h[:-1]) | (sub_f[1:] != sub_f[:-1])])]
        name, count = np.unique(np.append(sub_f, np.array(before, np.int64)), return_counts=True)
        if len(name):
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(count.astype(np.int64))], names=["f", "rep"])


def _named(docs: DataFrame, below: int, hot) -> DataFrame:
    """doc (all columns of ``docs``), fp and f (names of the set), n, and how many of its sent shingles must be repeated
    if it has a partner."""

    def run(batches):
        shingler = Shingler()
        for batch in slices(batches, 1 << 20):
            fp, f, n, least = [], [], [], []
            for h in shingler.shingles(pa.compute.struct_field(batch.column("doc"), [at]).to_pylist()):
                fp.append(_name(h))
                f.append(_short(fp[-1]))
                n.append(len(h))
                counted = h[: np.searchsorted(h, np.uint64(below), side="right")]
                sent = len(counted) - int(_among(counted, hot.value).sum())
                least.append(sent - (len(h) - needed(len(h))) if len(h) else 1)
            columns = [pa.array(fp, pa.binary()), *(pa.array(x, pa.int64()) for x in (f, n, least))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], names=["doc", "fp", "f", "n", "least"])

    at = docs.columns.index(TEXT)
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("doc"))
    return packed.mapInArrow(run, schema_with(packed, ["doc"], fp="binary", f="long", n="long", least="long"))


def _each(active: DataFrame) -> DataFrame:
    """(node, h): all shingles of each set."""

    def run(batches):
        shingler = Shingler()
        for batch in slices(batches, 1 << 20):
            sets = list(shingler.shingles(batch.column(TEXT).to_pylist()))
            h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            node = np.repeat(batch.column("node").to_numpy(), [len(x) for x in sets])
            for at in range(0, len(h), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 50_000]), pa.array(_signed(h[at : at + 50_000]))], names=["node", "h"])

    return active.select("node", TEXT).mapInArrow(run, "node long, h long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose sets are alike enough, compared whole."""
    left = texts.select(F.col("node").alias("a"), F.col(TEXT).alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col(TEXT).alias("tb"))

    def run(batches):
        shingler, last, x = Shingler(), None, None
        for batch in slices(batches, 1 << 20):
            a, good = batch.column("a").to_pylist(), []
            for name, ta, y in zip(
                a, batch.column("ta"), shingler.shingles(batch.column("tb").to_pylist()), strict=True
            ):
                if name != last:
                    last, x = name, next(shingler.shingles([ta.as_py()]))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return joined.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(v, label) for each end of the links (a, b): label is the least end of its component.

    Every step a vertex takes the least label among its neighbours, then the label of that
    label; the number of steps grows with the logarithm of the longest chain.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v"))
        taken = labels.join(near.agg(F.min("label").alias("m")), "v").select(
            "v", F.col("label").alias("old"), F.least("label", "m").alias("label")
        )
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("next"))
        after = stored(taken.join(jump, "label").select("v", "old", F.least("label", "next").alias("label")))
        changed = after.where("label != old").limit(1).count()
        labels = after.select("v", "label")
        if not changed:
            return labels


def _prefixes(nodes: DataFrame, level) -> DataFrame:
    """(token, node, n, level, price, cap): the shingles of each set's prefix for ``level`` matches.

    Partners of n and m shingles share PERCENT * (n + m) / (100 + PERCENT) at least, so a place is in
    the prefix towards partners of at most ``cap`` shingles. Shingles of one set only were left out and count by ``once``.
    """
    n, whole = F.col("n"), 100 + PERCENT
    each = nodes.withColumn("level", level.cast("long")).where(_length(F.col("level")) > 0)
    each = each.select("node", "n", "once", "level", "price", F.posexplode(F.slice("tokens", F.lit(1), _length(F.col("level")))).alias("at", "token"))
    left = n - F.col("once") - F.col("at") + F.col("level") - 1
    cap = (F.floor(left * whole / PERCENT) - n).cast("long").alias("cap")
    return each.select(F.col("token.h").alias("token"), "node", "n", "level", "price", cap).where(F.col("cap") * 100 >= n * PERCENT)


def _length(level):
    """Number of repeated shingles in the prefix for ``level`` matches, towards the smallest partner."""
    return (F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + level - F.col("once")).cast("int")


def _met(level):
    """Number of rows that the prefix meets."""
    return F.aggregate(F.slice("tokens", F.lit(1), _length(level)), F.lit(0).cast("long"), lambda s, x: s + x["c"] - 1)


def _open(rows: DataFrame, part: DataFrame | None) -> DataFrame:
    """The rows of ``_prefixes`` that a set of another component may match, with ``part`` and the ``lead`` of their shingle.

    Under each shingle the largest cap and the least size, and those of other components than these are in,
    decide. What is joined back is written first, so that Spark can split the rows of a very common shingle.
    """
    named = rows.withColumn("part", F.col("node")) if part is None else rows.join(part, "node")
    first = named.groupBy("token").agg(
        F.max(F.struct("cap", "part")).alias("c"),
        F.min(F.struct("n", "part")).alias("s"),
        F.max(F.struct("price", "node", "n", "cap", "part")).alias("lead"),
        F.min("part").alias("lo"),
        F.max("part").alias("hi"),
    )
    first = stored(first.where("lo < hi").drop("lo", "hi"))
    seconds = named.join(first, "token").groupBy("token").agg(
        F.max(F.when(F.col("part") != F.col("c.part"), F.col("cap"))).alias("c2"), F.min(F.when(F.col("part") != F.col("s.part"), F.col("n"))).alias("s2")
    )
    seconds = stored(seconds.join(first, "token"))
    largest = F.when(F.col("part") != F.col("c.part"), F.col("c.cap")).otherwise(F.col("c2"))
    least = F.when(F.col("part") != F.col("s.part"), F.col("s.n")).otherwise(F.col("s2"))
    out = stored(named.join(seconds, "token").where((F.col("n") <= largest) & (F.col("cap") >= least)).select(*rows.columns, "part", "lead"))
    drop_stored(first)
    drop_stored(seconds)
    return out


def _merged(part: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, part) after further links (a, b)."""
    name = lambda end: part.select(F.col("node").alias(end), F.col("part").alias(f"of_{end}"))
    edges = links.join(name("a"), "a").join(name("b"), "b").where("of_a != of_b")
    moves = components(edges.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")).distinct())
    return stored(part.join(moves, part["part"] == moves["v"], "left").select("node", F.coalesce("label", "part").alias("part")))


def _levels(nodes: DataFrame, matches: int, cost: int, compare: int) -> DataFrame:
    """``nodes`` with ``level``, the number of matches to require: the cheapest by the rows that the prefix meets and
    the comparisons, of which there are at most as many as rows over matches; 1 where the shortest prefix is cheap."""
    most = F.least(F.lit(matches), F.ceil(F.col("n") * PERCENT / 100).cast("int"))
    each = F.transform(F.sequence(F.lit(1), most), lambda x: F.struct((_met(x) * (1 + F.lit(compare) / x)).alias("cost"), x.alias("level")))
    return nodes.withColumn("level", F.when(F.col("price") <= cost, 1).otherwise(F.array_min(each)["level"]))


def linked(active: DataFrame, matches: int = 8, cost: int = 256, compare: int = 16) -> DataFrame:
    """(node, part): the components of the sets ``active`` (node, n, text); sets that can have no partner are left out.

    ``matches``: the largest number of shared prefix shingles required; ``cost``: the number of open rows met in the shortest
    prefix above which more may be required; ``compare``: cost of comparing two texts, in rows.
    """
    counts = stored(_each(active).groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    tokens = _each(active).join(counts, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("tokens"))
    nodes = tokens.join(active.select("node", "n"), "node").withColumn("once", F.col("n") - F.size("tokens"))
    nodes = stored(nodes.where(_length(F.lit(1)) > 0).withColumn("price", _met(F.lit(1))))
    drop_stored(counts)

    rows, part, tried = _prefixes(nodes, F.lit(1)), None, None
    while True:
        left = _open(rows, part)
        if part is None:
            part = stored(nodes.select("node", F.col("node").alias("part")))
        else:
            drop_stored(rows)
        rows = left.drop("part", "lead")
        led = left.where("part != lead.part AND n <= lead.cap AND lead.n <= cap").groupBy("node", F.col("lead.node").alias("leader")).count()
        if tried is not None:
            led = led.join(tried, ["node", "leader"], "left_anti")
        best = led.groupBy("node").agg(F.max(F.struct("count", "leader")).alias("best"))
        led = stored(best.select("node", F.col("best.leader").alias("leader")))
        more = stored(verified(led.select(F.col("node").alias("b"), F.col("leader").alias("a")), active))
        tried = led if tried is None else tried.unionByName(led)
        found = more.count()
        if found:
            part = _merged(part, more)
        if 10 * found <= led.count():
            break

    # sets without an open row in their shortest prefix have no link left to find
    left = _open(rows, part)
    sizes = stored(left.groupBy("token").agg((F.count("*") - 1).alias("others")))
    price = left.join(sizes, "token").groupBy("node").agg(F.sum("others").alias("price"))
    chosen = _levels(nodes.drop("price").join(price, "node"), matches, cost, compare)
    chosen = _open(_prefixes(chosen, F.col("level")), part)
    x = chosen.select("token", *(F.col(c).alias(f"x_{c}") for c in ("node", "n", "cap", "level", "part")))
    y = chosen.select("token", *(F.col(c).alias(f"y_{c}") for c in ("node", "n", "cap", "level", "part")))
    pairs = x.join(y, "token").where("x_part < y_part AND x_n <= y_cap AND y_n <= x_cap")
    pairs = pairs.groupBy(F.col("x_node").alias("a"), F.col("y_node").alias("b"), F.least("x_level", "y_level").alias("level")).count()
    pairs = pairs.where(F.col("count") >= F.col("level")).select("a", "b")
    for a, b in (("leader", "node"), ("node", "leader")):
        pairs = pairs.join(tried.select(F.col(a).alias("a"), F.col(b).alias("b")), ["a", "b"], "left_anti")
    return _merged(part, stored(verified(pairs, active)))


def _components(docs: DataFrame, slim: bool, share: float, sample_docs: int, often: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Stored: (doc, fp, n, may, tag) for each row of ``docs``, and (fp, part) of the sets that link with others.

    doc has the row's columns, tag is a number of its own; if ``slim``, texts are left out where no partner may be.
    """
    below = min(MASK, int(share * (1 << 64)))
    hot = docs.sparkSession.sparkContext.broadcast(frequent(docs, below, sample_docs, often, most))
    rep = _sent(docs, below, hot).repartition("h").sortWithinPartitions("h").mapInArrow(_repeated, "f long, rep long")
    rep = stored(rep.groupBy("f").agg(F.sum("rep").alias("rep")))
    rows = _named(docs, below, hot).join(rep, "f", "left").withColumn("may", F.coalesce("rep", F.lit(0)) >= F.col("least"))
    if slim:
        rows = rows.withColumn("doc", F.struct(f"doc.{ID}", F.when(F.col("may"), F.col(f"doc.{TEXT}")).alias(TEXT)))
    rows = stored(rows.select("doc", "fp", "n", "may", F.monotonically_increasing_id().alias("tag")))
    active = rows.where("may").select("fp", "n", F.col(f"doc.{TEXT}").alias(TEXT)).dropDuplicates(["fp"])
    active = stored(active.withColumn("node", F.monotonically_increasing_id()))
    fp = lambda name: active.select(F.col("node").alias(name), F.col("fp").alias(f"fp_{name}"))
    named = linked(active).where("node != part").join(fp("node"), "node").join(fp("part"), "part")
    return rows, stored(named.select(F.col("fp_node").alias("fp"), F.col("fp_part").alias("part")))


#: share: part of the hash range whose shingles are counted first; the others bound the sample and what is broadcast from
#: it, 8 bytes for each shingle.
BOUNDS = {"share": 0.4, "sample_docs": 8_000, "often": 6, "most": 500_000}


def near_duplicates(docs: DataFrame, **bounds) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; ``bounds``: see ``BOUNDS``."""
    rows, part = _components(docs.select(ID, TEXT), True, **(BOUNDS | bounds))
    parts = rows.select(F.col(f"doc.{ID}").alias(ID), "fp", "n").join(part, "fp", "left")
    parts = stored(parts.select(ID, "n", F.coalesce("part", "fp").alias("part")))
    # written first, so that the rows of a very large component can be dealt out
    named = stored(parts.where("n > 0").groupBy("part").agg(F.min(ID).alias("least")))
    return parts.join(named, "part", "left").select(
        ID,
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col(ID)).alias("component_id"),
    )


def one_of_each(docs: DataFrame, **bounds) -> DataFrame:
    """``docs`` with one row of each component, that of least doc_id, and all rows without words; ``bounds``: see ``BOUNDS``."""
    rows, part = _components(docs, False, **(BOUNDS | bounds))
    doc = F.col(f"doc.{ID}")
    place = F.struct(doc.isNull().alias("none"), doc.alias("id"), "tag").alias("place")
    parts = rows.where("n > 0").select(place, "fp", "tag").join(part, "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    parts = stored(parts.select("place", "part", "tag"))
    first = stored(parts.groupBy("part").agg(F.min("place").alias("first"), F.count("*").alias("size")).where("size > 1"))
    later = stored(parts.join(first, "part").where("tag != first.tag").select("tag"))
    return rows.join(later, "tag", "left_anti").select("doc.*")


def sql() -> str:
    """The same in DuckDB's SQL, by all shingles that two documents share."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s FROM words),
  each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
  links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
  reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) ON x = doc_id"""
