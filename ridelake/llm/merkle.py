"""Fingerprints of documents as Merkle trees over sections, paragraphs and sentences.

A leaf hashes a sentence with the space behind it (one of over 400 characters in parts), a paragraph its
leaves, a section its paragraphs, the root its sections. A section ends where the
hash of a paragraph says so, so a change moves the bounds nearby only. The fingerprint is
the tree as a string: the root, then each section with its paragraphs and their
leaves (hash and length). Roots are hashes of 128 bits over whole hashes of 128 bits, so equal roots
mean equal texts; the inner ones are shortened to 40 bits where they are kept. Two different
trees are compared from the top: equal sections are shared whole, those that differ are
opened to their paragraphs and these to their leaves, which is where the edits are. The likeness is twice the number of characters in shared
branches by the characters of both.

Defined results: null and empty texts have the tree of one empty leaf; two of
them are equal (likeness 1). Documents follow each other by descending doc_id, nulls last, ties by a
hash of the text; the last is followed by the first, and a single one by itself.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ridelake.llm.common import ID, TEXT, slices

SENTENCE = re.compile(r"[^.!?]{0,400}[.!?]*\s*")
#: A section ends behind one paragraph in so many.
PARAGRAPHS = 8


def _digest(data: bytes) -> str:
    return hashlib.blake2b(data, digest_size=16).hexdigest()


#: Hexadecimal digits of the hashes of inner nodes that are kept in a tree; the root is made from whole ones.
KEPT = 10


@dataclass(frozen=True)
class Tree:
    """root: hash; sections: (hash, characters, paragraphs); paragraphs: (hash, characters, leaves);
    leaves: (hash, characters)."""

    root: str
    sections: tuple

    @classmethod
    def of(cls, text: str) -> Tree:
        sections, held, whole, inside = [], [], [], []

        def close():
            mark = _digest(".".join(inside).encode())
            sections.append((mark[:KEPT], sum(n for _, n, _ in held), tuple(held)))
            whole.append(mark)
            held.clear()
            inside.clear()

        for line in text.split("\n"):
            parts = [x for x in SENTENCE.findall(line) if x] or [""]
            marks = [_digest(x.encode("utf-8", "replace")) for x in parts]
            mark = _digest("".join(marks).encode())
            held.append((mark[:KEPT], len(line), tuple((h[:KEPT], len(x)) for h, x in zip(marks, parts, strict=True))))
            inside.append(mark)
            if int(mark[:4], 16) % PARAGRAPHS == 0:
                close()
        if held:
            close()
        return cls(_digest(".".join(whole).encode()), tuple(sections))

    def __str__(self) -> str:
        paragraph = lambda p: p[0] + "(" + ",".join(f"{h}{n:x}" for h, n in p[2]) + ")"
        return self.root + "".join(f"/{s[0]}:" + ";".join(map(paragraph, s[2])) for s in self.sections)

    @classmethod
    def parse(cls, text: str) -> Tree:
        root, *sections = text.split("/")
        made = []
        for s in sections:
            held = []
            for p in s.partition(":")[2].split(";"):
                mark, _, inside = p.rstrip(")").partition("(")
                leaves = tuple((x[:KEPT], int(x[KEPT:], 16)) for x in inside.split(","))
                held.append((mark, sum(n for _, n in leaves), leaves))
            made.append((s.partition(":")[0], sum(p[1] for p in held), tuple(held)))
        return cls(root, tuple(made))

    @property
    def size(self) -> int:
        return sum(s[1] for s in self.sections)


def _shared(a: tuple, b: tuple) -> tuple[int, list, list]:
    """Characters in branches that both lists hold, and the branches left over on each side."""
    left = Counter(x[0] for x in a) & Counter(x[0] for x in b)
    rest_a, total, counts = [], 0, left.copy()
    for x in a:
        if counts[x[0]] > 0:
            counts[x[0]] -= 1
            total += x[1]
        else:
            rest_a.append(x)
    rest_b, counts = [], left.copy()
    for x in b:
        if counts[x[0]] > 0:
            counts[x[0]] -= 1
        else:
            rest_b.append(x)
    return total, rest_a, rest_b


def likeness(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    whole = a.size + b.size
    if not whole:
        return 0.0
    total, x, y = _shared(a.sections, b.sections)
    for _ in range(2):
        x, y = [c for s in x for c in s[2]], [c for s in y for c in s[2]]
        more, x, y = _shared(tuple(x), tuple(y))
        total += more
    return min(1.0, 2 * total / whole)


def edits(a: Tree, b: Tree) -> list[int]:
    """Indexes of the paragraphs of ``b`` that ``a`` does not hold, found down the differing branches."""
    if a.root == b.root:
        return []
    _, rest_a, rest_b = _shared(a.sections, b.sections)
    changed = Counter(p[0] for s in rest_b for p in s[2]) - Counter(p[0] for s in rest_a for p in s[2])
    places = [p[0] for s in b.sections for p in s[2]]
    out = []
    for i in range(len(places) - 1, -1, -1):
        if changed[places[i]] > 0:
            changed[places[i]] -= 1
            out.append(i)
    return out[::-1]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row."""

    def run(batches):
        for batch in slices(batches):
            made = [str(Tree.of(x or "")) for x in batch.column(TEXT).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(ID), pa.array(made, pa.string())], names=[ID, "fingerprint"])

    return docs.select(ID, TEXT).mapInArrow(run, f"{ID} {docs.schema[ID].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, rows: Callable[[Iterator], Iterator[tuple]], schema: str) -> DataFrame:
    """Apply ``rows`` to an iterator of (doc_id, text, text of the next document) in order.

    Documents are dealt into ranges of doc_id, about as many in each, found from
    approximate quantiles. Each range also gets the first document of the range after it, so
    every document meets the next one although ranges are worked on apart. What reaches the
    driver is one identifier for each range. Rows that share a doc_id stay together.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx(ID, at, 10 * ranges)).first()[0] or []
    splits = sorted(set(found))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        n = [len(splits) - bisect_left(splits, int(x)) if k else len(splits) + 1 for x, k in zip(ids, known, strict=True)]
        return pd.Series(n, dtype="int32")

    base = docs.select(ID, TEXT)
    ids = docs.select(ID).where(F.col(ID).isNotNull())
    firsts = {r.place: r.first for r in ids.select(ID, place(ID).alias("place")).groupBy("place").agg(F.max(ID).alias("first")).collect()}
    tie = F.xxhash64(TEXT)
    nulls = base.where(F.col(ID).isNull()).agg(F.min(tie)).first()[0]
    order = sorted(firsts) + ([len(splits) + 1] if nulls is not None else [])
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first range follows the last
    own = base.select(place(ID).alias("place"), F.lit(0).alias("extra"), ID, TEXT)
    head = base.where(F.col(ID).isin([firsts[p] for p in order if p in firsts]) | (F.col(ID).isNull() & (tie == F.lit(nulls))))
    goes = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None)
    head = head.select(place(ID).alias("place"), F.lit(1).alias("extra"), ID, TEXT)
    head = head.withColumn("place", goes[F.col("place")] if before else F.col("place"))
    dealt = own.unionByName(head).repartition("place")
    dealt = dealt.sortWithinPartitions("place", "extra", F.desc_nulls_last(ID), tie)

    def pairs(batches):
        held = None
        for batch in slices(batches, 4 << 20):
            columns = (batch.column(c).to_pylist() for c in ("place", "extra", ID, TEXT))
            for p, extra, doc, text in zip(*columns, strict=True):
                if held and held[0] == p:
                    yield held[1], held[2], text or ""
                    held = None
                if not extra:
                    held = (p, doc, text or "")
                elif held and held[0] != p:
                    held = None

    target = to_arrow_schema(T.DataType.fromDDL(schema))

    def run(batches):
        part, size = [], 0
        for row in rows(pairs(batches)):
            part.append(row)
            size += sum(len(x) for x in row if isinstance(x, str)) + 64
            if size > 4 << 20:
                yield _batch(part, target)
                part, size = [], 0
        if part:
            yield _batch(part, target)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def half_replaced(text: str, other: str) -> str:
    """``text`` with its last half replaced by as many first characters of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's tree beside that of its edited text and that of the next document."""

    def rows(pairs):
        cached = (None, None)
        for doc, text, after in pairs:
            own = cached[1] if cached[0] == text else Tree.of(text)
            changed = half_replaced(text, after)
            other, cached = Tree.of(changed), (after, Tree.of(after))
            yield doc, len(text), changed, str(own), str(other), likeness(own, other), likeness(own, cached[1])

    kind = docs.schema[ID].dataType.simpleString()
    names = [ID, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [kind, "long", "string", "string", "string", "double", "double"]
    return with_next(docs, rows, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))
