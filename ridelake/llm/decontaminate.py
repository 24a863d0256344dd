"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and every run of characters that are
neither letters nor digits becomes one blank. An item of L characters may
differ from a passage in k = L // ``chars_per_edit`` characters (inserted,
lost or changed). It is cut into k + 1 pieces; a passage within k edits has at least one of
them unchanged. One automaton finds all pieces of all items in a text. Around each hit Myers'
bit-parallel distance decides, from the piece up: the pieces are the leaves of a binary tree, a node
of m pieces may have m - 1 edits, and where both halves had more than theirs, so had the whole. So a passage within k
edits has a piece all of whose nodes keep to their numbers, and most chance hits end at the first, which has two pieces.
The first exact or nearest passage counts.

The items are a stated query set. They are read in blocks of about
``block_chars`` characters; each block is broadcast and met with all
documents, so its size is bounded however large the benchmark. ``find`` writes what a block gives before it
reads the next if there are several.

Defined results: null or blank items match nothing, null or blank texts hold
nothing. Items with equal normalised text are all reported. Repeated rows of documents are
each reported. An empty benchmark leaves all documents. Columns of any name pass through ``clean``; ``find`` returns
its own three only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelake.llm.common import ID, TEXT, schema_with, slices, stored, texts_of

#: Characters per edit of the query and the pipeline: a tenth of an item may differ.
EDITED = 10
BREAK = re.compile(r"[\W_]+")


def normalise(text: str) -> str:
    """Words parted by single blanks, with a blank at either end; empty without words."""
    words = BREAK.sub(" ", text.lower()).strip()
    return f" {words} " if words else ""


def pieces(pattern: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of nearly equal length that make up the pattern, with their offsets."""
    cuts = [len(pattern) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    """For each character the positions where the pattern has it, as bits."""
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def nearest(positions: dict[str, int], length: int, text: str) -> int:
    """Least edit distance between the pattern and any substring of the text (Myers 1999)."""
    full, top = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score = full, 0, length
    best = score
    for c in text:
        eq = positions.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | (full & ~(zero | plus))
        down = zero & plus
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            best = min(best, score)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(zero | up)), zero & up
    return best


@lru_cache(16_000)
def masks_of(segment: str) -> dict[str, int]:
    return masks(segment)


def ancestors(pieces_: int) -> list[list[tuple[int, int]]]:
    """For each of the pieces the nodes above it, as ranges of pieces, from the lowest to the one below the root."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(pieces_)]
    open_ = [(0, pieces_)]
    while open_:
        low, high = open_.pop()
        if high - low < 2:
            continue
        if high - low < pieces_:
            for i in range(low, high):
                out[i].insert(0, (low, high))
        middle = (low + high + 1) // 2
        open_ += [(low, middle), (middle, high)]
    return out


def beside(text: str, at: int, other: str, right: bool) -> bool:
    """Whether ``other`` may stand in the text with one edit at most, from ``at`` on or up to it: half of it is unchanged."""
    half = len(other) // 2
    first, second = other[:half], other[half:]
    if right:
        return text.startswith(first, at) or any(text.startswith(second, at + half + d) for d in (0, 1, -1))
    end = at - len(second)
    return (end >= 0 and text.startswith(second, end)) or any(end - half + d >= 0 and text.startswith(first, end - half + d) for d in (0, 1, -1))


@dataclass
class Items:
    """The items of one block, ready to be looked for."""

    names: list[list]  # of each distinct pattern: the item_ids
    patterns: list[str]
    edits: list[int]
    automaton: object = field(repr=False)

    @classmethod
    def of(cls, rows: list[tuple], chars_per_edit: int) -> Items:
        by_text: dict[str, list] = {}
        for name, text in rows:
            if pattern := normalise(text or ""):
                by_text.setdefault(pattern, []).append(name)
        patterns = sorted(by_text)
        edits = [(len(p) - 2) // chars_per_edit for p in patterns]
        places: dict[str, list] = {}
        for i, (p, k) in enumerate(zip(patterns, edits, strict=True)):
            for leaf, (offset, piece) in enumerate(pieces(p, k)):
                places.setdefault(piece, []).append((i, offset, leaf))
        automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            automaton.add_word(piece, (len(piece), where))
        if places:
            automaton.make_automaton()
        return cls([by_text[p] for p in patterns], patterns, edits, automaton)

    def __post_init__(self):
        self.trees: dict[int, list] = {}

    def _above(self, i: int, leaf: int) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the nodes above a piece, in characters of the pattern."""
        n = self.edits[i] + 1
        if n not in self.trees:
            self.trees[n] = ancestors(n)
        size = len(self.patterns[i])
        return [(size * a // n, size * b // n, b - a - 1) for a, b in self.trees[n][leaf]]

    def _may(self, text: str, i: int, leaf: int, start: int, offset: int, size: int) -> bool:
        """Whether all nodes above an unchanged piece, but for the root, keep to their numbers of edits."""
        pattern = self.patterns[i]
        for a, b, k in self._above(i, leaf):
            if k == 1:
                right = a == offset
                other = pattern[offset + size : b] if right else pattern[a:offset]
                if not beside(text, start + offset + size if right else start + offset, other, right):
                    return False
            around = text[max(0, start + a - k) : start + b + k]
            if nearest(masks_of(pattern[a:b]), b - a, around) > k:
                return False
        return True

    def search(self, text: str) -> dict[int, int]:
        """Index of each pattern that the text holds, with its least number of edits."""
        text, found, tried = normalise(text), {}, set()
        if not text or not self.patterns:
            return found
        for end, (size, where) in self.automaton.iter(text):
            for i, offset, leaf in where:
                k, pattern = self.edits[i], self.patterns[i]
                start = end + 1 - size - offset
                if found.get(i, k + 1) == 0 or (i, start) in tried:
                    continue
                if start >= 0 and text.startswith(pattern, start):
                    found[i] = 0
                elif k and self._may(text, i, leaf, start, offset, size):
                    tried.add((i, start))
                    around = text[max(0, start - k) : start + len(pattern) + k]
                    distance = nearest(masks_of(pattern), len(pattern), around)
                    if distance < found.get(i, k + 1):
                        found[i] = distance
        return found


def _blocks(benchmark: DataFrame, block_chars: int):
    """(the number of blocks, the block's rows), block by block; a block is collected only when its turn comes."""
    size = benchmark.agg(F.sum(F.length(TEXT) + 32)).first()[0] or 0
    n = max(1, -(-size // block_chars))
    for b in range(n):
        mine = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", TEXT), F.lit(n)) == b)
        yield n, [tuple(r) for r in mine.select("item_id", TEXT).collect()]


def find(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = 24, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, edits): each document and each item that it holds."""
    sc, out = docs.sparkSession.sparkContext, None
    schema = T.StructType(
        [docs.schema[ID], T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("edits", T.LongType())]
    )
    for blocks, items in _blocks(benchmark, block_chars):
        shared = sc.broadcast(items)  # rows only; each task builds the automaton

        def run(batches, shared=shared):
            own = Items.of(shared.value, chars_per_edit)
            for batch in slices(batches):
                rows = []
                for doc, text in zip(batch.column(ID).to_pylist(), texts_of(batch), strict=True):
                    rows += [(doc, name, d) for i, d in sorted(own.search(text).items()) for name in own.names[i]]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), to_arrow, strict=True)], names=names
                    )

        names, to_arrow = schema.names, [_arrow(f.dataType) for f in schema]
        found = docs.select(ID, TEXT).mapInArrow(run, schema)
        if blocks > 1:
            found = stored(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def clean(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = 24, block_chars: int = 4_000_000) -> DataFrame:
    """The documents that hold no item, with all their columns; nothing is shuffled."""
    for _, items in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            own = Items.of(shared.value, chars_per_edit)
            for batch in slices(batches):
                yield batch.filter(pa.array([not own.search(t) for t in texts_of(batch)], pa.bool_()))

        docs = docs.mapInArrow(run, schema_with(docs, docs.columns))
    return docs
