"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the vocabulary has a whitespace marker behind another character,
so merges never cross from a character to the marker after it: a text is
the sequence of its chunks, each a run of markers with the characters up to
the next marker. Every distinct chunk is segmented and decoded once by the
library; ids and decoded strings are then put together by position. A Python worker
keeps its table from task to task and empties it at ``table_rows`` entries, so memory is
bounded and results don't depend on it. A model whose pieces do cross markers,
or that normalises texts otherwise, is applied to whole texts instead.

A shuffle of one row for each word of the corpus, which a table of the whole cluster
would need, moves several times the input; the table of a task needs none.

Defined results: null and empty texts have no ids and decode to the empty
text. Rows are independent; very long ones go through in their batch alone. The columns asked for pass through, but for
``ids`` and ``decoded``, whose names the results take. An empty table gives an empty one.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ridelake.llm.common import TEXT, schema_with, slices

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Texts whose normal form shows whether a model only adds and escapes markers.
PROBES = ("a", " a  b ", "A\tb\n\nc ", "Åﬁ①  x　y", "")


class Codec:
    def __init__(self, model_path: str, table_rows: int = 150_000):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=model_path)
        self.rows, self.ids, self.decoded = table_rows, {}, {}
        names = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        apart = not any(MARK in p.lstrip(MARK) for p in names)
        plain = all(self.model.normalize(x) == (MARK + x.replace(" ", MARK) if x else "") for x in PROBES)
        self.by_chunk = apart and plain

    def chunks(self, text: str) -> list[str]:
        """The chunks without the marker each begins with."""
        if "  " in text or MARK in text or text[0] == " ":
            return [x[1:] for x in CHUNK.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def learn(self, chunks: set[str]) -> None:
        if len(self.ids) + len(chunks.difference(self.ids)) > self.rows:
            self.ids.clear()
            self.decoded.clear()
        new = list(chunks.difference(self.ids))
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            # the marker alone is a chunk of its own at the end of a text
            ids = [x or [self.model.piece_to_id(MARK)] for x in self.model.encode(part, num_threads=1)]
            self.ids.update(zip(part, (np.array(x, np.int32).tobytes() for x in ids), strict=True))
            self.decoded.update(zip(part, (" " + x for x in self.model.decode(ids, num_threads=1)), strict=True))

    def encode_decode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Of each text the ids, as little-endian 32-bit integers, and the decoded text."""
        if not self.by_chunk:
            ids = [self.model.encode(t) for t in texts]
            return [np.array(x, np.int32).tobytes() for x in ids], [self.model.decode(x) if x else "" for x in ids]
        cut = [self.chunks(t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        ids, decoded = self.ids.__getitem__, self.decoded.__getitem__
        return [b"".join(map(ids, x)) for x in cut], ["".join(map(decoded, x))[1:] for x in cut]


@functools.lru_cache(1)
def codec_of(model_path: str) -> Codec:
    """One for each Python worker: its table is of use to the next task too."""
    return Codec(model_path)


def encode(docs: DataFrame, model_path: str, keep: list[str], decode: bool = True) -> DataFrame:
    """The columns ``keep``, then ids (array of int) and, unless ``decode`` is false, decoded."""
    keep = [c for c in keep if c not in ("ids", "decoded")]
    source = docs.select(*dict.fromkeys([*keep, TEXT]))
    added = {"ids": "array<int>"} | ({"decoded": "string"} if decode else {})

    def run(batches):
        codec = codec_of(model_path)
        for batch in slices(batches, 4 << 20):
            data, decoded = codec.encode_decode([x or "" for x in batch.column(TEXT).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in data)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(data), np.int32)))
            columns = [*(batch.column(c) for c in keep), ids] + ([pa.array(decoded, pa.string())] if decode else [])
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *added])

    return source.mapInArrow(run, schema_with(source, keep, **added))
