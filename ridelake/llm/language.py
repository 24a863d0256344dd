"""Language identification by a string kernel.

Blended-spectrum presence kernel: the likeness of two texts is the number of
byte n-grams (n = 1, 2, 3, lower-cased UTF-8) that both hold, divided by the
geometric mean of the numbers each holds. N-grams outside the landmarks' own
vocabulary are left out on both sides. The Nyström method replaces the kernel matrix by
likenesses to a few landmark texts, on which one ridge regression per language is fitted,
one against the rest. A batch of texts is scored by two matrix products.

The model is fitted on a bounded sample of labelled rows (``rows_per_lang`` for
each language, ``max_rows`` in all, texts of at most ``max_chars`` code points);
which rows those are depends on their identifiers alone, not on partitions.
Prediction reads whole texts only: neither label, source nor identifier.

Defined results: a null text, an empty one, or one without a letter gives
``und`` with score 0. Rows are independent, so repeated rows get equal results.
A table without labelled rows gives ``und`` for all, an empty one an empty result. The columns asked for pass through,
whatever their names, but for ``lang_pred`` and ``score``, which the result takes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.llm.common import ID, TEXT, schema_with, slices

LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    langs: list[str]
    vocabulary: np.ndarray  # sorted n-gram codes, int64
    landmarks: np.ndarray  # landmark x n-gram, each row scaled to unit length
    weights: np.ndarray  # landmark x language: whitening and ridge weights in one
    sharpness: float  # of the softmax that turns scores into 0..1


def gram_codes(data: np.ndarray) -> np.ndarray:
    """Codes of the 1-, 2- and 3-grams of bytes; the ranges do not overlap."""
    b = data.astype(np.int32)
    two = (b[:-1] << 8 | b[1:]) + 256
    three = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) + 65_792) if len(b) > 2 else b[:0]
    return np.concatenate([b, two, three])


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)


class Scorer:
    """Scores lists of texts. Holds a table from n-gram code to vocabulary index."""

    SIZE = 65_792 + (1 << 24)

    def __init__(self, model: Model):
        self.model = model
        self.index = np.full(self.SIZE, len(model.vocabulary), np.int32)
        self.index[model.vocabulary] = np.arange(len(model.vocabulary))
        self.project = (model.landmarks.T @ model.weights).astype(np.float32)

    def presence(self, texts: list[str]) -> np.ndarray:
        grams = np.zeros((len(texts), len(self.model.vocabulary) + 1), np.float32)
        for row, text in zip(grams, texts, strict=True):
            data = as_bytes(text)
            for at in range(0, len(data), 1 << 20):  # a very long text in parts that overlap
                row[self.index[gram_codes(data[at : at + (1 << 20) + 2])]] = 1
        return grams[:, :-1]

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.presence(texts)
        norm = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
        return x @ self.project / norm

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs = self.model.langs
        if not langs:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        s = self.model.sharpness * self.scores(texts).astype(np.float64)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        best, p = e.argmax(axis=1), e.max(axis=1) / e.sum(axis=1)
        known = [LETTER.search(t) is not None for t in texts]
        return (
            [langs[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)],
            [float(v) if k else 0.0 for v, k in zip(p, known, strict=True)],
        )


def training_rows(docs: DataFrame, rows_per_lang: int, max_rows: int, max_chars: int) -> list:
    """The labelled sample: in each of ``rows_per_lang`` slots of a hash, the row of least hash."""
    rows = docs.where(F.col("lang").isNotNull() & F.col(ID).isNotNull())
    rows = rows.select("lang", F.xxhash64(ID).alias("h"), TEXT).where(
        F.col(TEXT).isNotNull() & (F.length(TEXT) <= max_chars)
    )
    slots = (
        rows.groupBy("lang", F.pmod("h", F.lit(rows_per_lang)).alias("slot"))
        .agg(F.min("h").alias("h"))
        .orderBy("slot", "lang")
        .limit(max_rows)
    )
    wanted = [r.h for r in slots.collect()]
    found = rows.where(F.col("h").isin(wanted)).groupBy("lang", "h").agg(F.min(TEXT).alias(TEXT))
    return sorted((r.lang, r.h, r.text) for r in found.collect()) if wanted else []


def fit(
    docs: DataFrame,
    rows_per_lang: int = 96,
    max_rows: int = 4096,
    max_chars: int = 50_000,
    landmarks: int = 64,
    ridge: float = 0.05,
    vocabulary: int = 8192,
) -> Model:
    """Fit on the labelled rows of ``docs`` (columns doc_id, text, lang), which the caller
    has restricted to those that may be learned from."""
    rows = [r for r in training_rows(docs, rows_per_lang, max_rows, max_chars) if LETTER.search(r[2])]
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.empty(0, np.int64), np.empty((0, 0)), np.empty((0, 0)), 1.0)
    own = {lang: [r for r in rows if r[0] == lang] for lang in langs}
    each = max(2, landmarks // len(langs))
    # the longest texts of a language make the best landmarks: they hold most of its n-grams
    marks = [r for lang in langs for r in sorted(own[lang], key=lambda r: (-len(r[2]), r[1]))[:each]]
    counted: dict[int, int] = {}
    for _, _, text in marks:
        for code in np.unique(gram_codes(as_bytes(text))).tolist():
            counted[code] = counted.get(code, 0) + 1
    common = sorted(counted, key=lambda c: (-counted[c], c))[:vocabulary]
    model = Model(langs, np.array(sorted(common), np.int64), np.zeros((1, len(common))), np.zeros((1, 1)), 1.0)
    scorer = Scorer(model)

    def unit(texts: list[str]) -> np.ndarray:
        x = scorer.presence(texts).astype(np.float64)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    land, x = unit([r[2] for r in marks]), unit([r[2] for r in rows])
    value, vector = np.linalg.eigh(land @ land.T)
    keep = value > 1e-9 * value[-1]
    whiten = vector[:, keep] / np.sqrt(value[keep])
    phi = x @ land.T @ whiten
    share = np.array([1 / len(own[r[0]]) for r in rows])[:, None]  # languages weigh the same
    target = np.array([[1.0 if r[0] == lang else -1.0 for lang in langs] for r in rows])
    solved = np.linalg.solve(phi.T @ (phi * share) + ridge * np.eye(phi.shape[1]) / 10, phi.T @ (target * share))
    return Model(langs, model.vocabulary, land, whiten @ solved, 4.0)


def held_out(doc_id: str | Column = ID) -> Column:
    """Documents that nothing is learned from: crc32 of the identifier as text, modulo 4, is 2."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted(least: float = 0.3) -> Column:
    """Of predicted rows: those with a language, of a score that says more than chance among four."""
    return (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score. ``keep``: the columns to carry, all by default."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*dict.fromkeys([*keep, TEXT]))

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            langs, scores = [], []
            texts = [x or "" for x in batch.column(TEXT).to_pylist()]
            for at in range(0, len(texts), 512):
                a, b = scorer.predict(texts[at : at + 512])
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    return source.mapInArrow(run, schema_with(source, keep, lang_pred="string", score="double"))
