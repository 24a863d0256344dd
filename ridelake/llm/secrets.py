"""Secrets in texts: fixed patterns, and a character convolutional network for the rest.

Three patterns give the base findings: assigned values (``assign``), access keys (``access``) and
hexadecimal runs (``hex``). Every other run of eight token characters or more, cut where such a finding lies in it, is a candidate, unless it has a plain shape: words
and numbers joined by separators (of these, runs of 16 characters with a digit and single words of 24 letters are candidates
all the same). A small network, in numpy, reads each candidate with the characters
around it: character classes, embedded, one convolution, maximum and mean over
positions, one logistic output. A long candidate is read whole, in overlapping stretches. Stretches above the
threshold are added as ``learned``, those of one candidate that overlap as one.

It is trained on labelled findings of all documents: those of the base patterns, generated keys of other shapes put
into every document, and, as negatives, the other candidates of a harmless shape and generated harmless
ones; other candidates have no label and are left out. Tasks sum gradients over their examples and the driver takes the
steps; every example that isn't held back is in as many steps as any other, one more or less. The part held back from
training calibrates the output (Platt scaling) and sets the threshold, by exact counts of all its
logits in steps of ``GRID``: the highest that finds at least ``recall`` of the held-back secrets. ``precision`` is the share of secrets among the held-back examples it finds, ``recall`` the share of secrets it finds.

Defined results: a null text is an empty one and has no findings. Rows are independent. Offsets
count code points. Long texts are read whole. The columns asked for pass through, whatever their names, but for
``findings``, which the result takes. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.llm.common import ID, TEXT, drop_stored, schema_with, slices, stored, texts_of

ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-](?:\.?[A-Za-z0-9+/_=-]){7,}")
#: Numbers and plain words with a short number, joined by separators: no secrets.
PLAIN = r"(?:[A-Z]?[a-z]++[0-9]{0,4}+|[A-Z]++[0-9]{0,4}+|[0-9]++)"
HARMLESS = re.compile(rf"[-_/=+.]*+{PLAIN}(?:[-_/=+.]++{PLAIN})*+[-_/=+.]*+")
LETTERS = re.compile(r"[A-Za-z]{24,}")
DIGIT = re.compile(r"[0-9]")
BEHIND = re.compile(r"[-_/=+.]*+")
KINDS = ("assign", "access", "hex", "learned")
#: Characters shown before a candidate, of its head, of its tail, and after it.
BEFORE, HEAD, TAIL, AFTER = 20, 28, 12, 12
WIDTH = BEFORE + HEAD + TAIL + AFTER
#: Steps of logits as they are used, up to ``TOP`` on both sides.
GRID, TOP = 256, 64
#: Steps of training, the least number of examples for one, and the most parts that take turns in them.
STEPS, LEAST, PARTS = 96, 512, 48


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, by start and then by kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


def suspect(text: str, a: int, b: int) -> bool:
    """Whether a run is a candidate for the network."""
    if not HARMLESS.fullmatch(text, a, b):
        return True
    return (b - a >= 16 and DIGIT.search(text, a, b) is not None) or LETTERS.fullmatch(text, a, b) is not None


def runs(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Runs of token characters outside the spans in ``taken``. One that a span lies in is cut there, and what is left on each side is a
    run of its own if it is long enough; separators right behind the span don't belong to it."""
    out, at = [], 0
    for a, b, _ in [*sorted(taken), (len(text), len(text), "")]:
        if at < a:
            out += [m.span() for m in CANDIDATE.finditer(text, BEHIND.match(text, at, a).end() if at else 0, a)]
        at = max(at, b)
    return out


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Every run that the network reads."""
    return [(a, b) for a, b in runs(text, taken) if suspect(text, a, b)]


def stretches(a: int, b: int) -> list[tuple[int, int]]:
    """A candidate as the network reads it: whole, or in stretches of which each overlaps half of the one before."""
    size = HEAD + TAIL
    if b - a <= size:
        return [(a, b)]
    return [(i, i + size) for i in range(a, b - size, size // 2)] + [(b - size, b)]


def _classes() -> np.ndarray:
    """Class of each character below 128; 0 is padding, the last one any other character."""
    out = np.full(129, 11, np.uint8)
    for cls, chars in enumerate(
        ("abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", "\"'`", "=:", "-_", "./+"), 1
    ):
        out[[ord(c) for c in chars]] = cls
    out[11] = 11
    out[128] = 12
    return out


CLASSES = _classes()
N_CLASSES = 13


def window(text: str, start: int, end: int) -> str:
    body = text[start:end]
    head, tail = body[:HEAD], body[HEAD:][-TAIL:]
    before, after = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    return before.rjust(BEFORE, "\0") + head.ljust(HEAD, "\0") + tail.ljust(TAIL, "\0") + after.ljust(AFTER, "\0")


def encoded(windows: list[str]) -> np.ndarray:
    codes = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(len(windows), WIDTH)
    out = CLASSES[np.minimum(codes, 128)]
    out[codes == 0] = 0
    return out


@dataclass
class Network:
    embed: np.ndarray  # class, place (outside or inside the candidate) -> vector
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    scale: np.ndarray  # Platt: slope and offset
    threshold: float = 0.5
    precision: float = 0.0
    recall: float = 0.0

    SPAN = 5

    @classmethod
    def new(cls, seed: int, dim: int = 8, filters: int = 24) -> Network:
        r = np.random.default_rng(seed)
        return cls(
            r.normal(0, 0.5, (2 * N_CLASSES, dim)),
            r.normal(0, (2 / (cls.SPAN * dim)) ** 0.5, (cls.SPAN * dim, filters)),
            np.zeros(filters),
            np.concatenate([r.normal(0, 0.2, 2 * filters), [0.0]]),
            np.array([1.0, 0.0]),
        )

    def forward(self, x: np.ndarray):
        inside = np.zeros(WIDTH, np.int64)
        inside[BEFORE : BEFORE + HEAD + TAIL] = N_CLASSES
        index = x.astype(np.int64) + inside
        e = self.embed[index]
        patches = np.lib.stride_tricks.sliding_window_view(e, self.SPAN, axis=1)  # row, place, dim, span
        patches = patches.transpose(0, 1, 3, 2).reshape(len(x), WIDTH - self.SPAN + 1, -1)
        z = patches @ self.filters + self.bias
        a = np.maximum(z, 0)
        pooled = np.concatenate([a.max(axis=1), a.mean(axis=1), np.ones((len(x), 1))], axis=1)
        return index, patches, z, a, pooled, pooled @ self.dense

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[i : i + 1024])[-1] for i in range(0, len(x), 1024)]
        return np.concatenate(parts) if parts else np.empty(0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._calibrated(self.rounded(x) / GRID)

    def rounded(self, x: np.ndarray) -> np.ndarray:
        """Logits in whole steps, so that those of a table can be counted."""
        return np.round(np.clip(self.logits(x), -TOP, TOP) * GRID).astype(np.int64)

    def _calibrated(self, s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * s + self.scale[1], -30, 30)))

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        index, patches, z, a, pooled, out = self.forward(x)
        d = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) * weight / len(x)
        n = self.filters.shape[1]
        da = np.broadcast_to((d[:, None] * self.dense[n : 2 * n])[:, None, :] / a.shape[1], a.shape).copy()
        rows, cols = np.ogrid[: len(x), :n]
        da[rows, a.argmax(axis=1), cols] += d[:, None] * self.dense[:n]
        dz = da * (z > 0)
        dp = (dz @ self.filters.T).reshape(len(x), dz.shape[1], self.SPAN, -1)
        each = np.zeros((*index.shape, self.embed.shape[1]))
        for j in range(self.SPAN):
            each[:, j : j + dz.shape[1]] += dp[:, :, j]
        de = np.stack([np.bincount(index.ravel(), each[:, :, k].ravel(), len(self.embed)) for k in range(each.shape[2])], axis=1)
        flat = patches.reshape(-1, patches.shape[2])
        return [de, flat.T @ dz.reshape(-1, n), dz.sum(axis=(0, 1)), pooled.T @ d]

    def train(self, gradient, steps: int = STEPS, rate: float = 0.02) -> None:
        """Adam; ``gradient(step)`` gives the gradients of the parameters at this step's examples."""
        own = [self.embed, self.filters, self.bias, self.dense]
        first, second = [np.zeros_like(p) for p in own], [np.zeros_like(p) for p in own]
        for step in range(1, steps + 1):
            pace = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for p, g, m, v in zip(own, gradient(step - 1), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        s, at = np.unique(self.rounded(x), return_inverse=True)
        self.calibrate_counts(s, np.bincount(at, y > 0, len(s)), np.bincount(at, y <= 0, len(s)), recall)

    def calibrate_counts(self, s: np.ndarray, pos: np.ndarray, neg: np.ndarray, recall: float) -> None:
        """Slope, offset and threshold from the numbers of secrets and others at each logit, in ascending steps."""
        s, n = s / GRID, pos + neg
        for _ in range(200):  # Platt scaling by Newton steps
            p = self._calibrated(s)
            w, d = n * (p * (1 - p) + 1e-6), n * p - pos
            g = np.array([(d * s).sum() + 1e-3 * self.scale[0], d.sum()])
            h = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-9]])
            move = np.linalg.solve(h, g)
            self.scale = self.scale - np.clip(move, -1, 1)
            if np.abs(move).max() < 1e-6:
                break
        scores = self._calibrated(s)
        order = np.argsort(scores, kind="stable")
        found = np.cumsum(pos[order])
        allowed = int((1 - recall) * pos.sum())
        self.threshold = float(scores[order][np.searchsorted(found, allowed, side="right")]) - 1e-9 if pos.sum() else 1.1
        hit = scores >= self.threshold
        self.precision = float(pos[hit].sum() / n[hit].sum()) if n[hit].sum() else 0.0
        self.recall = float(pos[hit].sum() / pos.sum()) if pos.sum() else 0.0


def makers(r: np.random.Generator) -> tuple[tuple, tuple]:
    """Functions that make up keys, and those that make up harmless tokens."""
    pick = lambda chars, k: "".join(chars[i] for i in r.integers(len(chars), size=k).tolist())
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    keys = (
        lambda: pick(lower + upper + digit, r.integers(20, 44)),
        lambda: pick(lower + upper + digit + "+/", r.integers(24, 60)) + "=" * r.integers(0, 3),
        lambda: pick("ghx", 3) + "_" + pick(lower + upper + digit, 36),
        lambda: "sk-" + pick(lower + upper + digit, r.integers(24, 48)),
        lambda: pick("ABCDEF" + digit, r.integers(24, 48)),
        lambda: pick(lower + digit, r.integers(20, 44)),
        lambda: pick(lower + upper + digit, r.integers(9, 20)),
        lambda: pick(lower + upper, r.integers(18, 44)),
        lambda: "eyJ" + pick(lower + upper + digit, r.integers(15, 30)) + ".eyJ" + pick(lower + upper + digit + "-_", r.integers(20, 60)) + "." + pick(lower + upper + digit + "-_", 43),
        lambda: "".join(pick(lower, r.integers(3, 7)) + pick(digit, r.integers(1, 4)) for _ in range(3)),
    )
    plain = (
        lambda: pick(digit, r.integers(16, 22)),
        lambda: "-".join(pick(digit, k) for k in (4, 4, 4, 4)),
        lambda: f"20{pick('012', 1)}{pick(digit, 1)}-0{pick('123456789', 1)}-1{pick(digit, 1)}-" + pick(lower, r.integers(6, 20)),
        lambda: pick(lower, r.integers(6, 12)) + "/" + pick(lower, r.integers(6, 12)) + pick(digit, 1),
        lambda: pick(lower, r.integers(14, 24)) + pick(digit, r.integers(1, 3)),
        lambda: "_".join(pick(lower, r.integers(3, 8)) for _ in range(4)) + "_" + pick(digit, 2),
        lambda: pick(lower, r.integers(3, 8)) + "".join(pick(upper, 1) + pick(lower, r.integers(3, 8)) for _ in range(3)),
        lambda: "v" + ".".join(pick(digit, 1) for _ in range(3)) + "-" + pick(lower, 4) + pick(digit, 1) + pick(lower, 3),
        lambda: "/".join(pick(lower, r.integers(3, 9)) for _ in range(3)) + "/" + pick(upper, 1) + pick(lower, 5) + pick(upper, 1) + pick(lower, 4) + "." + pick(lower, 2),
        lambda: pick(lower, r.integers(3, 8)) + pick(digit, 2) + pick(lower, 2) + "-" + pick(lower, r.integers(3, 8)),
    )
    return keys, plain


def planted(r: np.random.Generator, text: str, token: str) -> list[str]:
    """Windows of ``token`` put into a place of ``text``."""
    cut = int(r.integers(len(text) + 1))
    before, after = text[max(0, cut - BEFORE) : cut] + " ", " " + text[cut : cut + AFTER]
    whole, a = before + token + after, len(before)
    return [window(whole, i, j) for i, j in stretches(a, a + len(token))]


def generated(contexts: list[str], n: int, seed: int) -> list[tuple[str, int]]:
    """Windows of made-up keys (1) and of made-up harmless tokens (0) in the given contexts."""
    r = np.random.default_rng(seed)
    keys, plain = makers(r)
    out = []
    for i in range(n):
        for label, made in ((1, keys), (0, plain)):
            token = made[i % len(made)]()
            text = contexts[int(r.integers(len(contexts)))] if contexts else ""
            out += [(w, label) for w in planted(r, text, token)]
    return out


def labelled(text: str, made: int, seed: int) -> list[tuple[str, int]]:
    """Windows of a text with their labels: its base findings, its other harmless runs, and ``made`` made-up tokens put into it."""
    out, spans = [], base_spans(text)
    for a, b, kind in spans:
        out.append((window(text, ASSIGN.match(text, a).start(2) if kind == "assign" else a, b), 1))
    out += [(window(text, a, b), 0) for a, b in runs(text, spans) if b - a <= HEAD + TAIL and DIGIT.search(text, a, b) and HARMLESS.fullmatch(text, a, b)]
    r = np.random.default_rng([seed, zlib.crc32(text.encode())])
    kinds = makers(r)
    for label in r.integers(2, size=made).tolist():
        some = kinds[1 - label]
        out += [(w, label) for w in planted(r, text, some[int(r.integers(len(some)))]())]
    return out


def examples(docs: DataFrame, made: int, seed: int) -> DataFrame:
    """(x, y, back, place): the encoded windows of all documents, their labels, whether they are held back, and a hash below 2^32.

    A window is trained on or held back by its own hash, so equal windows fall on one side.
    """

    def run(batches):
        for batch in slices(batches, 1 << 20):
            for at in range(0, batch.num_rows, 500):
                found = [e for text in texts_of(batch.slice(at, 500)) for e in labelled(text, made, seed)]
                if not found:
                    continue
                hashes = [hashlib.blake2b(w.encode(), digest_size=8).digest() for w, _ in found]
                x = encoded([w for w, _ in found]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[i : i + WIDTH] for i in range(0, len(x), WIDTH)], pa.binary()),
                        pa.array([y for _, y in found], pa.int64()),
                        pa.array([h[0] % 4 == 0 for h in hashes], pa.bool_()),
                        pa.array([int.from_bytes(h[1:5], "little") for h in hashes], pa.int64()),
                    ],
                    names=["x", "y", "back", "place"],
                )

    return docs.select(TEXT).mapInArrow(run, "x binary, y long, back boolean, place long")


def _windows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.uint8).reshape(-1, WIDTH)


def _gradient(part: DataFrame, network: Network, weight: tuple[float, float]) -> list[np.ndarray]:
    """Mean gradients over the rows of ``part``, rounded, so that the order of the sums doesn't show; only sums reach the driver."""

    def run(batches):
        total, n = 0.0, 0
        for batch in batches:
            x, y = _windows(batch), batch.column("y").to_numpy().astype(float)
            for at in range(0, len(x), 512):
                some, label = x[at : at + 512], y[at : at + 512]
                parts = network.gradients(some, label, np.where(label > 0, weight[1], weight[0]))
                total, n = total + len(some) * np.concatenate([g.ravel() for g in parts]), n + len(some)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()]), pa.array([n], pa.int64())], names=["sums", "n"])

    rows = part.select("x", "y").mapInArrow(run, "sums binary, n long").collect()
    own = [network.embed, network.filters, network.bias, network.dense]
    if not rows:
        return [np.zeros_like(p) for p in own]
    mean = np.sum([np.frombuffer(r.sums) for r in rows], axis=0) / sum(r.n for r in rows)
    mean = np.round(mean * (1 << 24)) / (1 << 24)
    cuts = np.cumsum([p.size for p in own])[:-1]
    return [g.reshape(p.shape) for g, p in zip(np.split(mean, cuts), own, strict=True)]


def _logits(back: DataFrame, network: Network) -> DataFrame:
    """(s, y, count): how many examples have each rounded logit and label."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(network.rounded(_windows(batch))), batch.column("y")], names=["s", "y"])

    return back.select("x", "y").mapInArrow(run, "s long, y long").groupBy("s", "y").count()


def fit(docs: DataFrame, rows: int | None = None, made: int = 800, recall: float = 0.97, seed: int = 7) -> Network:
    """Train on all documents, each with a made-up token at least and all together with twice ``made`` or more.

    ``rows``: for trials, the number of documents of least text hash to train on; all of them by default.
    """
    if rows is not None:
        docs = docs.orderBy(F.xxhash64(TEXT), TEXT).limit(rows)
    each = max(1, -(-2 * made // max(1, docs.count())))
    known = stored(examples(docs, each, seed).sortWithinPartitions("back", "place"))
    sizes = {(r.back, r.y): r["count"] for r in known.groupBy("back", "y").count().collect()}
    neg, pos = (sizes.get((False, y), 0) for y in (0, 1))
    weight = tuple(0.5 * (neg + pos) / max(1, n) for n in (neg, pos))  # both labels weigh the same
    turns = min(PARTS, max(1, (neg + pos) // LEAST))
    place = F.col("place")

    def gradient(step: int) -> list[np.ndarray]:
        at = step % turns
        low, high = (at << 32) // turns, ((at + 1) << 32) // turns
        return _gradient(known.where(~F.col("back") & (place >= low) & (place < high)), network, weight)

    network = Network.new(seed)
    if neg + pos:
        network.train(gradient)
    counts: dict[int, list[int]] = {}
    for r in _logits(known.where("back"), network).collect():
        counts.setdefault(r.s, [0, 0])[r.y] += r["count"]
    s = sorted(counts)
    table = np.array([counts[x] for x in s], float).reshape(-1, 2)
    network.calibrate_counts(np.array(s, np.int64), table[:, 1], table[:, 0], recall)
    drop_stored(known)
    return network


def scan(docs: DataFrame, network: Network, keep: list[str]) -> DataFrame:
    """The columns ``keep``, then ``findings``: an array of (start, end, kind, score)."""
    keep = [c for c in keep if c != "findings"]
    shared = docs.sparkSession.sparkContext.broadcast(network)
    source = docs.select(*dict.fromkeys([*keep, TEXT]))
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])

    def run(batches):
        net = shared.value
        for batch in slices(batches):
            rows, waiting = [], []
            for i, text in enumerate(texts_of(batch)):
                spans = base_spans(text)
                rows.append([(a, b, k, 1.0) for a, b, k in spans])
                waiting += [(i, *x, window(text, *x)) for c in candidates(text, spans) for x in stretches(*c)]
            for at in range(0, len(waiting), 4096):
                part = waiting[at : at + 4096]
                for (i, a, b, _), p in zip(part, net.probabilities(encoded([w[3] for w in part])), strict=True):
                    if p >= net.threshold:
                        last = rows[i][-1] if rows[i] else (0, -1, "", 0.0)
                        if last[2] == "learned" and a < last[1]:
                            rows[i][-1] = (last[0], b, "learned", max(last[3], float(p)))
                        else:
                            rows[i].append((a, b, "learned", float(p)))
            order = lambda r: (r[0], KINDS.index(r[2]))
            found = [[dict(zip(("start", "end", "kind", "score"), x, strict=True)) for x in sorted(r, key=order)] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(found, pa.list_(item))], names=[*keep, "findings"]
            )

    kind = "array<struct<start: bigint, end: bigint, kind: string, score: double>>"
    return source.mapInArrow(run, schema_with(source, keep, findings=kind))
