"""Token ids in length-delimited binary records, with an offset index.

Documents are encoded, an end id is appended, and the sequences are written in
ascending doc_id order: the files ``part-*`` of a folder in the order of their
numbers, the records of a file in order. A record is

    length of the payload      8 bytes, little-endian
    masked checksum of these   4 bytes
    payload                    flags (1 byte), doc_id (8 bytes), ids
    masked checksum of it      4 bytes
    line feed                  1 byte

The checksum is CRC-32, rotated right by 15 bits plus a constant, so that
a record stored inside a record doesn't check itself. Ids take two bytes where
the vocabulary has at most 65,536 entries, else four; flag 1 says four, flag 2 that the
doc_id is null. Spark's text writer puts the frames down as they are, so files go wherever
Spark can write, and only those of finished tasks stay. The index is a Parquet table with each
record's file, offset, length and number of ids; ``shuffled`` reads records in a random order with it.

Encoding goes by chunks: a blank between two characters that aren't white space always begins a new
word of the tokenizer's pattern, so each distinct chunk is encoded once and its ids
are put together by position; a Python worker keeps its table, of bounded size, from task to task. A full table
keeps what was met again since it was full before. Texts of plain Latin characters are cut into the pattern's words here, and only the library's
model runs on the distinct ones. Tokenizers of another kind encode whole texts.

Files get about ``FILE_BYTES`` of text each, so that a task reads one back within its memory.

Defined results: null and empty texts have the end id only. Null doc_ids come first, ties are ordered by
a hash of the text. doc_id must be a whole number, as the format has eight bytes for it. Columns besides doc_id and text
are not written, whatever their names. An empty table makes no record.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.llm.common import ID, TEXT, slices

MASK_DELTA = 0xA282EAD8
#: Text that goes into one file; a file of records has about as many bytes.
FILE_BYTES = 64 << 20
HEAD, BODY = struct.Struct("<QI"), struct.Struct("<Bq")
WIDE, NO_ID = 1, 2
#: A blank next to other white space: there a chunk may not end.
UNSAFE, SAFE = re.compile(r" \s|\s "), re.compile(r"(?<=\S) (?=\S)")
#: Kinds of the UTF-8 bytes of plain texts: Latin letters up to U+024F, digits, other ASCII marks, and single blanks or line
#: feeds between them. No plain text has a byte of kind OTHER.
LETTER, DIGIT, MARK, BLANK, FEED, OTHER = range(6)
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = MARK
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = KIND[0x80:0xC0] = KIND[0xC3:0xCA] = LETTER
KIND[32], KIND[10] = BLANK, FEED
#: Bytes of text that are encoded at a time; the more, the fewer words are looked up.
SLICE = 4 << 20
#: Words whose ids are put together at a time.
BLOCK = 1 << 18


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc: int | None, ids: np.ndarray, wide: bool) -> bytes:
    flags = WIDE * wide | NO_ID * (doc is None)
    payload = BODY.pack(flags, doc or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked(size)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes, at: int) -> tuple[int | None, np.ndarray, int]:
    """doc_id and ids of the record at an offset, and the offset of the next; an error where a checksum fails."""
    size, check = HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != check:
        raise ValueError(f"bad length at {at}")
    payload = data[at + 12 : at + 12 + size]
    if struct.unpack_from("<I", data, at + 12 + size)[0] != masked(payload):
        raise ValueError(f"bad payload at {at}")
    flags, doc = BODY.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=BODY.size).astype(np.uint32)
    return None if flags & NO_ID else doc, ids, at + size + 17


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from 0 on, and bytes of strings without nulls."""
    if not len(texts):
        return np.zeros(1, np.int32), np.empty(0, np.uint8)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return ends - ends[0], np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]


def plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the tokenizer's pattern in plain texts, and how many each text has: a contraction; letters, digits or marks
    with a blank before them or none; a line feed."""
    ends, data = bytes_of(texts)
    kind, n = KIND[data], len(data)
    starts, first = np.ones(n + 1, bool), np.zeros(n + 3, bool)
    starts[1:n] = (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK)
    first[ends] = True
    starts[ends] = True
    quote = np.flatnonzero((data == ord("'")) & starts[:n])
    one, two = data.take(quote + 1, mode="clip"), data.take(quote + 2, mode="clip")
    short = ~first[quote + 1] & np.isin(one, list(b"stmd"))
    long = ~first[quote + 1] & ~first[quote + 2] & np.isin(one.astype(np.int64) * 256 + two, [a * 256 + b for a, b in (b"re", b"ve", b"ll")])
    starts[quote[short | long] + 1] = False
    starts[np.append(quote[short] + 2, quote[long] + 3)] = True
    at = np.flatnonzero(starts).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
    return words, np.diff(np.searchsorted(at, ends))


class Encoder:
    """Ids of whole texts, by a table of distinct chunks."""

    def __init__(self, path: str, table_rows: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.rows, self.table = Tokenizer.from_file(path), table_rows, pa.array([], pa.string())
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", ())
        self.by_chunk = (
            spec.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in added)
        )
        self.added = [t["content"] for t in added]
        self.letters, self.model = _byte_letters(), self.tokenizer.model
        #: Strings of the table have the numbers of their rows: ids of all, where those of each begin and end, batches that met each again.
        self.coded, self.ends, self.met = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int64)
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    @staticmethod
    def chunks(text: str) -> list[str]:
        first, *rest = SAFE.split(text) if UNSAFE.search(text) else text.split(" ")
        return [first, *[" " + x for x in rest]]

    def keep(self, new: list[str], ids: list[list[int]]) -> None:
        """Put strings that the table lacks into it, with the ids of each."""
        self.table = pa.concat_arrays([self.table, pa.array(new, pa.string())])
        self.coded = np.append(self.coded, np.fromiter(itertools.chain.from_iterable(ids), np.uint32))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum([len(x) for x in ids], dtype=np.int64))
        self.met = np.append(self.met, np.zeros(len(new), np.int64))

    def make_room(self) -> None:
        """Most words are met once only: keep those met again, the most met first, in half of the table."""
        order = np.argsort(-self.met, kind="stable")[: self.rows // 2]
        kept = np.sort(order[self.met[order] > 0])
        self.coded, sizes = self.gather(kept)
        self.table, self.ends, self.met = self.table.take(pa.array(kept)), np.append(0, np.cumsum(sizes)), self.met[kept] // 2

    def learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 5000):
            self.keep(part := new[at : at + 5000], self.ids(part))

    def learn_words(self, new: list[str]) -> None:
        """Encode words that are one word of the pattern each: the library's model alone does that."""
        run, letters = self.model.tokenize, self.letters
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.keep(part, [[t.id for t in run(x.encode().decode("latin-1").translate(letters))] for x in part])

    def numbers(self, strings: pa.Array) -> np.ndarray:
        return pc.index_in(strings, value_set=self.table).fill_null(-1).to_numpy().astype(np.int64)

    def learned(self, words: pa.Array, chunks: pa.Array) -> np.ndarray:
        """The numbers of distinct words and distinct chunks, after those that the table lacks are encoded."""
        found, n = self.numbers(both := pa.concat_arrays([words, chunks])), len(words)
        self.met[found[found >= 0]] += 1
        if len(self.table) + np.count_nonzero(found < 0) > self.rows:
            self.make_room()
            found = self.numbers(both)
        lacks = found < 0
        new, old = both.filter(pa.array(lacks)).to_numpy(zero_copy_only=False).tolist(), len(self.table)
        new, more = new[: (k := np.count_nonzero(lacks[:n]))], new[k:]
        self.learn_words(new)
        found[:n][lacks[:n]] = np.arange(old, old + k)
        if more:
            self.learn(list(set(more).difference(new)))
            found[n:] = self.numbers(chunks)
        return found

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of strings one after the other, and how many each has."""
        sizes = np.diff(self.ends)[numbers]
        made = [self.coded[:0]]
        for at in range(0, len(numbers), BLOCK):
            n = sizes[at : at + BLOCK]
            ends = np.cumsum(n)
            made.append(self.coded[np.repeat(self.ends[numbers[at : at + BLOCK]] - ends + n, n) + np.arange(ends[-1])])
        return np.concatenate(made), sizes

    def plain(self, texts: pa.Array) -> np.ndarray:
        """Which texts have plain characters only and none of the tokenizer's added tokens."""
        ends, data = bytes_of(texts)
        kind = KIND[data]
        bad, blank = kind == OTHER, (kind == BLANK) | (kind == FEED)
        bad[:-1] |= blank[:-1] & blank[1:]
        last = ends[1:][np.diff(ends) > 0] - 1
        bad[last] |= blank[last]
        lead = np.flatnonzero(data >= 0xC3)
        first, second = data[lead], data.take(lead + 1, mode="clip")
        # the signs of multiplication and division; what comes after U+024F
        bad[lead] |= (first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC9) & (second > 0x8F)
        found = np.ones(len(texts), bool)
        found[np.searchsorted(ends, np.flatnonzero(bad), side="right") - 1] = False
        for token in self.added:
            found &= ~pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return found

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text; none is null. Each distinct word of them is looked up once, the rest is done on arrays."""
        if not self.by_chunk:
            return [np.array(x, np.uint32) for x in self.ids(texts if isinstance(texts, list) else texts.to_pylist())]
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        plain = self.plain(texts)
        words, counts = plain_words(texts.filter(pa.array(plain)))
        words = words.dictionary_encode()
        rest = [self.chunks(x) for x in texts.filter(pa.array(~plain)).to_pylist()]
        chunks = pa.array([x for y in rest for x in y], pa.string()).dictionary_encode()
        known = self.learned(words.dictionary, chunks.dictionary)
        ids, sizes = self.gather(known[np.append(words.indices.to_numpy(), chunks.indices.to_numpy() + len(words.dictionary))])
        upto = np.append(0, np.cumsum(sizes))[np.cumsum([0, *counts, *map(len, rest)])].tolist()
        order = np.append(np.flatnonzero(plain), np.flatnonzero(~plain)).tolist()
        coded = {i: ids[a:b] for i, (a, b) in zip(order, itertools.pairwise(upto), strict=True)}
        return [coded[i] for i in range(len(texts))]


@functools.lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One for each Python worker: its table is of use to the next task too."""
    return Encoder(path)


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Encode ``docs`` (doc_id, text) and write records and index below ``path``."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(TEXT))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    ordered = docs.select(F.col(ID).cast("long").alias(ID), TEXT).repartitionByRange(n, F.asc_nulls_first(ID), F.xxhash64(TEXT))
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first(ID), F.xxhash64(TEXT))

    def run(batches):
        encoder = encoder_of(tokenizer_path)
        end = np.array([end_id], np.uint32)
        for batch in slices(batches, SLICE):
            coded = encoder.encode(batch.column(TEXT).fill_null(""))
            made = [frame(doc, np.append(x, end), encoder.wide) for doc, x in zip(batch.column(ID).to_pylist(), coded, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["value"])

    # a cast from binary keeps the bytes; the writer ends each value with a line feed
    ordered.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.text(f"{path}/records")
    index(spark, path).write.parquet(f"{path}/index")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(shard, content): the record files with their numbers, in the order of their names."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/records")
    name = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    # a task that splits its output numbers the files at the end of their names
    split = F.coalesce(F.regexp_extract("path", r"-c(\d+)\.\w+$", 1).try_cast("long"), F.lit(0))
    return read.select((name * 100_000 + split).alias("shard"), "content")


def _records(batches):
    for batch in batches:
        for shard, data in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
            data, at = data.as_py(), 0
            while at < len(data):
                doc, ids, after = unframe(data, at)
                yield shard, at, after - at, doc, ids
                at = after


def _heads(batches):
    """shard, offset, length, doc_id and number of ids of each record, from the heads alone."""
    for batch in batches:
        for shard, data in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
            data, at = memoryview(data.as_buffer()), 0
            while at < len(data):
                size, check = HEAD.unpack_from(data, at)
                if masked(data[at : at + 8]) != check:
                    raise ValueError(f"bad length at {at}")
                flags, doc = BODY.unpack_from(data, at + HEAD.size)
                yield shard, at, size + 17, None if flags & NO_ID else doc, (size - BODY.size) // (4 if flags & WIDE else 2)
                at += size + 17


def index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, offset, length, n_tokens) of each record, read from the files; ``read`` checks the payloads."""

    def run(batches):
        rows = []
        for shard, at, size, doc, n in _heads(batches):
            rows.append((doc, shard, at, size, n))
            if len(rows) == 50_000:
                yield _longs(rows, names)
                rows = []
        if rows:
            yield _longs(rows, names)

    names = [ID, "shard", "offset", "length", "n_tokens"]
    return files(spark, path).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _longs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; start counts the ids of all records before.

    The index gives the number of ids in each file; only these sums, one for each file, reach the driver.
    """
    sums = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    begin, total = {}, 0
    for r in sums:
        begin[r.shard] = total
        total += r.n

    def run(batches):
        rows, last, at = [], None, 0
        for shard, _, _, doc, ids in _records(batches):
            if shard != last:
                last, at = shard, begin[shard]
            rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            at += len(ids)
            if len(rows) == 50_000:
                yield _longs(rows, names)
                rows = []
        if rows:
            yield _longs(rows, names)

    names = [ID, "start", "n_tokens", "ids_crc32"]
    return files(spark, path).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(doc_id, ids) in an order drawn from ``seed``: each file's records are cut out at
    the offsets of the index and dealt out by a hash of seed, file and offset."""
    places = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    joined = files(spark, path).join(places, "shard").select("shard", "content", "offsets")

    def run(batches):
        for batch in batches:
            for shard, data, offsets in zip(*(batch.column(c) for c in ("shard", "content", "offsets")), strict=True):
                data, shard, offsets = data.as_py(), shard.as_py(), offsets.as_py()
                for i in range(0, len(offsets), 1000):
                    part = [(at, *unframe(data, at)[:2]) for at in offsets[i : i + 1000]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([doc for _, doc, _ in part], pa.int64()),
                            pa.array([x.tolist() for *_, x in part], pa.list_(pa.int64())),
                            pa.array([shard] * len(part), pa.int64()),
                            pa.array([at for at, *_ in part], pa.int64()),
                        ],
                        names=[ID, "ids", "shard", "offset"],
                    )

    read_back = joined.mapInArrow(run, f"{ID} long, ids array<long>, shard long, offset long")
    return read_back.orderBy(F.xxhash64(F.lit(seed), "shard", "offset"), "shard", "offset").select(ID, "ids")
