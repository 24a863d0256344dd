"""WARC archives as a data source: written by Spark's tasks, read back with predicates on their headers.

``spark.read.format("warc")`` (after ``read`` or ``register``) gives a row for each record. Partitions are planned from the list of
archives: small ones share a task, and those of this writer can be cut at the offsets of records that their commit notes.
Filters on the record's type and on other headers are pushed into the scan. A record's headers are parsed first; its
HTTP headers only if a column asks for them; its payload is inflated and decoded only where the schema names ``payload`` and the filters
hold. A record that is not wanted is skipped by the length that the gzip member carries (the ``sl`` field of the WARC
standard), by Content-Length in plain archives, and is inflated without being kept where an archive of other origin has neither.

``archive`` writes pages. Of records with equal payloads of at least ``REVISIT`` bytes the one of largest page_id is a response and the
others are revisits that name it and hold no payload. Digests are counted in a narrow table first;
groups of copies, one row each, are broadcast while there are ``BROADCAST`` or fewer, and joined by their digests beyond
that, the pages being the streamed side, so that a group of many copies can be split.

A task writes archives under names of its own, and the commit lists those of the tasks that succeeded; readers of a folder with such lists
read no others, so a lost executor or a second attempt leaves no half archive in a result. Paths are
those that Arrow's file systems know (file, hdfs, s3, gs, abfss).

Defined results: a null html is an empty payload; payloads below ``REVISIT`` bytes are responses; rows that share the largest page_id of their
group are all responses; a null page_id is below any other and comes back null. A null url has no WARC-Target-URI; control characters in one are
percent-encoded. An empty table gives archives without records of pages. Other columns of pages are not written. Digests come back as ``sha1:`` and
lower-case hex, whether the archive has hex or base 32. Anything that is no record raises ValueError with archive and offset.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ridelake.llm.common import stored

SCHEMA = """archive string, offset long, record_type string, record_id string, date string, target_uri string, refers_to string,
refers_to_uri string, payload_digest string, content_type string, content_length long, headers map<string,string>,
http_status int, http_length long, http_headers map<string,string>, payload binary"""
#: Columns that come from a header, by its name.
HEADERS = {
    "record_type": "warc-type", "record_id": "warc-record-id", "date": "warc-date", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to",
    "refers_to_uri": "warc-refers-to-target-uri", "payload_digest": "warc-payload-digest", "content_type": "content-type", "content_length": "content-length",
}
HTTP = {"http_status", "http_length", "http_headers"}
#: The profile of a revisit that says its payload is that of another record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a payload from which copies become revisits.
REVISIT = 1000
#: Groups of copies that are broadcast, of about 200 bytes each.
BROADCAST = 100_000


# Records


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own length and that of the record."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    end = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    if (size := 24 + len(body) + 8) >= 1 << 32 or len(record) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + bytes(5) + b"\xff" + body + end
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record)) + body + end


def record_bytes(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _skip_length(head: bytes) -> int | None:
    """The length of a gzip member from its extra field."""
    if len(head) < 12 or not head[3] & 4:
        return None
    at, end = 12, 12 + struct.unpack_from("<H", head, 10)[0]
    while at + 4 <= min(end, len(head)):
        name, size = struct.unpack_from("<2sH", head, at)
        if name == b"sl" and size == 8 and at + 12 <= len(head):
            return struct.unpack_from("<I", head, at + 4)[0]
        at += 4 + size
    return None


class _Window:
    """A file read by blocks, at any place."""

    def __init__(self, file, block: int = 1 << 20):
        self.file, self.block, self.lo, self.data = file, block, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.lo <= at <= at + n <= self.lo + len(self.data):
            self.file.seek(at)
            self.lo, self.data = at, self.file.read(max(n, self.block))
        return self.data[at - self.lo : at - self.lo + n]


class _Stream:
    """The bytes of one gzip member, inflated no further than asked for, or those of a plain archive from a place on."""

    CHUNK = 4096

    def __init__(self, window: _Window, at: int):
        self.window, self.begin, self.at, self.out = window, at, at, bytearray()
        gz = window.get(at, 2) == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if gz else None
        self.skip = _skip_length(window.get(at, 64)) if gz else None

    def more(self) -> bool:
        """Some more bytes; False at the end of the member or file."""
        if self.inflate and self.inflate.eof:
            return False
        chunk = self.window.get(self.at, self.CHUNK if len(self.out) < self.CHUNK else self.window.block)
        self.at += len(chunk)
        if self.inflate:
            self.out += self.inflate.decompress(chunk)
            self.at -= len(self.inflate.unused_data)
        else:
            self.out += chunk
        return bool(chunk)

    def find(self, what: bytes, start: int, end: int | None = None) -> int:
        """Where ``what`` begins in the bytes at hand or behind them, before ``end``; -1 if nowhere."""
        seen = start
        while (i := self.out.find(what, seen, end)) < 0:
            seen = max(start, len(self.out) - len(what))
            if end is not None and len(self.out) >= end or not self.more():
                break
        return i

    def take(self, n: int) -> bool:
        """Have ``n`` bytes at hand."""
        while len(self.out) < n:
            if not self.more():
                return False
        return True

    def drop(self, n: int) -> bool:
        """Go ``n`` bytes on without keeping what lies between; False if the member ends before."""
        while n > len(self.out):
            n -= len(self.out)
            self.out.clear()
            if not self.inflate:
                self.at += n
                return True
            if not self.more():
                return False
        del self.out[:n]
        return True

    def record(self) -> bool:
        """Go over line ends; whether anything follows."""
        while self.take(2) and self.out.startswith(b"\r\n"):
            del self.out[:2]
        return bool(self.out)

    @property
    def behind(self) -> int:
        return self.begin + self.skip if self.skip else self.at if self.inflate else self.at - len(self.out)


def _fields(text: bytes) -> dict[str, str]:
    """Header lines by name as given; a line that begins with white space continues the last one."""
    out: dict[str, str] = {}
    name = None
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            out.setdefault(name, value.strip())
    return out


def _digest(value: str | None) -> str | None:
    if value and ":" in value:
        kind, digits = value.split(":", 1)
        if kind.lower() == "sha1" and re.fullmatch(r"[A-Za-z2-7]{32}", digits):
            digits = base64.b32decode(digits.upper()).hex()
        return f"{kind.lower()}:{digits.lower()}"
    return value


def _columns(lower: dict[str, str]) -> dict:
    row = {c: lower.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to", "target_uri"):
        row[c] = row[c] and row[c].removeprefix("<").removesuffix(">")
    row["content_length"] = int(row["content_length"] or 0)
    row["payload_digest"] = _digest(row["payload_digest"])
    return row


def records(file, name: str, start: int, end: int, wanted: set[str], keep=lambda row: True) -> Iterator[dict]:
    """The records that begin in [start, end) and that ``keep`` takes by their headers, with the columns ``wanted``."""
    window, at, whole = _Window(file), start, file.size()
    while at < end:
        stream = _Stream(window, at)
        while stream.record():
            place = at if stream.inflate else stream.behind
            stop = stream.find(b"\r\n\r\n", 0)
            if stop < 0 or not stream.out.startswith(b"WARC/"):
                raise ValueError(f"{name}: no record at {place}")
            headers = _fields(bytes(stream.out[:stop]))
            row = _columns({k.lower(): v for k, v in reversed(headers.items())})
            size, begin = row["content_length"], stop + 4
            if keep(row):
                if wanted & HTTP or "payload" in wanted:
                    _body(stream, row, begin, size, wanted)
                    if "payload" in wanted and len(stream.out) < begin + size:
                        raise ValueError(f"{name}: the record at {place} is cut off")
                yield row | {"archive": name, "offset": place, "headers": headers}
            if stream.skip:
                break
            if not stream.drop(begin + size) or stream.behind > whole:
                raise ValueError(f"{name}: the record at {place} is cut off")
            if not stream.inflate and stream.behind >= end:
                break
        at = stream.behind
        if at > whole:
            raise ValueError(f"{name}: the last record is cut off")


def _body(stream: _Stream, row: dict, begin: int, size: int, wanted: set[str]) -> None:
    """Adds HTTP columns and the payload; nothing behind the HTTP headers is inflated unless the payload is wanted."""
    row["payload"], body = None, begin
    if (row["content_type"] or "").lower().startswith("application/http"):
        stop = stream.find(b"\r\n\r\n", begin, begin + size)
        body = begin + size if stop < 0 else stop + 4
        text = bytes(stream.out[begin : begin + size if stop < 0 else stop])
        headers = _fields(text)
        lower = {k.lower(): v for k, v in reversed(headers.items())}
        status = re.match(rb"HTTP/\S+ (\d{3})", text)
        length = lower.get("content-length", "")
        row |= {"http_status": int(status[1]) if status else None, "http_headers": headers, "http_length": int(length) if length.isdigit() else None}
    if "payload" in wanted and row["record_type"] != "revisit" and stream.take(begin + size):
        row["payload"] = bytes(stream.out[body : begin + size])


# Predicates


def _holds(f: D.Filter, row: dict) -> bool | None:
    """A filter's value for a row of headers: True, False, or None for unknown."""
    if isinstance(f, D.Not):
        return None if (x := _holds(f.child, row)) is None else not x
    value = row[f.attribute[0]]
    if isinstance(f, D.IsNull):
        return value is None
    if isinstance(f, D.IsNotNull):
        return value is not None
    if isinstance(f, D.EqualNullSafe):
        return value == f.value
    if value is None:
        return None
    if isinstance(f, D.In):
        return True if value in [x for x in f.value if x is not None] else None if None in f.value else False
    return _TESTS[type(f)](value, f.value)


_TESTS = {
    D.EqualTo: lambda a, b: a == b,
    D.GreaterThan: lambda a, b: a > b,
    D.GreaterThanOrEqual: lambda a, b: a >= b,
    D.LessThan: lambda a, b: a < b,
    D.LessThanOrEqual: lambda a, b: a <= b,
    D.StringStartsWith: lambda a, b: a.startswith(b),
    D.StringEndsWith: lambda a, b: a.endswith(b),
    D.StringContains: lambda a, b: b in a,
}


def _judged(f: D.Filter) -> bool:
    """Whether the headers alone decide a filter."""
    if isinstance(f, D.Not):
        return _judged(f.child)
    known = (D.IsNull, D.IsNotNull, D.EqualNullSafe, D.In, *_TESTS)
    return isinstance(f, known) and len(f.attribute) == 1 and f.attribute[0] in HEADERS


# The source


@dataclass
class Pieces(D.InputPartition):
    """Stretches of archives that one task reads: path, first byte, end."""

    pieces: list[tuple[str, int, int]]


@dataclass
class Written(D.WriterCommitMessage):
    """Archives of one task: path, bytes, and offsets of records to cut at."""

    archives: list[tuple[str, int, list[int]]]


def _place(path: str):
    return pa.fs.FileSystem.from_uri(path)


class WarcSource(D.DataSource):
    """``path``: a folder of archives or one archive. Options: ``split`` bytes for a task (128 MiB), and for writing ``roll``
    bytes of an archive (1 GiB), ``level`` of compression (1)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], schema, int(self.options.get("split", 128 << 20)))

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("archives are only added to: write with mode append")
        return WarcWriter(self.options["path"], int(self.options.get("roll", 1 << 30)), int(self.options.get("level", 1)))


class WarcReader(D.DataSourceReader):
    def __init__(self, path: str, schema, split: int):
        self.path, self.schema, self.split, self.filters = path, schema, split, []

    def pushFilters(self, filters):
        for f in filters:
            if _judged(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        fs, path = _place(self.path)
        found = fs.get_file_info([path])[0]
        if found.type == pa.fs.FileType.File:
            return [Pieces([(path, 0, found.size)])]
        files = [x for x in fs.get_file_info(pa.fs.FileSelector(path, recursive=True)) if x.type == pa.fs.FileType.File]
        lists = [x for x in files if x.base_name.startswith("_committed-")]
        if lists:
            archives = [(f"{path}/{n}", size, cuts) for x in lists for n, size, cuts in json.loads(fs.open_input_file(x.path).read())]
        else:
            archives = [(x.path, x.size, [0]) for x in files if x.base_name.endswith((".warc", ".warc.gz"))]
        out, held, room = [], [], self.split
        for name, size, cuts in sorted(archives):
            for lo, hi in zip(cuts, [*cuts[1:], size], strict=True):
                if held and hi - lo > room:
                    out, held, room = [*out, Pieces(held)], [], self.split
                if held and held[-1][0] == name:
                    held[-1] = (name, held[-1][1], hi)
                else:
                    held.append((name, lo, hi))
                room -= hi - lo
        return [*out, Pieces(held)]

    def read(self, partition: Pieces):
        fs, _ = _place(self.path)
        schema = to_arrow_schema(self.schema)
        keep = lambda row: all(_holds(f, row) for f in self.filters)
        rows, size = [], 0
        for path, lo, hi in partition.pieces:
            with fs.open_input_file(path) as file:
                for row in records(file, path.rsplit("/", 1)[-1], lo, hi, set(schema.names), keep):
                    rows.append(row)
                    size += len(row.get("payload") or b"") + 500
                    if size > 4 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    cell = lambda x: list(x.items()) if isinstance(x, dict) else x
    return pa.RecordBatch.from_arrays([pa.array([cell(r.get(f.name)) for r in rows], f.type) for f in schema], schema=schema)


class WarcWriter(D.DataSourceArrowWriter):
    """Writes rows of (record_type, record_id, date, target_uri, refers_to, refers_to_uri, payload_digest, http_type, http_length, payload) as HTTP
    responses and revisits; each archive begins with a warcinfo record."""

    #: Bytes between offsets to cut at.
    CUT = 32 << 20

    def __init__(self, path: str, roll: int, level: int):
        self.path, self.roll, self.level, self.now = path, roll, level, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator):
        fs, path = _place(self.path)
        fs.create_dir(path, recursive=True)
        out: list[tuple[str, int, list[int]]] = []
        file, size = None, 0
        for batch in iterator:
            columns = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names)]
            for i in range(batch.num_rows):
                if file is None or size >= self.roll:
                    if file:
                        file.close()
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    file, size = fs.open_output_stream(f"{path}/{name}", compression=None), 0
                    out.append((name, 0, [0]))
                    file.write(head := member(self.info(name), self.level))
                    size += len(head)
                data = member(self.record({n: c[i].as_py() for n, c in columns}), self.level)
                if size - out[-1][2][-1] >= self.CUT:
                    out[-1][2].append(size)
                file.write(data)
                size += len(data)
                out[-1] = (out[-1][0], size, out[-1][2])
        if file:
            file.close()
        return Written(out)

    def commit(self, messages):
        fs, path = _place(self.path)
        fs.create_dir(path, recursive=True)
        listed = [a for m in messages if m for a in m.archives]
        with fs.open_output_stream(f"{path}/_committed-{uuid.uuid4().hex}") as file:
            file.write(json.dumps(listed).encode())

    def abort(self, messages):
        fs, path = _place(self.path)
        for name, _, _ in (a for m in messages if m for a in m.archives):
            fs.delete_file(f"{path}/{name}")

    def info(self, name: str) -> bytes:
        fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.now), ("WARC-Filename", name)]
        return record_bytes([*fields, ("Content-Type", "application/warc-fields")], b"software: ridelake\r\nformat: WARC File Format 1.1\r\n")

    def record(self, x: dict) -> bytes:
        angle = lambda v: None if v is None else f"<{v}>"
        clean = lambda v: None if v is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
        digest = x.get("payload_digest")
        if digest and digest.startswith("sha1:"):
            digest = "sha1:" + base64.b32encode(bytes.fromhex(digest[5:])).decode()
        revisit = x["record_type"] == "revisit"
        payload = b"" if revisit else x.get("payload") or b""
        length = x.get("http_length")
        block = f"HTTP/1.1 200 OK\r\nContent-Type: {x.get('http_type') or 'text/html'}\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
        headers = [
            ("WARC-Type", x["record_type"]),
            ("WARC-Record-ID", angle(x["record_id"])),
            ("WARC-Date", x.get("date") or self.now),
            ("WARC-Target-URI", clean(x.get("target_uri"))),
            ("WARC-Payload-Digest", digest),
            ("WARC-Profile", PROFILE if revisit else None),
            ("WARC-Refers-To", angle(x.get("refers_to"))),
            ("WARC-Refers-To-Target-URI", clean(x.get("refers_to_uri"))),
            ("Content-Type", "application/http;msgtype=response"),
        ]
        return record_bytes(headers, block + payload)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, columns: str = SCHEMA, split: int = 128 << 20) -> DataFrame:
    """The records below ``path`` with the columns named (a schema): without ``payload`` no payload is decoded."""
    register(spark)
    return spark.read.format("warc").schema(columns).option("split", str(split)).load(path)


# Pages


def archive(pages: DataFrame, path: str, least: int = REVISIT, few: int = BROADCAST, id_: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Add a record for each page to the archives below ``path``. A record's identifier is ``urn:x-page:`` and the page's, the payload's
    and the url's digests, so that equal pages share it."""
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_).alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    copies = rows.where(F.col("size") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.col("id"), F.col("url"))).alias("first"))
    copies = stored(copies.where(F.col("n") > 1).select("digest", "first"))
    marked = rows.join(F.broadcast(copies) if copies.count() <= few else copies.hint("shuffle_hash"), "digest", "left")
    name = lambda i, u: F.concat(F.lit("urn:x-page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(":"), "digest", F.lit(":"), F.md5(F.coalesce(u, F.lit(""))))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    marked.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        name(F.col("id"), F.col("url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(again, name(F.col("first.id"), F.col("first.url"))).alias("refers_to"),
        F.when(again, F.col("first.url")).alias("refers_to_uri"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.lit("text/html; charset=utf-8").alias("http_type"),
        F.col("size").alias("http_length"),
        F.when(~again, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """The pages in archives that ``archive`` wrote: responses with what their payloads hold, revisits by their headers alone."""
    full = read(spark, path, "record_type string, record_id string, payload binary").where("record_type = 'response'")
    full = full.select("record_type", "record_id", F.lit(None).cast("string").alias("refers_to"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    again = read(spark, path, "record_type string, record_id string, refers_to string, http_length long, payload_digest string").where("record_type = 'revisit'")
    again = again.select("record_type", "record_id", "refers_to", F.col("http_length").alias("payload_bytes"), F.substring("payload_digest", 6, 40).alias("payload_digest"))
    page = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) as bigint)")
    return full.unionByName(again).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def sql() -> str:
    """The query's rows in DuckDB's SQL, without archives."""
    return """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m"""
