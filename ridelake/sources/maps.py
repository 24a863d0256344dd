"""Map files in the protocol-buffer layout (``.osm.pbf``) as a data source: nodes and ways, read and written by Spark tasks.

A file is a row of blobs, each with a length in front, so a reader goes from header to header without reading what lies between.
Neighbouring blobs make up a partition of about ``split`` bytes; a task holds one blob at a time, which the format keeps below 32 MB.
Paths are those that Arrow's file systems know (file, hdfs, s3, gs, abfss). A folder holds any number of files; names that begin
with ``_`` or ``.`` don't count.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

#: Columns by kind of element.
KINDS = {"nodes": "osm_id long, lat double, lon double", "ways": "way_id long, nodes array<long>, tags map<string,string>"}
#: Fixed values of the format: the most bytes of a blob's header and of a blob, and the features a reader here can follow.
MOST_HEADER, MOST_BLOB = 64 << 10, 32 << 20
FEATURES = {"OsmSchema-V0.6", "DenseNodes"}
#: Elements of a block that is written, and nanodegrees of one step of its coordinates.
BLOCK, STEP = 8000, 100


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a message's fields: an integer, or the bytes of what has a length."""
    at, end = 0, len(data)
    while at < end:
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 2, 5):
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            if at + size > end:
                raise ValueError("a map file's message ends within a field")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"a map file's message has a field of unknown kind {kind}")
        yield key >> 3, value


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("a map file's message ends within a number")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def numbers(packed: bytes) -> np.ndarray:
    """Unsigned numbers of a packed field."""
    raw = np.frombuffer(packed, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    if not len(ends):
        return np.zeros(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(ends[-1] + 1) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw[: ends[-1] + 1] & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def signed(values: np.ndarray) -> np.ndarray:
    """Numbers whose lowest bit is the sign."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def summed(packed: bytes) -> np.ndarray:
    """Numbers stored as differences from the one before."""
    return np.cumsum(signed(numbers(packed)))


def _negative(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def unpacked(blob: bytes) -> bytes:
    """What a blob holds."""
    for number, value in fields(blob):
        if number == 1:
            return value
        if number == 3:
            return zlib.decompress(value)
        if number != 2:
            raise ValueError("a map file's blob is packed in a way that is not known here; zlib and none are")
    return b""


def checked(header: bytes) -> None:
    """End with an error where a file needs a feature that is not known here."""
    if unknown := sorted({v.decode() for n, v in fields(header) if n == 4} - FEATURES):
        raise ValueError(f"the map file needs {', '.join(unknown)}")


def elements(block: bytes, kind: str) -> Iterator[pa.RecordBatch]:
    """Nodes or ways of a block, a batch for each group; groups of another kind are passed over."""
    strings, groups, step, lat0, lon0 = [], [], STEP, 0, 0
    for number, value in fields(block):
        if number == 1:
            strings = [v.decode("utf-8", "replace") for n, v in fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            step = value
        elif number in (19, 20):
            lat0, lon0 = (_negative(value), lon0) if number == 19 else (lat0, _negative(value))
    for group in groups:
        own = list(fields(group))
        if kind == "ways":
            if found := [_way(v, strings) for n, v in own if n == 3]:
                yield _ways(found)
            continue
        for number, value in own:
            if number == 2:
                dense = {n: v for n, v in fields(value) if n in (1, 8, 9)}
                ids, lat, lon = (summed(dense.get(n, b"")) for n in (1, 8, 9))
                yield _nodes(ids, lat0 + step * lat, lon0 + step * lon)
        if plain := [dict(fields(v)) for n, v in own if n == 1]:
            ids, lat, lon = (signed(np.array([p.get(n, 0) for p in plain], np.uint64)) for n in (1, 8, 9))
            yield _nodes(ids, lat0 + step * lat, lon0 + step * lon)


def _nodes(ids: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"osm_id": pa.array(ids), "lat": pa.array(lat / 1e9), "lon": pa.array(lon / 1e9)})


def _way(data: bytes, strings: list[str]) -> tuple[int, np.ndarray, dict]:
    own = {n: v for n, v in fields(data)}
    names, values = (numbers(own.get(n, b"")) for n in (2, 3))
    return _negative(own.get(1, 0)), summed(own.get(8, b"")), {strings[int(a)]: strings[int(b)] for a, b in zip(names, values, strict=True)}


def _ways(found: list[tuple[int, np.ndarray, dict]]) -> pa.RecordBatch:
    types = [pa.int64(), pa.list_(pa.int64()), pa.map_(pa.string(), pa.string())]
    columns = [[w[0] for w in found], [w[1] for w in found], [list(w[2].items()) for w in found]]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["way_id", "nodes", "tags"])


def _key(number: int, kind: int) -> bytes:
    return packed([number << 3 | kind])


def packed(values) -> bytes:
    """Unsigned numbers in the format's own lengths."""
    out = bytearray()
    for v in values:
        v = int(v) & (1 << 64) - 1
        while v >= 0x80:
            out.append(v & 0x7F | 0x80)
            v >>= 7
        out.append(v)
    return bytes(out)


def differences(values) -> bytes:
    """Numbers packed as differences from the one before, sign last."""
    steps = np.diff(np.asarray(values, np.int64), prepend=0)
    return packed(((steps << 1) ^ (steps >> 63)).view(np.uint64))


def message(*parts: tuple[int, int | bytes]) -> bytes:
    """A message of fields (number, value)."""
    return b"".join(_key(n, 2) + packed([len(v)]) + v if isinstance(v, bytes) else _key(n, 0) + packed([v]) for n, v in parts)


def framed(name: bytes, content: bytes) -> bytes:
    """A blob with its header and the header's length in front."""
    blob = message((2, len(content)), (3, zlib.compress(content)))
    header = message((1, name), (3, len(blob)))
    return len(header).to_bytes(4, "big") + header + blob


def blocks(rows: pa.Table, kind: str) -> Iterator[bytes]:
    """Blocks of rows, in halves where one would be longer than the format allows."""
    made = block(rows, kind)
    if len(made) < MOST_BLOB:
        yield made
    elif rows.num_rows == 1:
        raise ValueError("an element of the map file would be longer than its format allows")
    else:
        for half in (rows.slice(0, rows.num_rows // 2), rows.slice(rows.num_rows // 2)):
            yield from blocks(half, kind)


def block(rows: pa.Table, kind: str) -> bytes:
    """A block of rows of one kind. Coordinates are rounded to whole steps."""
    if kind == "nodes":
        at = lambda c: np.rint(rows[c].to_numpy() * (1e9 / STEP)).astype(np.int64)
        dense = message((1, differences(rows["osm_id"].to_numpy())), (8, differences(at("lat"))), (9, differences(at("lon"))))
        return message((1, message((1, b""))), (2, message((2, dense))))
    places, ways = {"": 0}, []
    for way, nodes, tags in zip(rows["way_id"].to_pylist(), rows["nodes"].to_pylist(), rows["tags"].to_pylist(), strict=True):
        own = [(places.setdefault(k, len(places)), places.setdefault(v, len(places))) for k, v in tags or []]
        ways.append((3, message((1, way), (2, packed(k for k, _ in own)), (3, packed(v for _, v in own)), (8, differences(nodes or [])))))
    return message((1, message(*((1, s.encode()) for s in places))), (2, message(*ways)))


@dataclass
class Blobs(D.InputPartition):
    file: str
    start: int
    end: int


@dataclass
class Written(D.WriterCommitMessage):
    files: list[str]


class MapSource(D.DataSource):
    """Options: ``kind`` (nodes or ways), ``split`` (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "mapfile"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "nodes")]

    def reader(self, schema) -> MapReader:
        return MapReader(self.options)

    def writer(self, schema, overwrite: bool) -> MapWriter:
        return MapWriter(self.options)


def _header(file, at: int) -> tuple[str, int, int]:
    """Name, begin and end of the blob whose frame begins ``at``."""
    file.seek(at)
    head = file.read(4 + 256)
    size = int.from_bytes(head[:4], "big")
    if len(head) < 4 or size > MOST_HEADER:
        raise ValueError(f"no blob of a map file at byte {at}")
    data = head[4 : 4 + size]
    if size > len(data):
        data += file.read(size - len(data))
    own = dict(fields(data)) if len(data) == size else {}
    if 3 not in own or own[3] > MOST_BLOB:
        raise ValueError(f"no blob of a map file at byte {at}")
    return own.get(1, b"").decode(), at + 4 + size, at + 4 + size + own[3]


class MapReader(D.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.split = options["path"], options.get("kind", "nodes"), int(options.get("split", 64 << 20))

    def partitions(self) -> list[Blobs]:
        """Pieces of files that begin and end at a blob. Only headers are read: a row of some hundred bytes for each blob."""
        fs, path = pa.fs.FileSystem.from_uri(self.path)
        found = fs.get_file_info([path])[0]
        files = [found] if found.type == pa.fs.FileType.File else fs.get_file_info(pa.fs.FileSelector(path, recursive=True))
        out: list[Blobs] = []
        for info in sorted(files, key=lambda x: x.path):
            if info.type != pa.fs.FileType.File or info.base_name[:1] in "_.":
                continue
            with fs.open_input_file(info.path) as file:
                start = at = 0
                while at < info.size:
                    _, _, at = _header(file, at)
                    if at > info.size:
                        raise ValueError(f"{info.path} ends within a blob")
                    if at - start >= self.split or at == info.size:
                        out.append(Blobs(info.path, start, at))
                        start = at
        return out or [Blobs("", 0, 0)]

    def read(self, part: Blobs) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        fs, _ = pa.fs.FileSystem.from_uri(self.path)
        with fs.open_input_file(part.file) as file:
            at = part.start
            while at < part.end:
                name, begin, at = _header(file, at)
                if name not in ("OSMData", "OSMHeader"):
                    continue
                file.seek(begin)
                content = unpacked(file.read(at - begin))
                if name == "OSMHeader":
                    checked(content)
                else:
                    yield from elements(content, self.kind)


class MapWriter(D.DataSourceArrowWriter):
    """A file for each task. It gets its name when the job has ended well, so files of a task that was tried again don't count."""

    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "nodes")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, path = pa.fs.FileSystem.from_uri(self.path)
        fs.create_dir(path, recursive=True)
        name, file = f"{self.kind}-{uuid.uuid4().hex}.osm.pbf", None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                if file is None:
                    file = fs.open_output_stream(f"{path}/_{name}", compression=None)
                    file.write(framed(b"OSMHeader", message(*((4, f.encode()) for f in sorted(FEATURES)))))
                for made in blocks(pa.Table.from_batches([batch.slice(at, BLOCK)]), self.kind):
                    file.write(framed(b"OSMData", made))
        if file is None:
            return Written([])
        file.close()
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = pa.fs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.files):
            fs.move(f"{path}/_{name}", f"{path}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = pa.fs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.files):
            fs.delete_file(f"{path}/_{name}")


def _scan(spark: SparkSession, path: str, kind: str, split: int) -> DataFrame:
    spark.dataSource.register(MapSource)
    return spark.read.format("mapfile").option("kind", kind).option("split", split).load(path)


def nodes(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """(osm_id, lat, lon) of all nodes of a file or a folder of files."""
    return _scan(spark, path, "nodes", split)


def ways(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """(way_id, nodes, tags) of all ways."""
    return _scan(spark, path, "ways", split)


def write(elements: DataFrame, path: str, kind: str) -> None:
    """Add nodes or ways to a folder of map files. Rows without an identifier or, for nodes, a place are an error; a tag without a value is left out."""
    elements.sparkSession.dataSource.register(MapSource)
    names = [c.split()[0] for c in KINDS[kind].split(", ")]
    must = names if kind == "nodes" else names[:1]
    whole = F.when(F.greatest(*[F.col(c).isNull() for c in must]) if len(must) > 1 else F.col(must[0]).isNull(), F.raise_error(F.lit(f"{kind} need {', '.join(must)}")).cast("boolean"))
    rows = elements.where(whole.isNull())
    if kind == "ways":
        rows = rows.withColumn("tags", F.map_filter("tags", lambda k, v: v.isNotNull()))
    rows.select(*names).write.format("mapfile").option("kind", kind).mode("append").save(path)
