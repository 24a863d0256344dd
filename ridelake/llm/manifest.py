"""A Merkle manifest of a table: one hash for all rows, one for each group, and a proof for each row.

Rows of a group, in order, are the leaves of a tree whose nodes hash up to ``FAN`` consecutive nodes; the groups' roots, in
order of the groups, are the leaves of one more tree, which ends in the root of the table.

1. The leaves are hashed once and stored without the texts.
2. They are sorted by ranges of (group, key, leaf). A range holds the end of one group, whole groups, and the start of another, so
   its rows are numbered by its own count and one offset, that of its first group: a count for each range is all that the driver sees.
3. Each range builds what it holds whole: complete aligned runs of nodes, level by level. Runs cut by a
   range's bounds, at most two a level, leave their nodes behind as boundary nodes.
4. Boundary nodes meet by their coordinate (group, level, run), one level after the other; each complete run
   gives the node above. That ends in the roots of the groups that span ranges. The roots go through the same steps as one group.
5. For the proofs the leaves of each range come again, sorted, behind a row with the cut runs that touch it and the path of its group in
   the upper tree. The range builds its levels once more and writes each leaf's siblings from there.

A tree of any number of groups or rows is never in one task: a task holds the digests of one range of about ``ROWS`` rows.

Defined results: nulls hash as ``-`` and differ from empty strings; a null group is a group of its own, the first; null keys come first;
equal keys are ordered by their leaves, so rows that are equal throughout are leaves of their own with equal digests, and may change places.
Texts of any length are hashed whole. An empty table has no rows and no root. The columns to keep come back in the struct ``row``, so no name can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridelake.llm.common import stored

FAN = 16
#: Rows of a range, about.
ROWS = 1 << 16

_MADE = "kind string, part int, g string, level int, index long, n long, rows long, hash string"


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as its number of UTF-8 bytes and its value, or ``-`` where it is null."""
    of = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*(of(c.cast("string")) for c in fields)), 256)


def folded(digest: Column, left: Column, right: Column) -> Column:
    """The root to which a leaf's digest leads along a proof."""
    step = lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256)
    return F.aggregate(F.arrays_zip(left.alias("left"), right.alias("right")), digest, step)


def proofs(rows: DataFrame, digest: Column, group: Column, key: Column, keep: list[Column]) -> DataFrame:
    """``row`` (the columns to keep), ``leaf``, ``subroot``, ``root``, and per level, the group's first, the siblings before and behind as
    concatenated digests (``left``, ``right``)."""
    g = F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))  # a null group is the first
    leaves = rows.select(F.struct(*keep).alias("row"), g.alias("g"), key.alias("key"), digest.alias("hash"))
    lower = _forest(leaves)
    upper = _forest(lower["roots"].select(F.struct("g").alias("row"), F.lit("").alias("g"), F.col("g").alias("key"), "hash"))
    above = _paths(upper, None).select(F.col("row.g").alias("g"), F.col("top").alias("root"), "left", "right")
    return _paths(lower, stored(above)).select("row", "leaf", F.col("top").alias("subroot"), "root", "left", "right")


def _forest(leaves: DataFrame) -> dict[str, DataFrame]:
    """From (row, g, key, hash): numbered leaves, the segments of groups in ranges, the runs that ranges cut, and the roots."""
    spark = leaves.sparkSession
    leaves = stored(leaves.withColumn("place", F.monotonically_increasing_id()))  # equal rows can be dealt to several ranges by their place
    n = leaves.count()
    ranges = max(1, ceil(n / ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(n / 1000)))
    order = ["g", "key", "hash", "place"]
    ranged = leaves.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("g", "hash", "row").rdd
    starts, largest = _starts(ranged.mapPartitionsWithIndex(_ends).collect())
    shared = spark.sparkContext.broadcast(starts)  # three numbers for each range
    schema = T.StructType([*T.DataType.fromDDL(_MADE), T.StructField("row", leaves.schema["row"].dataType)])
    numbered = ranged.mapPartitionsWithIndex(lambda part, rows: _built(part, rows, shared.value))
    made = stored(spark.createDataFrame(numbered, schema, verifySchema=False))
    kind = lambda k: made.where(F.col("kind") == k)
    nodes, roots, runs = kind("node").select("g", "level", "index", "n", "hash"), kind("root").select("g", "hash"), None
    rising = None
    for level in range(_levels(largest)):
        here = nodes.where(F.col("level") == level)
        here = here if rising is None else here.unionByName(rising)
        children = F.transform(F.sort_array(F.collect_list(F.struct("index", "hash"))), lambda x: x.hash)
        run = stored(here.groupBy("g", F.expr(f"index div {FAN}").alias("index")).agg(F.max("n").alias("n"), children.alias("children")).withColumn("level", F.lit(level)))
        runs = run if runs is None else runs.unionByName(run)
        over = run.select("g", F.lit(level + 1).alias("level"), "index", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.sha2(F.array_join("children", ""), 256).alias("hash"))
        roots = roots.unionByName(over.where(F.col("n") == 1).select("g", "hash"))
        rising = over.where(F.col("n") > 1)
    return {"leaves": kind("leaf"), "segments": kind("segment"), "runs": runs, "roots": roots, "ranges": ranges}


def _levels(n: int) -> int:
    """Steps from ``n`` leaves to one node."""
    steps = 0
    while n > 1:
        n, steps = -(-n // FAN), steps + 1
    return steps


def _ends(part: int, rows) -> Iterator[tuple]:
    """A range's first group and its rows, its last group and its rows."""
    first = last = None
    n = in_first = 0
    for row in rows:
        if row[0] != last:
            if first is None:
                first = row[0]
            elif last == first:
                in_first = n
            last, n = row[0], 0
        n += 1
    if last is not None:
        yield part, first, n if first == last else in_first, last, n


def _starts(ends: list[tuple]) -> tuple[dict[int, tuple[int, int, int]], int]:
    """For each range: the number of its first row in that row's group, and the sizes of its first and last group; and
    the size of the largest group that spans ranges."""
    offsets, sizes, at = {}, {}, (None, 0)
    chain = 0  # groups by the order in which they are met at the ends of ranges
    names = {}
    for part, first, in_first, last, in_last in sorted(ends):
        if at[0] != first:
            chain, at = chain + 1, (first, 0)
        offsets[part], names[part] = at[1], [chain, chain]
        at = (first, at[1] + in_first)
        sizes[chain] = at[1]
        if last != first:
            chain, at = chain + 1, (last, in_last)
            names[part][1], sizes[chain] = chain, in_last
    parts: dict[int, int] = {}
    for a, b in names.values():
        for x in {a, b}:
            parts[x] = parts.get(x, 0) + 1
    spanning = max((sizes[x] for x, k in parts.items() if k > 1), default=0)
    return {part: (offsets[part], sizes[a], sizes[b]) for part, (a, b) in names.items()}, spanning


def _hash(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def _built(part: int, rows, starts: dict[int, tuple[int, int, int]]) -> Iterator[tuple]:
    """A range's leaves with their numbers, and of each group what ``_whole`` finds; one group's digests at a time."""
    lo, in_first, in_last = starts.get(part, (0, 0, 0))
    group, hashes, first, held = None, [], True, []
    for row in rows:
        if row[0] != group:
            if group is not None:
                yield from _closed(part, group, lo, in_first if first else len(hashes), hashes, held)
                first, lo = False, 0
            group, hashes, held = row[0], [], []
        hashes.append(row[1])
        held.append(row[2])
    if group is not None:
        yield from _closed(part, group, lo, in_first if first else in_last, hashes, held)


def _closed(part, group, lo, n, hashes, held) -> Iterator[tuple]:
    yield "segment", part, group, 0, lo, n, len(hashes), None, None
    for i, (h, row) in enumerate(zip(hashes, held, strict=True)):
        yield "leaf", part, group, 0, lo + i, n, 1, h, row
    yield from ((kind, part, group, level, index, m, None, h, None) for kind, level, index, m, h in _whole(lo, hashes, n))


def _whole(lo: int, hashes: list[str], n: int) -> Iterator[tuple]:
    """Of nodes ``lo``, ... of a level of ``n``: those of runs that are cut, and the root if it is reached."""
    level = 0
    while n > 1 and hashes:
        hi = lo + len(hashes)
        begin, end = lo + -lo % FAN, n if hi == n else hi - hi % FAN
        if end <= begin:
            begin = end = hi
        for i in (*range(lo, begin), *range(end, hi)):
            yield "node", level, i, n, hashes[i - lo]
        hashes = [_hash(hashes[i - lo : i - lo + FAN]) for i in range(begin, end, FAN)]
        lo, n, level = begin // FAN, -(-n // FAN), level + 1
    if hashes:
        yield "root", level, 0, 1, hashes[0]


def _paths(made: dict[str, DataFrame], above: DataFrame | None) -> DataFrame:
    """(row, leaf, top, root, left, right) of every leaf; ``above``: root, left and right of each group in the tree over the groups."""
    parts = made["segments"].select("part", "g", F.col("index").alias("lo"), "n", "rows")
    if made["runs"] is None:
        frames = parts.withColumn("runs", F.expr("cast(array() as array<struct<level:int,index:long,children:array<string>>>)"))
    else:
        levels = F.sequence(F.lit(0), F.lit(_levels(1 << 62)))
        cut = parts.where(F.col("rows") < F.col("n")).select("part", "g", "lo", "rows", F.explode(levels).alias("level"))
        run = lambda x: F.floor(x / F.pow(F.lit(float(FAN)), F.col("level") + 1)).cast("long")
        cut = cut.select("part", "g", "level", F.explode(F.array_distinct(F.array(run(F.col("lo")), run(F.col("lo") + F.col("rows") - 1)))).alias("index"))
        found = cut.join(made["runs"].select("g", "level", "index", "children"), ["g", "level", "index"])
        found = found.groupBy("part", "g").agg(F.collect_list(F.struct("level", "index", "children")).alias("runs"))
        frames = parts.join(found, ["part", "g"], "left")
    if above is None:
        none = F.expr("cast(array() as array<string>)")
        frames = frames.withColumns({"root": F.lit(None).cast("string"), "left": none, "right": none})
    else:
        frames = frames.join(above, "g", "left")
    frame = F.struct("lo", "n", "runs", "root", "left", "right")
    both = made["leaves"].select("part", "g", F.lit(1).alias("kind"), "index", "hash", "row").unionByName(
        frames.select("part", "g", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("index"), frame.alias("frame")), allowMissingColumns=True
    )
    both = both.repartitionByRange(made["ranges"], "part", "g").sortWithinPartitions("part", "g", "kind", "index")
    schema = T.StructType([T.StructField("row", both.schema["row"].dataType), *T.DataType.fromDDL("leaf string, top string, root string, left array<string>, right array<string>")])
    return both.select("kind", "hash", "row", "frame").mapInArrow(_written, schema)


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    frame, hashes, held = None, [], []
    for batch in batches:
        kinds, digests, frames = (batch.column(i) for i in (0, 1, 3))
        begins = [i for i, k in enumerate(kinds.to_pylist()) if k == 0]
        at = 0
        for i in [*begins, len(kinds)]:
            if i > at:
                hashes += digests.slice(at, i - at).to_pylist()
                held.append(batch.column(2).slice(at, i - at))
            if i < len(kinds):
                yield from _proved(frame, hashes, held)
                frame, hashes, held = frames[i].as_py(), [], []
            at = i + 1
    yield from _proved(frame, hashes, held)


def _proved(frame: dict | None, hashes: list[str], held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """The proofs of one segment, a few hundred rows at a time."""
    if not hashes:
        return
    cut = {(x["level"], x["index"]): x["children"] for x in frame["runs"] or []}
    lo, n, level, steps = frame["lo"], frame["n"], 0, []
    nodes = hashes
    while n > 1:  # upwards: the children of each run that the segment touches
        hi = lo + len(nodes)
        first, last = lo // FAN, (hi - 1) // FAN
        runs = [cut.get((level, r)) or nodes[r * FAN - lo : min(n, (r + 1) * FAN) - lo] for r in range(first, last + 1)]
        steps.append((lo, hi, first, runs))
        nodes, lo, n, level = [_hash(r) for r in runs], first, -(-n // FAN), level + 1
    top = nodes[0]
    left, right = [tuple(frame["left"])], [tuple(frame["right"])]
    base = 0
    for lo, hi, first, runs in reversed(steps[1:]):  # downwards: what stands above a node goes behind its own siblings
        left, right = (
            [("".join(runs[i // FAN - first][: i % FAN]), *left[i // FAN - base]) for i in range(lo, hi)],
            [("".join(runs[i // FAN - first][i % FAN + 1 :]), *right[i // FAN - base]) for i in range(lo, hi)],
        )
        base = lo
    rows = pa.concat_arrays(held)
    for at in range(0, len(hashes), 500):
        some = hashes[at : at + 500]
        if steps:
            lo, _, first, runs = steps[0]
            places = range(lo + at, lo + at + len(some))
            before = [["".join(runs[i // FAN - first][: i % FAN]), *left[i // FAN - base]] for i in places]
            behind = [["".join(runs[i // FAN - first][i % FAN + 1 :]), *right[i // FAN - base]] for i in places]
        else:
            before, behind = [list(left[0])] * len(some), [list(right[0])] * len(some)
        yield pa.RecordBatch.from_arrays(
            [
                rows.slice(at, len(some)),
                pa.array(some, pa.string()),
                pa.array([top] * len(some), pa.string()),
                pa.array([frame["root"]] * len(some), pa.string()),
                pa.array(before, pa.list_(pa.string())),
                pa.array(behind, pa.list_(pa.string())),
            ],
            ["row", "leaf", "top", "root", "left", "right"],
        )


def sql() -> str:
    """The query's rows in DuckDB's SQL: levels by recursion, the checksum bit by bit."""
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "text"]
    of = lambda c: f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')"
    leaf_ = " || ".join(map(of, fields))
    lowered = " || ".join(map(of, [*fields[:-1], "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"]))
    tree = lambda name, first: f"""{name}(level, g, i, n, h) AS ({first}
  UNION ALL SELECT level + 1, g, i // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY level, g, i // 16, n)"""  # noqa: E731
    steps = lambda name, rows, key: f"""SELECT {key}, list(coalesce(l, '') || '|' || coalesce(r, '') ORDER BY level) AS path FROM (
    SELECT a.{key}, t.level, string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < a.i // (16 ** t.level)::BIGINT) AS l,
           string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > a.i // (16 ** t.level)::BIGINT) AS r
    FROM {rows} a JOIN {name} t ON t.g = a.g AND t.n > 1 AND t.i // 16 = a.i // (16 ** (t.level + 1))::BIGINT GROUP BY ALL) GROUP BY ALL"""  # noqa: E731
    return f"""
WITH RECURSIVE hashed AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('+' || source, '') AS g, sha256({leaf_}) AS h, sha256({lowered}) AS low,
         list_reduce(list_concat([4294967295::BIGINT], flatten([list_concat([ord(c)::BIGINT], [-1::BIGINT FOR _ IN range(8)]) FOR c IN string_split(doc_id::VARCHAR, '')])),
                     lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END) AS crc
  FROM documents),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM hashed),
{tree("lower_", "SELECT 0, g, i, n, h FROM rows_")},
subroots AS (SELECT g AS name, '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h FROM lower_ WHERE n = 1),
{tree("upper_", "SELECT 0, g, i, n, h FROM subroots")},
below AS ({steps("lower_", "rows_", "k")}),
above AS ({steps("upper_", "subroots", "name")}),
proved AS (
  SELECT doc_id, r.h AS leaf, s.h AS subroot, (SELECT h FROM upper_ WHERE n = 1) AS root,
         list_concat(coalesce(below.path, []), coalesce(above.path, [])) AS path,
         CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN low ELSE r.h END AS shown
  FROM rows_ r JOIN subroots s ON s.name = r.g LEFT JOIN below ON below.k = r.k LEFT JOIN above ON above.name = r.g),
ended AS (
  SELECT *, list_reduce(list_concat([shown], path), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root FROM proved)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM ended"""
