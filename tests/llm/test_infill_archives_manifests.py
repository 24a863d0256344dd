"""Fill-in-the-middle, WARC archives and Merkle manifests against plain counterparts."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from ridelake.llm import infill, manifest, warc

TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\nb\nc\n", "é\n日本\n🙂x\ny", "\x01\n\x02a\x01\x02\n\x02b", "a<P>b\nc", "x <S>", "<M>\n", "<\nP>\n<\nS>",
    "no end " * 4000, "line\n" * 5000, "\r\n\r\n \t", "$0\\1\n$1 {}\n", " \x85\nq",
]


def draw(identifier, seed=7):
    digest = hashlib.sha256(f"{seed}:{'' if identifier is None else identifier}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def plainly(identifier, text, rate=100, spm=50, seed=7, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units, (h1, h2, h3, h4) = re.findall(unit, text), draw(identifier, seed)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, None, text
    head, middle = "".join(units[:a]), "".join(units[a:b])
    tail = text[len(head) + len(middle) :]
    if h4 % 100 < spm:
        return len(units), "spm", head, middle, tail, f"<S>{tail}<P>{head}<M>{middle}"
    return len(units), "psm", head, middle, tail, f"<P>{head}<S>{tail}<M>{middle}"


@pytest.mark.parametrize("more", [{}, {"rate": 40, "spm": 80, "seed": 3}])
def test_infill_cuts_as_said_and_comes_back(spark, more):
    rows = [(i, t, "form of the document") for i, t in enumerate(TEXTS * 6)] + [(None, "a\nb\nc", None), (5, "a\nb\nc", "x"), (5, "a\nb\nc", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    made = infill.transform(docs, **more).withColumn("again", infill.restored(F.col("output"), F.col("form")))
    got = made.collect()
    assert len(got) == len(rows) and sorted(map(repr, (tuple(x.doc) for x in got))) == sorted(map(repr, rows))
    for x in got:
        assert (x.n, x.form, x.prefix, x.middle, x.suffix, x.output) == plainly(x.doc.doc_id, x.doc.text, **more)
        assert x.again == (x.doc.text or "")
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    assert infill.transform(docs.limit(0)).count() == 0


def test_infill_by_words_leaves_the_end_to_the_suffix(spark):
    docs = spark.createDataFrame([(i, f"  {i} two\nthree  ") for i in range(40)], "doc_id long, text string")
    for x in infill.transform(docs, unit=infill.WORDS).collect():
        assert (x.n, x.form, x.prefix, x.middle, x.suffix, x.output) == plainly(x.doc.doc_id, x.doc.text, unit=r"\s*\S+")


def test_infill_refuses_sentinels_that_cannot_be_found_again(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for bad in (("", "b", "c"), ("aa", "b", "c"), ("ab", "bc", "d"), ("abc", "b", "d")):
        with pytest.raises(ValueError):
            infill.transform(docs, sentinels=bad)


def tree_of(leaves):
    """The levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def path_of(levels, i):
    for level in levels[:-1]:
        run = i // 16 * 16
        yield "".join(level[run:i]), "".join(level[i + 1 : run + 16])
        i //= 16


def manifested(rows):
    """{(source, doc_id, leaf): (subroot, root, left, right)}, sorted into lists as equal rows share a key."""
    groups = {}
    for doc_id, source, text in rows:
        leaf = sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, text)))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([x[2] for x in sorted(groups[s])]) for s in names}
    top = tree_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, doc_id) in enumerate(sorted(groups[s])):
            path = [*path_of(trees[s], i), *path_of(top, k)]
            out.append((doc_id, s, leaf, trees[s][-1][0], top[-1][0], [x for x, _ in path], [y for _, y in path]))
    return sorted(out, key=repr)


def found_by_spark(docs):
    made = manifest.proofs(docs, manifest.leaf(*(F.col(c) for c in ("doc_id", "source", "text"))), F.col("source"), F.col("doc_id"), [F.col("doc_id"), F.col("source"), F.col("root")])
    made = made.withColumn("again", manifest.folded(F.col("leaf"), F.col("left"), F.col("right")))
    got = made.collect()
    assert all(x.again == x.root and x.row.root == "own" for x in got)
    return sorted(((x.row.doc_id, x.row.source, x.leaf, x.subroot, x.root, list(x.left), list(x.right)) for x in got), key=repr)


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_manifest_equals_plain_trees(spark, monkeypatch, ranges):
    rows = [(i, "hot", f"text {i}") for i in range(1100)]
    rows += [(i, f"s{i % 23}", "é" * (i % 3)) for i in range(2000, 2300)] + [(i, None, "x") for i in range(17)] + [(i, "", None) for i in range(16)]
    rows += [(None, "hot", "a"), (None, "hot", None), (None, None, "y" * 300_000), (7, "one", ""), *[(5, "same", "same")] * 400, (5, "same", "other"), (1, "é", "z"), (1, "Z", "z")]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, source string, text string, root string").repartition(5)
    monkeypatch.setattr(manifest, "ROWS", -(-len(rows) // ranges))
    assert found_by_spark(docs) == manifested(rows)


def test_manifest_of_few_rows(spark):
    docs = lambda rows: spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, source string, text string, root string")
    assert found_by_spark(docs([])) == []
    for rows in ([(1, "a", "x")], [(1, "a", "x"), (2, None, None)], [(i, str(i), "t") for i in range(40)]):
        assert found_by_spark(docs(rows)) == manifested(rows)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 31, 33, 255, 256, 257, 4097])
def test_runs_cut_anywhere_meet_again(n):
    """Local parts and boundary nodes give each node of the tree once, however the leaves are cut."""
    leaves = [sha(str(i)) for i in range(n)]
    levels = tree_of(leaves)
    for cuts in ([0, n], [0, n // 2, n], [0, 1, n], sorted({0, *range(5, n, 37), n}), sorted({0, *range(0, n, 16), n})):
        nodes, roots = {}, []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            for kind, level, index, _, h in manifest._whole(lo, leaves[lo:hi], n) if hi > lo else ():
                assert levels[level][index] == h
                roots += [h] if kind == "root" else []
                nodes.setdefault(level, {})[index] = h
        for level in range(len(levels) - 1):
            for run in {i // 16 for i in nodes.get(level, ())}:
                children = [nodes[level][i] for i in range(run * 16, min(len(levels[level]), run * 16 + 16))]
                nodes.setdefault(level + 1, {})[run] = sha("".join(children))
        assert roots or nodes[len(levels) - 1][0] == levels[-1][0]


def test_tampering_shows(spark):
    """Every row whose text has capitals fails when it is lower-cased, and no other one."""
    rows = [(i, f"s{i % 3}", "Text" if i % 2 else "text") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    fields = [F.col("doc_id"), F.col("source")]
    made = manifest.proofs(docs, manifest.leaf(*fields, F.col("text")), F.col("source"), F.col("doc_id"), [F.col("doc_id"), manifest.leaf(*fields, F.lower("text")).alias("low")])
    for x in made.select("row.doc_id", (manifest.folded(F.col("row.low"), F.col("left"), F.col("right")) == F.col("root")).alias("ok")).collect():
        assert x.ok == (x.doc_id % 2 == 0)


def pages_frame(spark):
    big, other = "<p>" + "x" * 1200 + "é</p>", "y" * 1000
    rows = [(1, "http://a/1", big), (9, "http://a/9", big), (4, None, big), (9, "http://a/9", big), (None, "http://n", big), (2, "u r\r\nl", "short"), (3, "http://b", "short"), (5, "http://c", None)]
    rows += [(6, "http://d", ""), (10, "http://e", other), (11, "http://f", other), (12, "http://g", "z" * 999), (13, "http://h", "z" * 999), (20, "http://i", "WARC/1.1\r\n\r\n" * 40_000)]
    rows += [(100 + i, f"http://many/{i}", "hot " * 300) for i in range(300)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(4)


@pytest.mark.parametrize("few", [0, 1000])
def test_archives_hold_each_page_and_copies_as_revisits(spark, tmp_path, few):
    rows, pages = pages_frame(spark)
    warc.archive(pages, f"file://{tmp_path}/a", few=few)
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    largest = {}
    for i, p in payload:
        largest[p] = max(largest.get(p, -1), -1 if i is None else i)
    want = []
    for i, p in payload:
        again = len(p) >= 1000 and i != largest[p]
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", largest[p] if again else None))
    got = [tuple(x) for x in warc.page_records(spark, f"file://{tmp_path}/a").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    found = {x.record_id: x for x in warc.read(spark, f"file://{tmp_path}/a", split=1).collect() if x.record_type != "warcinfo"}
    assert len(found) == len(rows) - 1  # the equal pages 9 share an identifier
    for x in found.values():
        assert x.record_type == "response" or x.payload is None and found[x.refers_to].payload_digest == x.payload_digest
        assert x.http_status == 200 and x.headers["WARC-Type"] == x.record_type
    assert {x.target_uri for x in found.values()} >= {None, "u%20r%0D%0Al", "http://a/9"}


def test_archive_of_no_pages(spark, tmp_path):
    _, pages = pages_frame(spark)
    warc.archive(pages.limit(0), f"file://{tmp_path}/a")
    assert warc.page_records(spark, f"file://{tmp_path}/a").count() == 0


def test_predicates_are_pushed_and_agree(spark, tmp_path):
    rows, pages = pages_frame(spark)
    path = f"file://{tmp_path}/a"
    warc.archive(pages, path)
    records = warc.read(spark, path, "record_type string, record_id string, target_uri string, refers_to string, content_length long, http_length long")
    every = [x.asDict() for x in records.collect()]
    for where, test in [
        ("record_type = 'response' and target_uri like 'http://many/2%'", lambda x: x["record_type"] == "response" and (x["target_uri"] or "").startswith("http://many/2")),
        ("record_type in ('revisit', 'warcinfo')", lambda x: x["record_type"] in ("revisit", "warcinfo")),
        ("target_uri is null and content_length > 60", lambda x: x["target_uri"] is None and x["content_length"] > 60),
        ("not target_uri like '%a/%'", lambda x: x["target_uri"] is not None and "a/" not in x["target_uri"]),
        ("refers_to is not null and http_length = 1000", lambda x: x["refers_to"] is not None and x["http_length"] == 1000),
        ("target_uri not in ('http://b')", lambda x: x["target_uri"] not in (None, "http://b")),
    ]:
        found = records.where(where)
        assert sorted(map(repr, (x.asDict() for x in found.collect()))) == sorted(repr(x) for x in every if test(x)), where
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert (" Filter (" in plan) == ("http_length" in where), where


def plain_archives():
    """A plain archive and a gzip one of another writer, with requests, folded lines, a chunk of two records and no ``sl`` field."""
    import gzip

    record = lambda kind, block, *more: warc.record_bytes([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{kind}>"), *more], block)
    http = b"HTTP/1.0 404 Not Found\r\nContent-type: a/b\r\n\r\n"
    all_ = [
        record("warcinfo", b"software: x\r\n"),
        record("request", b"GET / HTTP/1.0\r\nHost: h\r\n\r\n", ("Content-Type", "application/http; msgtype=request")),
        record("response", http + b"\r\n\r\nWARC/1.1\r\n" * 3000, ("content-type", "application/http; msgtype=response"), ("WARC-Target-URI", "http://x\r\n /y")),
        record("resource", b"\x00\xff" * 50_000, ("Content-Type", "image/png"), ("WARC-Payload-Digest", "SHA1:" + "A" * 32)),
        record("metadata", b""),
    ]
    return b"".join(all_), gzip.compress(all_[0]) + gzip.compress(all_[1] + all_[2]) + warc.member(all_[3]) + gzip.compress(all_[4])


def test_archives_of_others(spark, tmp_path):
    plain, squeezed = plain_archives()
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(squeezed)
    (tmp_path / "notes.txt").write_text("no archive")
    got = warc.read(spark, f"file://{tmp_path}").collect()
    for name in ("a.warc", "b.warc.gz"):
        x = {r.record_type: r for r in got if r.archive == name}
        assert [r.record_type for r in sorted((r for r in got if r.archive == name), key=lambda r: r.offset)][0] == "warcinfo" and len(x) == 5
        assert x["response"].target_uri == "http://x /y" and x["response"].http_status == 404 and x["response"].payload == b"\r\n\r\nWARC/1.1\r\n" * 3000
        assert x["resource"].payload == b"\x00\xff" * 50_000 and x["resource"].payload_digest == "sha1:" + "00" * 20 and x["metadata"].payload == b""
        assert x["request"].http_status is None and x["request"].payload == b""
    (tmp_path / "c.warc").write_bytes(plain[:-60_000])
    with pytest.raises(Exception, match="cut off"):
        warc.read(spark, f"file://{tmp_path}/c.warc").collect()


def test_unwanted_payloads_are_not_inflated():
    import io

    import pyarrow as pa

    body = b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(60_000))
    writer = warc.WarcWriter("", 1, 1)
    data = b"".join(warc.member(writer.record({"record_type": "response", "record_id": f"urn:{i}", "payload": body})) for i in range(3))

    class Counted(io.BytesIO):
        reads = 0

        def read(self, n=-1):
            Counted.reads += n
            return super().read(n)

        def size(self):
            return len(data)

    rows = list(warc.records(Counted(data), "x", 0, len(data), {"record_id", "http_length"}))
    assert [r["record_id"] for r in rows] == ["urn:0", "urn:1", "urn:2"] and Counted.reads <= 4 << 20 < len(data)
    assert [r["payload"] for r in warc.records(pa.BufferReader(data), "x", 0, len(data), {"payload"})] == [body] * 3
