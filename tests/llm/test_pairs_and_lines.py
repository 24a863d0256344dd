"""Near duplicates, line dedup, decontamination and URL filter against plain counterparts."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelake.llm import decontaminate, jaccard, lines, urls

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def made_text(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(n))


def edited(r: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def shingles(text: str | None) -> frozenset:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_components(texts: dict) -> dict:
    sets = {i: shingles(t) for i, t in texts.items()}
    least = {i: i for i in texts}
    changed = True
    linked = [
        (a, b) for a in texts for b in texts if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return {i: (len(sets[i]), least[i]) for i in texts}


def test_near_duplicates_match_brute_force(spark):
    r = random.Random(3)
    texts: dict[int, str | None] = {}
    base = made_text(r, 120)
    for i in range(60):  # a group of near copies, some too far from the base
        texts[i] = edited(r, base, r.randrange(8))
    for i in range(60, 90):
        texts[i] = made_text(r, r.choice([1, 3, 4, 5, 6, 40, 90]))
    for i in range(90, 120):  # longer and shorter copies, chains
        texts[i] = edited(r, texts[i - 30] or "", 1) + (" tail" * r.randrange(3))
    texts |= {120: None, 121: "", 122: " \t\n", 123: "one two", 124: "ONE  two\n", 125: made_text(r, 30_000), 126: base, 127: base.upper()}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, fp string").repartition(7)
    for options in ({}, {"sample_docs": 0, "share": 0.9}, {"often": 1}):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(df, **options).collect()}
        assert got == brute_components(texts)


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(empty).count() == 0
    text = "a b c d e f g"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None)], "doc_id long, text string")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, 1), (2, 0, 2)], key=repr)
    assert sorted(x.doc_id for x in jaccard.one_of_each(df.where("doc_id is not null").dropDuplicates()).collect()) == [1, 2]


def cut_lines(text: str) -> list[str]:
    return [x for x in re.sub(PYTHON_END, lambda m: m[0] + "\x00", text).split("\x00") if x]


#: The operator's pattern in Python's writing.
PYTHON_END = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), lines.END)


def brute_lines(texts: dict, least: int = 40) -> dict:
    """The operator's rule, document by document."""
    cut = {i: cut_lines(t or "") for i, t in texts.items()}
    clean = {i: ["".join(c for c in x if c not in lines.BLANKS).lower() for x in ls] for i, ls in cut.items()}
    seen, gone = set(), defaultdict(set)
    for i in sorted(texts):
        covered = set()
        for p in range(len(clean[i]) - 2):
            window = tuple(clean[i][p : p + 3])
            if window in seen:
                covered |= {p, p + 1, p + 2}
            seen.add(window)
        run: list[int] = []
        for p in [*sorted(covered), 10**9]:
            if run and p != run[-1] + 1:
                if sum(len(clean[i][q]) for q in run) >= least:
                    gone[i] |= set(run)
                run = []
            run.append(p)
    return {i: (t if not gone[i] else "".join(x for k, x in enumerate(cut[i]) if k not in gone[i]), len(gone[i])) for i, t in texts.items()}


def test_lines_cover_the_text(spark):
    texts = ["", "one", "a b c d e f. g h\ni j k l m n o p. End\n\n last", " lead " + "w " * 100, "x\n" * 5, "many small angry words 1237 日本の本。です\u3000x", "solar\x01 a\x01|b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in df.select("text", lines.lines().alias("l")).collect():
        assert "".join(x.l).replace("\x01-", "\x01") == x.text
        assert x.l == cut_lines(x.text.replace("\x01", "\x01-"))


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(5)
    passage = "\n".join(made_text(r, 12) + "." for _ in range(6))
    texts: dict[int, str | None] = {}
    for i in range(30):
        own = [made_text(r, r.randrange(3, 30)) + "." for _ in range(r.randrange(1, 8))]
        if i % 3 == 0:
            own.insert(r.randrange(len(own) + 1), passage)
        texts[i] = "\n".join(own)
    texts |= {40: None, 41: "", 42: texts[0], 43: (made_text(r, 14) + ".\n") * 9, 44: "short\n" * 20, 45: " ".join(made_text(r, 9) for _ in range(3000))}
    df = spark.createDataFrame([(i, t, "k") for i, t in texts.items()], "doc_id long, text string, k1 string").repartition(5)
    got = {x.doc_id: (x.text, x.n_removed) for x in lines.remove_repeats(df.drop("k1")).collect()}
    assert got == brute_lines(texts)
    assert got[42][1] > 0 and got[0][1] == 0
    odd = df.withColumnsRenamed({"k1": "gone"}).withColumn("others", F.lit(1)).withColumn("n_removed", F.lit("x"))
    assert lines.remove_repeats(odd).columns == ["doc_id", "text", "gone", "others", "n_removed"]
    assert {x.gone for x in lines.remove_repeats(odd).collect()} == {"k"}
    assert lines.remove_repeats(df.limit(0).select("doc_id", "text")).count() == 0


def test_passages_are_found_wherever_they_stand(spark):
    """Pasted into a paragraph, with other line breaks' bytes, at a text's end; with and without punctuation."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(4, 9)))
    plain = " ".join(word() for _ in range(60))
    wrapped = "\n".join(" ".join(word() for _ in range(10)) for _ in range(6))
    texts = [plain, f"aa bb cc. {plain} dd ee", f"so it was {plain}", wrapped, f"xx yy\n{wrapped}\n\nzz".replace("\n", "\r\n"), f"un deux {wrapped}\t "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in lines.remove_repeats(df).collect()}
    for i, first in ((0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 3)):
        left = sum(w in got[i].text.split() for w in texts[first].split())
        assert left == 60 if i == first else left <= 24, (i, left)
    assert got[0].text == plain and got[3].text == wrapped and got[1].text.startswith("aa bb cc.") and got[1].text.endswith(" dd ee")


def test_long_lists_of_short_lines_are_found(spark):
    r = random.Random(12)
    menu = "\n".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(50))
    verse = "\n".join("".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(5)) for _ in range(20))
    texts = [menu, f"one\n{menu}\ntwo", verse, f"three\n{verse}\nfour", "aa\nbb\ncc", "five\naa\nbb\ncc\nsix", None, "", "\x01-\x01| " + menu]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.text, x.n_removed > 0) for x in lines.remove_repeats(df).collect()}
    for i in (0, 2, 4, 5, 6, 7):
        assert got[i] == (texts[i], False), i
    assert got[1][1] and len(got[1][0]) < 7 + 12 * 6  # at the seams at most the words before the first cut stay
    assert got[3][1] and len(got[3][0]) < 10 + 12 * 2
    assert got[8][0].startswith("\x01-\x01| ") and len(got[8][0]) < 7 + 12 * 6


def edit_distance_inside(pattern: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_myers_distance_matches_the_table():
    r = random.Random(1)
    for _ in range(200):
        pattern = "".join(r.choice("abc ") for _ in range(r.randrange(1, 90)))
        text = "".join(r.choice("abc ") for _ in range(r.randrange(0, 120)))
        want = min(edit_distance_inside(pattern, text), len(pattern))
        assert decontaminate.nearest(decontaminate.masks(pattern), len(pattern), text) == want


def test_decontamination_matches_brute_force(spark):
    r = random.Random(7)
    items = [(i, made_text(r, 12)) for i in range(8)] + [(8, None), (9, " ... "), (10, "tiny")]
    docs: list[tuple] = []
    for i in range(40):
        text = made_text(r, 60)
        if i % 2:
            hidden = list(items[i % 8][1])
            for _ in range(i % 5):
                hidden[r.randrange(len(hidden))] = r.choice("xyz")
            text = text + " " + "".join(hidden) + ", " + made_text(r, 20)
        docs.append((i, text))
    docs += [(40, None), (41, ""), (42, "Tiny!"), (42, "Tiny!")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, text in docs:
        for name, item in items:
            p, t = decontaminate.normalise(item or ""), decontaminate.normalise(text or "")
            if p and t and (d := edit_distance_inside(p, t)) <= (len(p) - 2) // 24:
                want.append((i, name, d))
    for block in (4_000_000, 150):
        got = sorted(tuple(x) for x in decontaminate.find(df, bench, block_chars=block).collect())
        assert got == sorted(want)
        dirty = {i for i, *_ in want}
        assert sorted(x.doc_id for x in decontaminate.clean(df, bench, block_chars=block).collect()) == sorted(i for i, _ in docs if i not in dirty)
    assert decontaminate.clean(df, bench.limit(0)).count() == len(docs)


def test_items_with_replaced_words_are_found(spark, tmp_path):
    """One and two words of five letters replaced by words of other letters, through the query and the pipeline's stage."""
    import corpus_pipeline
    from ridelake.llm import queries

    r = random.Random(21)
    item = " ".join("".join(r.choice("abcdefghijk") for _ in range(5)) for _ in range(20))
    own, docs = item.split(), []
    for n in (0, 1, 2, 8):
        new = [("zzzzz" if 5 <= i < 5 + n else w) for i, w in enumerate(own)]
        docs.append((n, "Text before. " + " ".join(new) + " and behind."))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(tuple(x) for x in queries.op2_benchmark_decontamination(spark, str(tmp_path)).collect()) == [(0, 1, 0), (1, 1, 5), (2, 1, 10)]
    assert [x.doc_id for x in corpus_pipeline.without_benchmark(spark, df, str(tmp_path)).collect()] == [8]


def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.org/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org": ("example.org", "", None, "allow"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://b.example.org/en/22": ("b.example.org", "/en/22", "org/", "allow"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "ftp://x.com/de/?q": ("x.com", "/de/", "com/de/", "block"),
        "https://x.com/fr/2": ("x.com", "/fr/2", "com/fr/", "allow"),
        "https://x.com?a=/fr/": ("x.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(cases)], "page_id long, url string, path int")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urls.judge(pages, labels).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_url_templates(spark):
    """A bad section of a host is rejected, ids become wildcards, like sections are merged."""
    rows, labels, n = [], [], 0
    for section, bad in (("news", 0), ("blog", 0), ("spam", 1)):
        for i in range(40):
            rows.append((n, f"https://h.net/{section}/item-{i}"))
            labels.append((n, bool(bad)))
            n += 1
    rows += [(n, "https://h.net/spam/unlabelled"), (n + 1, "https://h.net/news/unlabelled"), (n + 1, "https://h.net/news/unlabelled"), (None, "https://h.net/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = spark.createDataFrame([*labels, (0, False), (None, True)], "page_id long, bad boolean")
    got = [(x.page_id, x.template, x.verdict) for x in urls.judge(pages, marks).collect()]
    assert len(got) == len(rows)
    by_id = {i: (t, v) for i, t, v in got}
    assert by_id[n] == ("/spam/*", "block") and by_id[n + 1] == ("/blog|news/*", "allow") and by_id[None][1] == "allow"


def test_url_small_and_deep_branches(spark):
    """One bad directory of thirty (a thirtieth of its host), and one below six segments."""
    urls_, bad = [], []
    for d in range(30):
        urls_ += [f"https://h.net/dir{d}/{i}" for i in range(20)]
        bad += [d == 7] * 20
    for d in ("ok", "spam"):
        urls_ += [f"https://deep.net/a/b/c/d/e/f/{d}/{i}" for i in range(20)]
        bad += [d == "spam"] * 20
    urls_.append("https://few.net/1/2/3")
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    got = {x.page_id: x for x in urls.judge(pages, spark.createDataFrame(list(enumerate(bad)), "page_id long, bad boolean"), rules=(("none.net/", "allow"),)).collect()}
    assert [got[i].verdict == "block" for i in range(len(bad))] == bad
    assert got[len(bad)].template == "/*/*/*"
    assert got[len(bad) - 1].template == "/a/b/c/d/e/f/spam/*"


@pytest.mark.parametrize("depth", [1, 4])
def test_url_sql_is_made_for_any_depth(depth):
    assert f"lev{depth} AS" in urls.sql(depth=depth)


def test_hashing_takes_bounded_memory(monkeypatch):
    """Peak of hashing many texts, some longer than a part; sets don't depend on the size of a part."""
    texts = [f"word{i} " * (i % 900) + f"Other words {i} of\tthe text" for i in range(1500)] + ["long text of words " * 40_000, "", None]
    tracemalloc.start()
    try:
        got = [h.copy() for h in jaccard.Shingler().shingles(texts)]
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert peak - kept < 40 << 20
    monkeypatch.setattr(jaccard, "PART", 1 << 22)
    want = list(jaccard.Shingler().shingles(texts))
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))
