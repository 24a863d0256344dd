r"""Removal of repeated passages by overlapping windows of three lines. DataFrame functions only.

Where a line ends depends on the content alone, so a passage is found wherever it was pasted: behind a line break,
behind the end of a sentence, and behind words and characters chosen by their last letter (``CHOSEN``, about one
word in seven of English text, and some characters of scripts written without blanks). A stretch without any of these is one line. Lines are
compared without white space, lower-cased. Every three consecutive lines make a window, known by a hash of 96 bits.
Of the windows that occur more than once, anywhere, all but the first occurrence (least doc_id, then position) are
marked; the lines under marked windows, which may overlap, are covered. A run of covered lines in a row goes
where it has ``least`` characters, white space not counted, or more: three very short lines meet by chance. A run of one repeated
line keeps its first.

Work moves as hashes: the text crosses the network once, at the end. A window that many documents
share is summed up before the shuffle, and the join back to its places can be split.

Defined results: a null text stays null, one without words stays as it is, and
texts of fewer than three lines stay. Rows with equal doc_id and text are one document and all get its
result. Rows that share a doc_id but not the text are never later than each
other. A null doc_id comes last. Columns besides doc_id and text pass through, whatever their names, but for ``n_removed``,
which the result takes. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelake.llm.common import ID, TEXT, drop_stored, stored

BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u202f\u3000"
WHITE = r" \t\n\x{B}\f\r"
#: Last letters behind which a line ends, and such characters of scripts without blanks.
CHOSEN = r"glyGLY37\x{44C}-\x{44F}"
DENSE = r"\x{3001}-\x{302F}\x{5200}-\x{53FF}\x{6700}-\x{67FF}\x{AC00}-\x{AFFF}"
#: What ends a line; the white space behind belongs to it.
END = rf"([.!?{CHOSEN}][\"')\],;:]*[{WHITE}]+|[\n\r][{WHITE}]*|[{DENSE}][{WHITE}]*)"
#: The same for Java: most characters are passed over by one class, that of all the first characters of an end.
QUICK_END = rf"(?=[.!?\n\r{CHOSEN}\x{{3000}}-\x{{FFFF}}])(?:{END[1:]}"
#: Between lines: a text's own MARK is followed by a dash meanwhile.
MARK = "\x01"
LAST = (1 << 63) - 1


def _marked(text):
    return F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(MARK + "-")), QUICK_END, f"$0{MARK}|")


def lines(text=TEXT):
    """The lines of a text, each with the white space behind it; a MARK of its own is followed by a dash."""
    return F.filter(F.split(_marked(F.col(text)), rf"{MARK}\|"), lambda x: x != "")


def _folded(text=TEXT):
    """The same lines as they are compared. White space goes from the whole text at once; trailing marks would make one line more."""
    return F.split(F.lower(F.rtrim(F.translate(_marked(F.col(text)), BLANKS, ""), F.lit(MARK + "|"))), rf"{MARK}\|")


def _windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored windows of each document, and of each of them doc: order of the document;
    k1, k2: its key; pos, a, b: place and hash; size: characters of its lines, 20 bits for each."""
    line = lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g"), F.least(F.length(x), F.lit((1 << 20) - 1)).cast("long").alias("n"))
    hashed = docs.select(F.coalesce(F.col(ID), F.lit(LAST)).alias("doc"), *_key(), F.transform(_folded(), line).alias("l"))
    at = lambda i, f: F.col("l")[i][f]

    def window(i):
        three = lambda f: [at(i + k, f) for k in range(3)]
        n0, n1, n2 = three("n")
        size = F.shiftleft(n0, 40) + F.shiftleft(n1, 20) + n2
        return F.struct(F.xxhash64(*three("h")).alias("a"), F.hash(*three("g")).alias("b"), i.alias("pos"), size.alias("size"))

    made = F.when(F.size("l") >= 3, F.transform(F.sequence(F.lit(0), F.size("l") - 3), window)).alias("w")
    # written once, read when windows are counted and when they are marked
    held = stored(hashed.select("doc", "k1", "k2", made))
    return held, held.select("doc", "k1", "k2", F.inline("w"))


def _key():
    return F.xxhash64(ID, TEXT).alias("k1"), F.hash(TEXT, ID).alias("k2")


def _gone(docs: DataFrame, least: int) -> DataFrame:
    """Stored: (k1, k2, gone, n_gone), the runs of lines that go and their number, of each document that loses some."""
    held, windows = _windows(docs.select(ID, TEXT))
    repeated = windows.groupBy("a", "b").agg(F.min("doc").alias("lo"), F.count("*").alias("n")).where("n > 1")
    # written first: a join of two tables, not of a table and a sum, is split where a window is very common
    repeated = stored(repeated.select("a", "b", "lo"))
    place = F.rank().over(Window.partitionBy("k1", "k2", "a", "b").orderBy("pos"))  # rows that repeat share it
    met = stored(windows.join(repeated, ["a", "b"]))  # apart from the ranks, whose order would keep a common window in one task
    marked = met.withColumn("place", place)
    marked = marked.where((F.col("doc") > F.col("lo")) | (F.col("place") > 1)).select("k1", "k2", "pos", "size")
    key = ["k1", "k2"]
    order = Window.partitionBy(*key).orderBy("pos")
    step = F.coalesce(F.col("pos") - F.lag("pos").over(order), F.lit(4))
    part = lambda k: F.shiftright("size", 40 - 20 * k).bitwiseAND(F.lit((1 << 20) - 1))
    more = F.when(F.col("step") > 0, part(2)).otherwise(0) + F.when(F.col("step") > 1, part(1)).otherwise(0) + F.when(F.col("step") > 2, part(0)).otherwise(0)
    runs = marked.withColumn("step", step).withColumn("more", more)
    runs = runs.withColumn("run", F.sum((F.col("step") > 3).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*key, "run").agg(F.min("pos").alias("first"), (F.max("pos") + 2).alias("last"), F.sum("more").alias("chars"))
    runs = runs.where(F.col("chars") >= least).withColumn("n", F.col("last") - F.col("first") + 1)
    out = stored(runs.groupBy(*key).agg(F.collect_list(F.struct("first", "last")).alias("gone"), F.sum("n").alias("n_gone")))
    for made in (held, repeated, met):
        drop_stored(made)
    return out


def remove_repeats(docs: DataFrame, least: int = 40) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and ``n_removed``, the number of lines cut."""
    keep = [c for c in docs.columns if c != "n_removed"]
    others = F.struct(*(docs[c] for c in keep if c != TEXT)).alias("others")  # their names can't clash with those used here
    joined = docs.select(others, TEXT, *_key()).join(_gone(docs, least), ["k1", "k2"], "left")
    left = F.filter(lines(), lambda x, i: ~F.exists("gone", lambda r: (i >= r["first"]) & (i <= r["last"])))
    text = F.replace(F.array_join(left, ""), F.lit(MARK + "-"), F.lit(MARK))
    text = F.when(F.col("gone").isNull(), F.col(TEXT)).otherwise(text).alias(TEXT)
    n = F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_removed")
    return joined.select(*(text if c == TEXT else F.col("others").getField(c).alias(c) for c in keep), n)


def sql(least: int = 40) -> str:
    """The same in DuckDB's SQL: doc_id, text and n_removed of every row of documents (doc_id is unique there)."""
    end = END.replace("'", "''")
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return rf"""
WITH marked_text AS (SELECT doc_id, text, regexp_replace(replace(coalesce(text, ''), chr(1), chr(1) || '-'), '{end}', '\1' || chr(1) || '|', 'g') AS m FROM documents),
  cut AS (SELECT doc_id, text, list_filter(string_split(m, chr(1) || '|'), lambda x: x <> '') AS l FROM marked_text),
  clean AS (SELECT doc_id, string_split(lower(rtrim(translate(m, {blanks}, ''), chr(1) || '|')), chr(1) || '|') AS c FROM marked_text),
  windows AS (SELECT doc_id, i AS pos, c[i] AS x, c[i + 1] AS y, c[i + 2] AS z FROM (SELECT *, unnest(range(1, len(c) - 1)) AS i FROM clean)),
  marked AS (SELECT doc_id, pos FROM windows QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, pos) > 1),
  covered AS (SELECT doc_id, p, length(c[p]) AS n FROM (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM marked) JOIN clean USING (doc_id)),
  runs AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM covered),
  gone AS (SELECT doc_id, list(p) AS g FROM (SELECT doc_id, p FROM runs QUALIFY sum(n) OVER (PARTITION BY doc_id, run) >= {least}) GROUP BY doc_id)
SELECT doc_id, CASE WHEN g IS NULL THEN text ELSE replace(array_to_string(list_filter(l, lambda x, i: NOT list_contains(g, i)), ''), chr(1) || '-', chr(1)) END AS text,
       coalesce(len(g), 0)::BIGINT AS n_removed
FROM cut LEFT JOIN gone USING (doc_id)"""
