"""Fill-in-the-middle examples: a text cut at two line ends and put together in another order.

All is said with string functions. Two control characters are escaped in the text, so that one of them
is free as a marker; ``regexp_replace`` sets the marker behind every unit, the markers are
counted, and ``substring_index`` takes the parts before, between and after the two markers that the identifier draws.
The parts are unescaped and put between the sentinels.

The draw: the SHA-256 of ``seed:identifier`` gives four numbers. The first two, modulo one more than the number of
units, are the places of the cuts; the third says whether the text is changed at all
(``rate`` in a hundred), the fourth whether the suffix comes first (``spm`` in a hundred) or the prefix (``psm``).

Defined results: a null text counts as empty; empty texts, and texts that hold a sentinel, are ``plain``: their output is
the text and they have no parts. Cuts may meet, so that parts are empty. What
stands behind the last unit (none with lines) belongs to the suffix. A null identifier draws as an empty string does. Rows stand alone: repeated
rows, ties and long texts need nothing special, an empty table gives an empty result. The input row comes
back whole in the struct ``doc``, so no name can clash.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.llm.common import ID, TEXT

#: Units as regular expressions, matched from left to right over the escaped text.
LINES = r"[^\n]*+\n|[^\n]++"
WORDS = r"\s*+\S++"
#: Prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")

_MARK, _ESCAPE = "\x01", "\x02"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_MARK), F.lit(_ESCAPE + "a"))


def _unescaped(part: Column) -> Column:
    """Back from the escaped form, without the markers."""
    bare = F.replace(part, F.lit(_MARK), F.lit(""))
    return F.replace(F.replace(bare, F.lit(_ESCAPE + "a"), F.lit(_MARK)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE))


def _before(marked: Column, n: Column) -> Column:
    return F.call_function("substring_index", marked, F.lit(_MARK), n.cast("int"))


def _number(digest: Column, group: int) -> Column:
    return F.conv(F.substring(digest, 1 + 8 * group, 8), 16, 10).cast("long")


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that can be found again: none begins within another one or within itself."""
    for a, b in product(sentinels, repeat=2):
        if not a or any(b.startswith(a[i:]) or a[i:].startswith(b) for i in range(0 if a is not b else 1, len(a))):
            raise ValueError(f"sentinels {a!r} and {b!r} overlap or one is empty")
    return sentinels


def transform(
    docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, unit: str = LINES, sentinels: tuple[str, str, str] = SENTINELS, id_: str = ID, text: str = TEXT
) -> DataFrame:
    """``doc`` (the input row), ``n`` units, ``form`` (plain, psm or spm), ``prefix``, ``middle``, ``suffix`` (null if plain) and ``output``."""
    p, s, m = map(F.lit, _checked(sentinels))
    whole = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.struct("*").alias("doc"), whole.alias("whole"), digest.alias("digest"))
    marked = F.regexp_replace(_escaped(F.col("whole")), unit, "$0" + _MARK)
    rows = rows.select("doc", "whole", "digest", marked.alias("marked"))
    n = F.length("marked") - F.length(F.replace("marked", F.lit(_MARK), F.lit("")))
    rows = rows.select("*", n.cast("long").alias("n"))
    cuts = [_number(F.col("digest"), k) % (F.col("n") + 1) for k in (0, 1)]
    plain = (F.col("whole") == "") | F.contains("whole", p) | F.contains("whole", s) | F.contains("whole", m) | (_number(F.col("digest"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_number(F.col("digest"), 3) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc", "whole", "marked", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    a, b, marked = F.col("a"), F.col("b"), F.col("marked")
    part = lambda c: F.when(F.col("form") != "plain", _unescaped(c))
    rows = rows.select(
        "doc",
        "n",
        "form",
        "whole",
        part(_before(marked, a)).alias("prefix"),
        part(_before(_before(marked, b), a - b)).alias("middle"),
        part(_before(marked, b - F.col("n") - 1)).alias("suffix"),
    )
    output = (
        F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle"))
        .when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle"))
        .otherwise(F.col("whole"))
    )
    return rows.select("doc", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text, from an output and its form alone: no sentinel stands in a part."""
    p, s, m = map(F.lit, _checked(sentinels))
    between = lambda x, y: F.split_part(F.split_part(output, x, F.lit(2)), y, F.lit(1))
    middle = F.split_part(output, m, F.lit(2))
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def sql() -> str:
    """The query's rows in DuckDB's SQL: lists of lines, cut by slices."""
    return r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS whole, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT *, len(units) AS n,
         [('0x' || substr(h, 1 + 8 * k, 8))::BIGINT FOR k IN range(4)] AS r
  FROM cut),
formed AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN whole = '' OR contains(whole, '<P>') OR contains(whole, '<S>') OR contains(whole, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
              WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix
  FROM formed)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE whole END) AS output_sha256,
       sha256(whole) AS restored_sha256
FROM parts"""
