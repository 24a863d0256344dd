"""From raw documents to token ids: five stages, each an operator of the training-data subpackage.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the
folder that the cluster shares and reads it again, so a lost executor costs a stage's own tasks at most.
All stages but the last return the columns of documents, with their values, whatever their names: columns that are called like one that an
operator adds are set aside meanwhile. Rows stand for themselves: repeated rows are each kept or dropped by the stage's own rule, texts are read
whole, whatever their length, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.llm import decontaminate, jaccard, language, lines, pieces
from ridelake.llm.common import read_table, stored
from ridelake.llm.queries import tokenizer


#: White space of which a text may be left.
BLANKS = " \t\n\r\x0b\x0c\x85\xa0\u2028\u2029\u3000"


def _set_aside(docs: DataFrame, *added: str) -> tuple[DataFrame, list]:
    """``docs`` with columns renamed that are called like an added one, and the expressions that give the columns of ``docs`` back."""
    taken, names = {c.lower() for c in (*docs.columns, *added)}, {}
    for c in docs.columns:
        names[c] = c
        while names[c].lower() in {a.lower() for a in added} or names[c] != c and names[c].lower() in taken:
            names[c] += "_"
        taken.add(names[c].lower())
    return docs.withColumnsRenamed({c: n for c, n in names.items() if c != n}), [F.col(n).alias(c) for c, n in names.items()]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a recognisable language go: null and empty texts, those without a letter, and those whose score says
    nothing. A null lang is not learned from; rows of equal text are judged alike."""
    model = language.fit(docs.where(~language.held_out()))
    rows, own = _set_aside(docs, "lang_pred", "score")
    return language.predict(rows, model, rows.columns).where(language.accepted()).select(*own)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: repeated passages are cut out; a document of which but white space is left goes. Null and empty texts, and those without a
    repeated passage, stay as they are; n_chars, where there is such a column, follows a cut. Of ties and null doc_ids see ``lines``."""
    rows, own = _set_aside(docs, "n_removed")
    left = stored(lines.remove_repeats(rows))  # a filter pushed below would cut the lines once more
    left = left.where((F.col("n_removed") == 0) | (F.btrim("text", F.lit(BLANKS)) != ""))
    if "n_chars" in docs.columns:
        cut = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", cut.cast(docs.schema["n_chars"].dataType))
    return left.select(*own)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of linked documents the one of smallest doc_id stays, one of them if rows share it, a null doc_id last.
    Texts that are null or without words stay."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item go. Null and empty texts hold none; null items are no items."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"), decontaminate.EDITED).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding: doc_id, ids, n_tokens of every row, none for a null or empty text; a null doc_id stays null."""
    coded = pieces.encode(docs, tokenizer("piece_bpe_32k.model"), ["doc_id"], decode=False)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", cut_repeated_lines),
    ("ngram_jaccard", one_of_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("sentencepiece", token_ids),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
