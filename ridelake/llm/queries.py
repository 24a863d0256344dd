"""The queries of this subpackage over the test tables, and their SQL where SQL can say them.

Each ``opN_<name>`` applies its operator to the whole table and returns the
full result, reduced to the columns its contract names.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.llm import decontaminate, infill, jaccard, language, licences, lines, manifest, merkle, pieces, records, secrets, urls, warc
from ridelake.llm.common import ascii_lower, read_table, shared_dir


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; TOKENIZER_DIR names another folder."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a page is bad where the row of ``labels`` with its identifier says low quality or toxic."""
    labels = read_table(spark, sf_dir, "labels")
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad")
    return urls.judge(read_table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), decontaminate.EDITED)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return lines.remove_repeats(docs.select("doc_id", "text"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs), ["doc_id"])
    of_kind = lambda k: F.size(F.filter("findings", lambda x: x.kind == k)).cast("long")
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    base = F.filter("findings", lambda x: x.kind != "learned")
    return found.select(
        "doc_id",
        of_kind("assign").alias("n_assign"),
        of_kind("access").alias("n_access"),
        of_kind("hex").alias("n_hex"),
        F.sha2(written(base), 256).alias("base_sha256"),
        written("findings").alias("spans"),
        of_kind("learned").alias("n_learned"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    coded = pieces.encode(docs, tokenizer("piece_bpe_32k.model"), ["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.compare_with_edits(read_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    marked = docs.select("doc_id", language.held_out().alias("held_out"), "text")
    return language.predict(marked, model, ["doc_id", "held_out"])


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.size("licence_sentences").cast("long").alias("n_sentences"),
        F.array_join("licence_sentences", ",").alias("sentences"),
        F.array_join("licences", ",").alias("licences"),
    )


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    records.write(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), path)
    return records.read(spark, path)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    warc.archive(read_table(spark, sf_dir, "pages"), path)
    return warc.page_records(spark, path)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transform(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc.doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, manifest.leaf(*fields[:-1], ascii_lower(F.col("text"))))
    made = manifest.proofs(docs, manifest.leaf(*fields), F.col("source"), F.col("doc_id"), [F.col("doc_id"), tampered.alias("tampered")])
    siblings = F.array_join(F.zip_with("left", "right", lambda x, y: F.concat(x, y)), "")
    found = made.select(
        "row.doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        manifest.folded(F.coalesce("row.tampered", "leaf"), F.col("left"), F.col("right")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filter": urls.sql(),
        "op3_line_dedup": lines.sql(),
        "op8_licence_scan": licences.sql(),
        "op10_ngram_jaccard": jaccard.sql(),
        "op11_warc": warc.sql(),
        "op12_fill_in_middle": infill.sql(),
        "op13_merkle_manifest": manifest.sql(),
    }
