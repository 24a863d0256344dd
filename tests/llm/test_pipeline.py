"""The pipeline's stages one by one, on nulls, empty and very long texts, repeated rows, other columns and an empty table."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, label string, fp string"


def documents(spark):
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 9)))
    text = lambda n: " ".join(word() + ("." if r.random() < 0.2 else "") for _ in range(n))
    texts = [text(60) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(20, None), (21, ""), (22, "123 456"), (23, texts[3]), (3, texts[3]), (24, text(30_000)), (5, text(40)), (None, texts[4])]
    return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else "de", "s", len(t or ""), "x", "y") for i, t in rows], COLUMNS).repartition(3)


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = documents(spark)
    spark.createDataFrame([(1, None), (2, "no such passage stands in any of these texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        ids = [x.doc_id for x in out.collect()]
        assert set(range(12)) - {3, 4} <= set(ids), name
        if name == "language_id":
            assert not {20, 21, 22} & set(ids)
        if name == "ngram_jaccard":  # of the equal texts one row stays; the other document of identifier 5 is no copy
            assert sorted(i for i in ids if i in (3, 23)) == [3] and None not in ids and ids.count(5) == 2 and {20, 21, 22} <= set(ids)
    name, stage = corpus_pipeline.STAGES[-1]
    made = stage(spark, docs, str(tmp_path))
    assert made.columns == ["doc_id", "ids", "n_tokens"] and made.count() == docs.count()
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_run_from_end_to_end_on_odd_rows(spark, tmp_path):
    """Columns named like those that stages add come through each stage with their values, and every clean document gets its ids."""
    own = {"score": "own score", "lang_pred": "own language", "n_removed": "own count", "SCORE_": "own too"}
    docs = documents(spark)
    for name, value in own.items():
        docs = docs.withColumn(name, F.lit(value))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns and kept.schema["score"].dataType.simpleString() == "string", name
        assert {tuple(x) for x in kept.select(*own).distinct().collect()} == {tuple(own.values())}, name
        kept = corpus_pipeline.stored(kept)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [x.doc_id for x in out]
    assert set(range(12)) - {3, 4} <= set(ids) and not {20, 21, 22, 23} & set(ids) and ids.count(5) == 2
    assert all(x.n_tokens == len(x.ids) > 0 for x in out)


def test_a_cut_text_of_white_space_goes(spark, tmp_path):
    lines = "\n".join(f"this is line number {i} of a passage that stands twice." for i in range(8))
    rows = [(1, lines, 9), (2, lines + "\n\n\t\n", 9), (3, "\n\n", 2), (4, None, None)]
    left = corpus_pipeline.cut_repeated_lines(spark, spark.createDataFrame(rows, "doc_id long, text string, n_chars int"), "").collect()
    assert sorted(x.doc_id for x in left) == [1, 3, 4]
