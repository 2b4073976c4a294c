"""Empty tables, null ids and texts, and extra columns of clashing names, through whole operators and the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from schemaloom.llm import html_text, lm, quality_rules
from tests.llm.test_corpus_operators import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, documents, labels):
    clash = {c: F.lit("clash") for c in ("score", "kept", "key", "key2", "dealt", "copy", "class_id", "base_failed", "start", "sequence_id")}
    spark.createDataFrame(documents, SCHEMA).withColumns(clash).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def test_model_of_texts_that_are_all_empty(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([None, "", " \n"] * 4)], SCHEMA)
    rows = lm.score(docs, lm.LmParams(vocabulary=4, tails=2, class_size=2, size=2, rounds=1, batch=16, least_steps=2)).collect()
    assert len(rows) == 12 and all(r.n_tokens == 1 and r.n_known == 1 and r.score <= 0 and r.base_score < 0 for r in rows)


def test_model_without_training_documents(spark):
    held = [i for i in range(40) if __import__("zlib").crc32(str(i).encode()) % 5 == 1]
    docs = spark.createDataFrame([(i, "some words here", "en", "s", 0) for i in held], SCHEMA)
    rows = lm.score(docs, lm.LmParams(vocabulary=4, tails=2, class_size=2, size=2, rounds=1)).collect()
    assert len(rows) == len(held) and all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in rows)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).collect() == [] and "n_chars" in html_text.extract(pages).columns


@pytest.mark.parametrize("documents", [[], [(None, None, None, None, None), (1, "", "en", "s", 0)]])
def test_pipeline_without_text(spark, tmp_path, documents):
    path = write(spark, tmp_path, documents, [])
    assert corpus_pipeline.run(spark, path).collect() == []


def test_pipeline_with_null_ids_copies_and_clashing_columns(spark, tmp_path):
    texts = [prose(i, 25 + i) for i in range(24)]
    documents = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    documents += [(None, prose(99, 80), "en", "s", 1), (50, texts[3], "en", "s", 1), (3, texts[3], "en", "s", 1), (51, "ab" * 20_000, None, None, None), (52, None, "en", "s", 0)]
    path = write(spark, tmp_path, documents, [(i, 1, 0) for i in range(24)])
    rows = corpus_pipeline.run(spark, path).collect()
    kept = {r.doc_id for r in rows}
    judged = quality_rules.judge(spark.createDataFrame(documents, SCHEMA)).filter("kept").collect()
    clean = {r.doc_id for r in judged}
    assert len(clean) > 3 and {i for i in clean if i not in (3, 50)} == kept - {3, 50} and len(kept & {3, 50}) == len({3, 50} & clean) // 2 and not kept & {51, 52}
    for r in rows:
        assert 0 <= r.offset < 2048 and r.length >= 1
