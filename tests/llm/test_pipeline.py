"""The stages of the pipeline: columns, decisions, odd rows, and an empty table."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm.language import learn_languages, profile
from scriptorium.llm.quality import learn_quality, statistics
from scriptorium.llm.queries import fold
from scriptorium.session import materialise, read_table
from tests.llm.test_operators import brute_classes


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = read_table(spark, sf, "documents"), [("documents", read_table(spark, sf, "documents"))]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), name)
        out.append((name, docs))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in stages[1:]] == ["language", "quality", "near_duplicates", "personal_data", "packing"]
    assert all(df.columns == stages[0][1].columns for _, df in stages[:-1])
    counts = [df.count() for _, df in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]


def test_decisions(spark, sf, stages):
    by = dict(stages)
    labels = read_table(spark, sf, "labels")
    bad = by["language"].join(labels.filter("quality = 0"), "doc_id", "left_semi").count()
    assert by["quality"].join(labels.filter("quality = 0"), "doc_id", "left_semi").count() < 0.4 * bad
    assert by["quality"].join(labels.filter("quality = 1"), "doc_id", "left_semi").count() >= 0.98 * by["language"].join(labels.filter("quality = 1"), "doc_id", "left_semi").count()
    assert by["near_duplicates"].groupBy("text").count().filter("count > 1").count() == 0
    assert by["personal_data"].filter(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).count() == 0
    assert by["personal_data"].filter("n_chars <> length(text)").count() == 0
    assert by["packing"].groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_language_stage_follows_its_prediction(spark, sf, monkeypatch):
    docs = read_table(spark, sf, "documents")
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("de", "en"))
    kept = corpus_pipeline.language(spark, docs, sf).groupBy("lang").count().collect()
    given = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    assert {r.lang for r in kept if r["count"] > 0.05 * given[r.lang]} <= {"de", "en", None}
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 1.1)
    assert corpus_pipeline.language(spark, docs, sf).count() == 0


def test_first_stages_equal_their_operators(spark, sf, stages):
    """The kept rows of each filter are those whose prediction, made row by row on the driver, passes."""
    by = dict(stages)
    docs = by["documents"].collect()
    model = learn_languages(by["documents"], fold("doc_id", 4) != 2)
    names, scores = model.predict(np.stack([profile(r.text) for r in docs]))
    wanted = sorted(r.doc_id for r, n, s in zip(docs, names, scores) if any(map(str.isalpha, r.text or "")) and s >= corpus_pipeline.LEAST_SCORE)
    assert sorted(r.doc_id for r in by["language"].collect()) == wanted
    trees = learn_quality(by["language"], read_table(spark, sf, "labels"), fold("doc_id", 5) != 0)
    given = by["language"].collect()
    passed = trees.probabilities(np.array([statistics(r.text) for r in given])) >= 0.3
    assert sorted(r.doc_id for r in by["quality"].collect()) == sorted(r.doc_id for r, p in zip(given, passed) if p)
    given, kept = by["quality"].collect(), by["near_duplicates"].collect()
    classes = brute_classes({r.doc_id: r.text for r in given})
    assert sorted(r.doc_id for r in kept) == sorted({classes[r.doc_id][0] for r in given})


def test_odd_rows_and_clashing_columns(spark, sf, tmp_path):
    shutil.copy(f"{sf}/labels.parquet", tmp_path / "labels.parquet")
    rows = [(i, t, None, None, None, 0.5, "x", 1) for i, t in enumerate([None, "", "!!", "some words of a text " * 3, "some words of a text " * 3, "a@b.cd " * 4000])] + [
        (4, "some words of a text " * 3, None, None, None, None, "x", 1),
    ]
    docs = read_table(spark, sf, "documents").withColumns({"score": F.lit(None).cast("double"), "lang_pred": F.lit("x"), "id": F.lit(1)})
    odd = spark.createDataFrame([(-r[0] - 1, *r[1:]) for r in rows], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns[-3:] == ["score", "lang_pred", "id"]
    left = {r.doc_id for r in docs.filter("doc_id < 0").collect()}
    assert not left & {-1, -2, -3, -4}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_near_duplicates_of_null_and_repeated_ids(spark, sf):
    one, two, three = ("some words of a text " * 3, "quite another text of more words", "a third text that nobody else has")
    given = [
        (None, one),
        (None, two),
        (None, two),
        (7, three),
        (7, "the same id but other words in it"),
        (9, one),
        (8, one),
        (3, "alone"),
        (3, "alone"),
    ]
    found = corpus_pipeline.one_of_each(spark, spark.createDataFrame(given, "doc_id long, text string"), sf).collect()
    assert sorted(map(tuple, found), key=str) == sorted({(8, one), (None, two), (7, three), (7, given[4][1]), (3, "alone")}, key=str)


def test_empty_table(spark, sf):
    docs = read_table(spark, sf, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), "empty")
        assert docs.count() == 0
