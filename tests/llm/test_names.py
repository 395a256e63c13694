"""Columns of the user's that have the names that operators would use, and the classifiers' sample."""

import corpus_pipeline as p
from pyspark.sql import functions as F

from siteloom.llm import decontamination, labelled, line_dedup, quality_crf
from tests.llm.corpus import frame, texts

NAMES = ["_rid", "_gone", "_llm_score", "_llm_matches", "_doc_id", "_dropped"]


def own_names(spark, rows):
    return frame(spark, rows).withColumns({n: F.lit(f"own {n}") for n in NAMES})


def test_own_columns_pass_every_filter(spark):
    docs = own_names(spark, texts())
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, " ".join(texts()[0][1].split()[:30]))], "item_id long, text string")
    results = {
        "quality": quality_crf.good(docs, labels), "exact": p.exact(spark, docs, ""), "near": p.near(spark, docs, ""), "clean": decontamination.clean(docs, items),
        "lines": line_dedup.without_lines(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), line_dedup.line_duplicates(docs.where("doc_id is not null").dropDuplicates(["doc_id"]))),
    }
    for name, df in results.items():
        assert df.columns == docs.columns, name
        rows = df.select(*NAMES).distinct().collect()
        assert [tuple(r) for r in rows] == [tuple(f"own {n}" for n in NAMES)], name


def test_stages_on_an_empty_table(spark):
    docs = own_names(spark, [])
    for _, stage in p.STAGES[1:3]:
        assert stage(spark, docs, "").count() == 0


def test_long_labelled_texts_are_sampled_too(spark):
    docs = frame(spark, [(i, "é" * 5000 if i % 2 else "short") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    found, y = labelled.sample(docs, labels, "quality", 4, 2, {0: 50, 1: 50}, 2000)
    assert len(found) == sum(1 for i in range(40) if not labelled.held_out([i], 4, 2)[0])
    assert {len(t) for t, k in zip(found, y, strict=True) if k} == {1000} and {t for t, k in zip(found, y, strict=True) if not k} == {"short"}


def test_labelled_texts_have_no_jump_at_the_bound(spark):
    docs = frame(spark, [(1, "é" * 1000), (2, "é" * 1001), (3, "x" * 2500)])
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3)], "doc_id long, quality int")
    found, _ = labelled.sample(docs, labels, "quality", 100, 99, {1: 5}, 2000)
    assert sorted(map(len, found)) == [1000, 1000, 2000]
