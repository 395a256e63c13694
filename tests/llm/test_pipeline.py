from collections import Counter, defaultdict

import corpus_pipeline as p
from siteloom.llm.common import ASCII_LOWER
from tests.llm.corpus import frame, texts
from tests.llm.test_dedup import brute_components


def low(t):
    return (t or "").encode().translate(ASCII_LOWER)


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_quality_stage_takes_long_labelled_texts(spark, tmp_path):
    good, bad = "Some plain words stand here.\n" * 5, "BUY!! NOW!! $$$ ||| BUY!!\n" * 5
    # 140 thousand characters: times the classifier's bound in bytes more than 32 bits hold
    docs = frame(spark, [(i, (good if i % 2 else bad) * (1000 if i < 4 else 1)) for i in range(40)])
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = p.quality(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(d for d, _ in rows_of(out).elements()) == list(range(1, 40, 2))


def test_exact_stage_keeps_the_largest_id(spark):
    rows = texts()
    docs = frame(spark, rows)
    out = p.exact(spark, docs, "")
    assert out.columns == docs.columns
    best = {}
    for d, t in rows:
        k = low(t)
        if k not in best or best[k][0] is None or (d is not None and d > best[k][0]):
            best[k] = (d, t)
    assert rows_of(out) == Counter(best.values())


def test_near_stage_keeps_one_of_each_component(spark):
    rows = [r for r in texts() if r[0] is not None]
    docs = frame(spark, rows)
    out = p.near(spark, docs, "")
    assert out.columns == docs.columns
    # components by row: the tests' brute force works on distinct ids
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    groups = defaultdict(list)
    for (i, _, c), n in brute_components(numbered).items():
        assert n == 1
        groups[c].append(i)
    want = Counter()
    for members in groups.values():
        want[min(rows[i][0] for i in members)] += 1
    assert Counter(d for d, _ in rows_of(out).elements()) == want


def test_stage_list():
    assert [k for k, _ in p.STAGES] == ["quality", "exact_dedup", "ngram_join", "decontamination", "packing"]
    assert set(p.queries()) == {"pipeline"} and p.oracle_sql() == {}


def test_whole_pipeline(spark, tmp_path):
    rows = texts()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    item = " ".join((rows[0][1] or "").split()[:30])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id for r in p.run(spark, str(tmp_path)).collect()}
    # without labels only empty texts go; then copies, near copies, and what holds the item
    assert {0, 100, 200, 300, 301}.isdisjoint(got)
    assert {1, 501} <= got and not {101, 400, 401} & got
