"""Indexed tables, reports, lists of files, frequencies, random choices, old records."""

import numpy as np
from pyspark.sql import functions as F

from siteloom import queries_views
from siteloom.operators import views
from siteloom.sources import indexed
from tests.test_variants import frame, site


def test_indexed_regions_prune_and_agree(spark, tmp_path):
    df = frame(spark, [site(p, chrom=c, ref="A" * n, alts=("C",)) for c in "12" for p, n in ((1, 1), (5, 10), (1 << 20, 3), ((1 << 20) + 7, 1), (3 << 20, 2))])
    path = str(tmp_path / "t")
    indexed.write_indexed(df, path)
    got = indexed.read_regions(spark, path, [("1", 12, 20), ("2", 1 << 20, (1 << 20) + 1)])
    assert sorted((r.chrom, r.pos) for r in got.collect()) == [("1", 5), ("2", 1 << 20)]
    plan = got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in plan and "contig" in plan.split("PartitionFilters: [")[1].split("]")[0] and "pos" in plan.split("PushedFilters: [")[1].split("]")[0]
    regions = spark.createDataFrame([("1", 12, 20), ("2", 1 << 20, (1 << 20) + 1)], "chrom string, beg long, end long")
    assert sorted((r.chrom, r.pos) for r in indexed.read_region_table(spark, path, regions).collect()) == [("1", 5), ("2", 1 << 20)]
    assert indexed.read_regions(spark, path, []).count() == 0


def test_indexed_regions_equal_a_full_scan(spark, tmp_path):
    """Sites of up to ten million bases, over the borders of bins of all levels."""
    r = np.random.default_rng(5)
    rows = [("1", int(p), int(p + n)) for p, n in zip(r.integers(1, 1 << 28, 300), 10 ** r.uniform(0, 7, 300), strict=True)] + [("1", 100, 5_000_100), ("1", (1 << 23) - 1, 1 << 23), ("1", 7, None), ("2", 1, 1 << 33)]
    df = spark.createDataFrame([(c, p, e, i) for i, (c, p, e) in enumerate(rows)], "chrom string, pos long, end long, i int")
    path = str(tmp_path / "t")
    indexed.write_indexed(df.repartition(3), path)
    asked = [("1", 2_999_990, 3_000_010), ("1", 1 << 23, 1 << 23), ("2", 1 << 32, 1 << 32), ("1", 1, 50)] + [("1", int(b), int(b + n)) for b, n in zip(r.integers(1, 1 << 28, 12), 10 ** r.uniform(0, 7, 12), strict=True)]
    want = lambda q: sorted(i for i, (c, p, e) in enumerate(rows) if any(c == k and p <= to and max(p, e or p) >= b for k, b, to in q))
    for q in ([x] for x in asked[:6]):
        assert sorted(x.i for x in indexed.read_regions(spark, path, q).collect()) == want(q)
    assert sorted(x.i for x in indexed.read_regions(spark, path, asked).collect()) == want(asked)
    table = spark.createDataFrame(asked, "chrom string, beg long, end long")
    assert sorted(x.i for x in indexed.read_region_table(spark, path, table).collect()) == want(asked)


def test_frequencies_do_not_depend_on_neighbours(spark):
    rows = [("1", i, [([0, 20, 40],)] * 5 + [([40, 0, 20 + i],)] * i) for i in range(6)]
    schema = "chrom string, pos long, samples array<struct<PL:array<int>>>"
    together = {x.pos: x.af for x in views.em_frequencies(spark.createDataFrame(rows, schema).coalesce(1)).collect()}
    alone = {row[1]: views.em_frequencies(spark.createDataFrame([row], schema)).first().af for row in rows}
    assert together == alone and together[0] < 1e-4


def test_lists_and_reports(spark, tmp_path):
    for k in "ab":
        frame(spark, [site(ord(k))]).write.parquet(str(tmp_path / k))
    (tmp_path / "list").write_text(f"# tables\n{tmp_path}/a\n\n{tmp_path}/b\n")
    assert sorted(r.pos for r in indexed.read_listed(spark, str(tmp_path / "list")).collect()) == [97, 98]
    indexed.write_report({"SN": spark.createDataFrame([(10,), (2,)], "n int"), "AF": spark.createDataFrame([(None, "x")], "v int, w string")}, str(tmp_path / "report"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "report")).collect()] == ["# SN\tn", "SN\t2", "SN\t10", "# AF\tv\tw", "AF\t.\tx"]


def test_haplotype_files(spark):
    out = indexed.haplotype_files(frame(spark, [site(3, samples=(("0|1", 1, None), ("1", 1, None))), site(2, alts=("C", "G")), site(1, samples=(("./1", 1, None), ("0/0", 1, None)))]))
    assert [tuple(r) for r in out["legend"].collect()] == [("1:1_A_C", 1, "A", "C"), ("1:3_A_C", 3, "A", "C")]
    assert [r.haplotypes for r in out["hap"].collect()][0] == "? 1* 0* 0*"


def test_em_frequency_is_the_best_on_a_grid(spark):
    r = np.random.default_rng(4)
    rows = [(i, [[int(x) for x in r.integers(0, 60, 3)] for _ in range(8)]) for i in range(5)]
    df = spark.createDataFrame([("1", i, [(p,) for p in pl]) for i, pl in rows], "chrom string, pos long, samples array<struct<PL:array<int>>>")
    got = {x.pos: x.af for x in views.em_frequencies(df).collect()}
    grid = np.linspace(0, 1, 2001)
    for i, pl in rows:
        like = 10 ** (-np.array(pl) / 10)
        total = np.log(like @ np.stack([(1 - grid) ** 2, 2 * grid * (1 - grid), grid**2]) + 1e-300).sum(0)
        assert abs(got[i] - grid[total.argmax()]) < 2e-3


def test_random_sites_and_old_records(spark):
    df = frame(spark, [site(i) for i in range(1, 2001)])
    a, b = ({r.pos for r in views.random_sites(df, 0.3, seed).collect()} for seed in (1, 2))
    assert 500 < len(a) < 700 and a == {r.pos for r in views.random_sites(df.repartition(7), 0.3, 1).collect()} and a != b
    assert views.with_old_record(frame(spark, [site(4, ref="AC", alts=("A", "T"))])).first().OLD_REC == "1|4|AC|A,T"


def test_minimal_alleles(spark):
    rows = [("A", "C", "A>C"), ("ACA", "CCA", "A>C"), ("GTCA", "GCA", "GT>G"), ("A", "<DEL>", "A><DEL>"), ("AAA", "AA", "AA>A"), ("CA", "CA", "C>C")]
    got = spark.createDataFrame(rows, "r string, a string, want string").select(views.minimal_allele(F.col("r"), F.col("a")).alias("got"), "want").collect()
    assert [x.got for x in got] == [x.want for x in got]


def test_rank_z_of_shifted_histograms(spark):
    t = spark.createDataFrame([([5, 0, 0], [0, 0, 5]), ([0, 0, 5], [5, 0, 0]), ([3, 3, 3], [3, 3, 3]), ([0, 0], [1, 1]), ([2, 0], [2, 0])], "a array<int>, b array<int>")
    z = [r.z for r in t.select(views.rank_z(F.col("a"), F.col("b")).alias("z")).collect()]
    assert z[0] > 2 and z[1] == -z[0] and z[2] == 0 and z[3] is None and z[4] == 0


def test_rank_bias_is_computed_once_and_over_all_depths(spark, tmp_path):
    """The score stands once in the plan (not again in a filter below it), and depths above 410 count like others."""
    quantities = [1, 9, 15, 17, 401, 433, 500]
    spark.createDataFrame([(1, 1, "F", 1000.0, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 1, i + 1, float(q), 2.0) for i, q in enumerate(quantities)], "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries_views.rank_bias(spark, str(tmp_path))
    called = [q for q in quantities if q % 7]
    a, b = ([q // 10 for q in called if (q % 3 > 0) == w] for w in (False, True))
    n, u = len(called), sum((x < y) + (x == y) / 2 for x in a for y in b)
    ties = sum(k**3 - k for k in ([*a, *b].count(x) for x in set(a + b)))
    z = (u - len(a) * len(b) / 2) / (len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1)))) ** 0.5
    assert [(r.pos, r.z) for r in got.collect()] == [(1, round(z, 6))]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("SQRT(") == 1


def test_rank_z_of_places(spark):
    rows = [[(2, False), (1, False), (9, True), (None, True), (3, None)], [(1, True)], [], None]
    t = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v array<struct<place:bigint,which:boolean>>")
    z = [r.z for r in t.orderBy("i").select(views.rank_z_of(F.col("v")).alias("z")).collect()]
    whole = spark.range(1).select(views.rank_z(F.array(*[F.lit(x) for x in (1, 1, 0)]), F.array(*[F.lit(x) for x in (0, 0, 1)])).alias("z")).first().z
    assert z == [whole, None, None, None]
