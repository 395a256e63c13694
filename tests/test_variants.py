"""The filter language against a plain interpreter, and operators on small hand-made tables."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.expr import compile_filter
from siteloom.expr.compiler import bre_to_java, compile_value
from siteloom.expr.parser import FilterSyntaxError, parse
from siteloom.functions import stats
from siteloom.operators import annotate, calling, fill_tags, genotypes, hmm, merge, normalize, ranges, select, sequence, setops, windows
from siteloom.plans.project import project
from siteloom.schema import Tag, VariantSchema
from siteloom.sources import tables, vcf

SCHEMA = VariantSchema(
    info={t.id: t for t in (Tag("DP"), Tag("AF", "A", "Float"), Tag("STR", "1", "String"), Tag("FLAG", "0", "Flag"))},
    format={t.id: t for t in (Tag("GT", "1", "String"), Tag("GQ"), Tag("AD", "R"))},
    contigs={"2": 1000, "1": 1000}, samples=["A", "B"],
)


def gt(text):
    if text is None:
        return (None, False)
    sep = "|" if "|" in text else "/"
    return ([None if a == "." else int(a) for a in text.split(sep)], sep == "|")


def site(pos, ref="A", alts=("C",), qual=10.0, filters=("PASS",), dp=5, af=(0.5,), s="x", flag=False, samples=(("0/1", 20, (3, 4)), ("0/0", 30, (9, 0))), chrom="1", id_=None):
    return (chrom, 0, pos, pos + len(ref) - 1, id_, ref, list(alts or ()), qual, list(filters), (dp, list(af) if af else None, s, flag), [(gt(a), b, list(c) if c else None) for a, b, c in samples])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.table_type())


def positions(df):
    return sorted(r.pos for r in df.select("pos").collect())


@pytest.fixture(scope="module")
def sites(spark):
    return frame(spark, [
        site(1), site(2, qual=None, dp=None, filters=()), site(3, alts=("C", "G"), af=(0.1, 0.9), samples=(("1/2", 5, (1, 2, 3)), ("./.", None, None))),
        site(4, ref="AC", alts=("A",), filters=("q10", "s50"), s="a,b", id_="rs1;rs2"), site(5, samples=(("0|1", 50, (0, 7)), ("1", 60, (2, 2))), flag=True, qual=59.2), site(6, alts=(), af=None, samples=(("0/0", 1, (5,)), ("./1", 2, None))),
    ]).cache()


CASES = [
    ("QUAL>9", [1, 3, 4, 5, 6]), ('QUAL="."', [2]), ('QUAL!="."', [1, 3, 4, 5, 6]), ("QUAL=59.2", [5]), ("DP!=5", [2]), ("DP=5 && QUAL>50", [5]), ('FILTER="PASS"', [1, 3, 5, 6]), ('FILTER="s50;q10"', [4]), ('FILTER~"q10"', [4]), ('FILTER="."', [2]),
    ('TYPE="snp"', [1, 2, 3, 5]), ('TYPE="indel"', [4]), ('TYPE="ref"', [6]), ("AF>0.8", [3]), ("AF[0]>0.4", [1, 2, 4, 5]), ("AF[1]>0", [3]), ('GT="het"', [1, 2, 3, 4, 5]), ('GT="mis"', [3, 6]), ('GT="hap"', [5]), ('GT="aA"', [3]), ('GT="RA"', [1, 2, 4, 5]), ('GT="0|1"', [5]),
    ('GQ>25 & GT="het"', [5]), ('GQ>25 && GT="het"', [1, 2, 4, 5]), ("N_ALT=2", [3]), ("N_MISSING=1", [3, 6]), ("AC[0]=2 & AN=3", [5]), ("10-5-2=7", [1, 2, 3, 4, 5, 6]), ("POS%2=0", [2, 4, 6]), ("-POS<-4", [5, 6]), ('STR~"^a$"', [4]), ('STR="x"', [1, 2, 3, 5, 6]),
    ("FLAG=1", [5]), ('ID="rs2"', [4]), ("ILEN<0", [4]), ("STRLEN(REF)=2", [4]), ("N_PASS(GQ>=30)>0", [1, 2, 4, 5]), ("F_PASS(GT=\"alt\")>0.9", [5]), ("MAX(GQ)=60", [5]), ("sSUM(AD)>8", [1, 2, 4]), ("COUNT(AD)=3", [3]), ("FMT/AD[0:1]=4", [1, 2, 4]), ("AD[GT]=7", [5]), ("MEDIAN(GQ)<4", [6]), ("AVG(GQ)=25", [1, 2, 4]), ("STDEV(GQ)=5", [1, 2, 4, 5]),
]


@pytest.mark.parametrize(("expr", "want"), CASES)
def test_filters(sites, expr, want):
    assert positions(sites.where(compile_filter(expr, SCHEMA).site)) == want


def test_sample_masks_follow_the_truth_table(spark):
    """All combinations of site and sample operands against the rules in plain Python."""
    df = frame(spark, [site(p, qual=q, samples=(("0/1", a, None), ("0/0", b, None))) for p, (q, a, b) in enumerate(itertools.product((1.0, 99.0), (1, 50), (1, 50)), 1)])
    rows = {r.pos: r for r in df.collect()}
    terms = {"QUAL>50": lambda r: (r.qual > 50, None), "GQ>10": lambda r: (any(m := [s.GQ > 10 for s in r.samples]), m), 'GT="het"': lambda r: (True, [True, False])}

    def plain(op, a, b):
        (sa, ma), (sb, mb) = a, b
        both, one = ma is not None and mb is not None, ma if ma is not None else mb
        if op in ("&&", "&"):
            s = sa and sb
            if one is None:
                return s, None
            if not both:
                return s, [x and s for x in one] if op == "&&" else one
            m = [(x or y) and s for x, y in zip(ma, mb)] if op == "&&" else [x and y for x, y in zip(ma, mb)]
            return (s if op == "&&" else s and any(m)), m
        s = sa or sb
        if one is None:
            return s, None
        if op == "|":
            return s, [x or y for x, y in zip(ma, mb)] if both else one
        if both:
            return s, [s] * len(one)
        return s, [True] * len(one) if (sa if ma is None else sb) else one

    for (x, fx), (y, fy), op in itertools.product(terms.items(), terms.items(), ("&&", "&", "||", "|")):
        c = compile_filter(f"{x} {op} {y}", SCHEMA)
        got = {r.pos: (r.s, r.m) for r in df.select("pos", c.site.alias("s"), (c.samples if c.samples is not None else F.lit(None).cast("array<boolean>")).alias("m")).collect()}
        assert got == {p: plain(op, fx(r), fy(r)) for p, r in rows.items()}, (x, op, y)


def test_parser():
    assert str(parse("a-b-c", right=True)) == "-(a, -(b, c))"
    assert str(parse("a-b-c", right=False)) == "-(-(a, b), c)"
    assert str(parse("a+b*c>1 && d")) == "&&(>(+(a, *(b, c)), 1), d)"
    for bad in ("", "a &&", "(a", "a b", "MAX("):
        with pytest.raises(FilterSyntaxError):
            parse(bad)
    with pytest.raises(FilterSyntaxError):
        compile_filter("NOPE>1", SCHEMA)
    assert bre_to_java("a+(b)") == r"a\+\(b\)" and bre_to_java(r"a\+\|[+(]") == "a+|[+(]"


def test_exact_tests():
    assert stats.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857143, abs=1e-6)
    assert stats.fisher_two_sided(0, 0, 0, 0) == 1
    assert stats.binomial_two_sided(2, 8) == pytest.approx(0.109375)
    assert stats.binomial_two_sided(0, 0) is None and stats.binomial_two_sided(4, 4) == 1
    # by enumeration: 10 people, 6 rare alleles
    hwe, exc = stats.hwe_exact(14, 6, 2)
    from math import factorial

    w = {h: 2**h / (factorial(h) * factorial((6 - h) // 2) * factorial((14 - h) // 2)) for h in (0, 2, 4, 6)}
    t = sum(w.values())
    assert hwe == pytest.approx(sum(v for v in w.values() if v <= w[2]) / t) and exc == pytest.approx(sum(v for h, v in w.items() if h >= 2) / t)


def test_functions_with_udfs(sites):
    v = compile_value("BINOM(FMT/AD[0:0],FMT/AD[0:1])", SCHEMA).col
    got = {r.pos: r.v for r in sites.select("pos", v.alias("v")).collect()}
    assert got[1] == [1.0] and got[5] == pytest.approx([2 / 128])


def test_interval_join_against_brute_force(spark):
    r = random.Random(1)
    left = [("1", b, b + r.choice([0, 0, 3, 40, 90_000]), i) for i, b in enumerate(r.choices(range(1, 400_000), k=150))]
    right = [("1", b, b + r.choice([0, 10, 5_000, 300_000, 9_000_000])) for b in r.choices(range(1, 400_000), k=60)] + [("2", 1, 1000)]
    a = spark.createDataFrame(left, "chrom string, pos long, end long, n long")
    b = spark.createDataFrame(right, "chrom string, beg long, end long")
    want = sorted((n, x, y) for c, p, e, n in left for d, x, y in right if c == d and p <= y and x <= e)
    assert sorted((q.n, q.r_beg, q.r_end) for q in ranges.overlap_join(a, b).collect()) == want
    hit = {n for n, _, _ in want}
    assert {q.n for q in ranges.overlap_join(a, b, how="semi").collect()} == hit
    assert {q.n for q in ranges.overlap_join(a, b, how="anti").collect()} == set(range(150)) - hit
    outer = ranges.overlap_join(a, b, how="left").collect()
    assert len(outer) == len(want) + 150 - len(hit)


def test_selectors(spark, sites):
    assert positions(select.private(sites, [0])) == [1, 2, 3, 4]
    assert positions(select.trim_alts(sites).where(F.size("alts") == 1)) == [1, 2, 4, 5]
    wide = frame(spark, [site(9, alts=("C", "G"), samples=(("0/2", 1, (5, 0, 6)), ("./.", 2, None)))])
    cut = select.trim_alts(wide, numbers={"AD": "R"}).first()
    assert (cut.alts, cut.samples[0].GT.alleles, cut.samples[0].AD, cut.samples[1].AD) == (["G"], [0, 1], [5, 6], None)
    assert positions(select.phased(sites)) == [5]
    soft = select.soft_filter(sites, "QUAL>20", "low", append=True)
    assert {r.pos: r.filters for r in soft.collect()} == {1: ["low"], 2: ["low"], 3: ["low"], 4: ["q10", "s50", "low"], 5: ["PASS"], 6: ["low"]}
    failed = select.set_failed_genotypes(sites, "GQ>25")
    assert {r.pos: [s.GT.alleles for s in r.samples] for r in failed.collect()}[1] == [[None, None], [0, 0]]


def test_set_operations(spark):
    a = frame(spark, [site(1), site(2), site(3, alts=("C", "G"))])
    b = frame(spark, [site(2), site(3, alts=("G", "C")), site(4)])
    assert positions(setops.intersect([a, b], "=2")) == [2, 3]
    assert positions(setops.complement([a, b])) == [1]
    assert {k: positions(v) for k, v in setops.venn(a, b).items()} == {"only_a": [1], "only_b": [4], "shared_a": [2, 3], "shared_b": [2, 3]}
    assert positions(setops.concat([a, b], "all")) == [1, 2, 3, 4]


def test_normalisation(spark, sites):
    one = normalize.split(sites, SCHEMA).where("pos = 3").orderBy(F.get("alts", F.lit(0))).collect()
    assert [(r.alts, r.info.AF, [s.GT.alleles for s in r.samples], r.samples[0].AD) for r in one] == [(["C"], [pytest.approx(0.1)], [[1, 0], [None, None]], [1, 2]), (["G"], [pytest.approx(0.9)], [[0, 1], [None, None]], [1, 3])]
    back = normalize.join(normalize.split(sites, SCHEMA)).where("pos = 3").first()
    assert back.alts == ["C", "G"] and sorted(back.samples[0].GT.alleles) == [1, 2]
    mnp = normalize.atomize(frame(spark, [site(10, ref="ACG", alts=("TCA",))])).collect()
    assert sorted((r.pos, r.ref, r.alts[0]) for r in mnp) == [(10, "A", "T"), (12, "G", "A")]


def test_left_alignment(spark):
    seq = "GGGCACACACAGGG" + "T" * 40
    base = lambda p: seq[p - 1] if 0 < p <= len(seq) else None
    assert normalize.left_aligned_alleles(9, "ACA", ["A"], base) == (3, "GCA", ["G"])
    assert normalize.left_aligned_alleles(5, "A", ["T"], base) == (5, "A", ["T"])
    chunks = sequence.chunked(spark.createDataFrame([("1", seq)], "chrom string, seq string"), 8)
    out = normalize.left_align(frame(spark, [site(9, ref="ACA", alts=("A",)), site(20)]), chunks, 8)
    assert sorted((r.pos, r.ref, r.alts[0]) for r in out.collect()) == [(3, "GCA", "G"), (20, "A", "C")]


def test_merge(spark):
    a = frame(spark, [site(1, ref="A", alts=("C",)), site(2)])
    b = frame(spark, [site(1, ref="A", alts=("G",), dp=7, filters=("q10",)), site(3)])
    m = {r.pos: r for r in merge.merge(a, b, 2, 2, "both", {"DP": "sum"}).collect()}
    assert m[1].alts == ["C", "G"] and m[1].info.DP == 12 and m[1].filters == ["q10"]
    assert [s.GT.alleles for s in m[1].samples] == [[0, 1], [0, 0], [0, 2], [0, 0]]
    assert [s.GT.alleles for s in m[2].samples] == [[0, 1], [0, 0], [None, None], [None, None]]
    assert [s.GT.alleles for s in merge.merge(a, b, 2, 2, "none", missing_to_ref=True).where("pos = 3").first().samples] == [[0, 0], [0, 0], [0, 1], [0, 0]]


def test_annotation_modes(spark, sites):
    iv = spark.createDataFrame([("1", 1, 2, "p"), ("1", 2, 4, "q")], "chrom string, beg long, end long, v string")
    out = annotate.annotate(sites, iv, {"+id": ("v", "append"), "note": ("v", "unique")})
    assert {r.pos: (r.id, r.note) for r in out.collect()} == {1: ("p", "p"), 2: ("p,q", "p,q"), 3: ("q", "q"), 4: ("rs1;rs2", "q"), 5: (None, None), 6: (None, None)}


def test_tags(sites):
    t = {r.pos: r for r in fill_tags.filled(sites).collect()}
    assert (t[1].AN, t[1].AC, t[1].NS, t[1].AC_Het) == (4, [1], 2, [1])
    assert (t[3].AN, t[3].AC, t[3].NS) == (2, [1, 1], 1)
    assert (t[5].AN, t[5].AC, t[5].AC_Hemi) == (3, [2], [1])
    vaf = fill_tags.with_vaf(sites).where("pos = 3").first().samples[0]
    assert vaf.VAF == [pytest.approx(2 / 6), pytest.approx(3 / 6)] and vaf.VAF1 == pytest.approx(5 / 6)


def test_genotype_operators(sites):
    out = {r.pos: r for r in genotypes.set_gt(sites, "./.", "0").collect()}
    assert out[3].samples[1].GT.alleles == [0, 0] and out[6].samples[1].GT.alleles == [None, 1]
    assert {r.pos: [s.GT.alleles for s in r.samples] for r in genotypes.set_gt(sites, "a", "i").collect()}[1] == [[1, 0], [0, 0]]
    gp = sites.limit(1).select(genotypes.gp_to_gt(F.array(F.lit(0.02), F.lit(0.95), F.lit(0.03)))["alleles"].alias("a"), genotypes.gl_to_pl(F.array(F.lit(-1.0), F.lit(0.0), F.lit(-2.0))).alias("b")).first()
    assert gp.a == [0, 1] and gp.b == [10, 0, 20]


def test_trios(spark):
    def trio(pos, *g):
        return ("1", 0, pos, pos, None, "A", ["C"], 1.0, ["PASS"], (1, [0.1], "x", False), [(gt(x), 1, None) for x in g])

    df = frame(spark, [trio(1, "0/1", "0/0", "0/1"), trio(2, "1/1", "0/0", "0/1"), trio(3, "./.", "0/0", "0/0"), trio(4, "0/1", "0/0", "0/0"), trio(5, "0/0", "0/1", "0/0")])
    assert {r.pos: r.state for r in genotypes.mendelian(df, [(0, 1, 2)]).collect()} == {1: "good", 2: "error", 3: "missing", 4: "error", 5: "good"}
    s = genotypes.trio_stats(df, [(0, 1, 2)]).first()
    assert (s.n_complete, s.n_nonref, s.n_error, s.n_new, s.n_singleton) == (4, 4, 2, 1, 1)


def test_hidden_markov_models():
    r = np.random.default_rng(1)
    e, t = r.random((6, 3)) + 0.05, r.random((3, 3)) + 0.05
    t /= t.sum(1, keepdims=True)
    score = {p: np.prod([e[i, s] for i, s in enumerate(p)]) * np.prod([t[a, b] for a, b in itertools.pairwise(p)]) for p in itertools.product(range(3), repeat=6)}
    assert tuple(hmm.viterbi(e, t)) == max(score, key=score.get)
    total = sum(score.values())
    want = [[sum(v for p, v in score.items() if p[i] == s) / total for s in range(3)] for i in range(6)]
    assert np.allclose(hmm.forward_backward(e, t), want)


def test_pieces_give_what_the_whole_gives(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        in_run = 100 <= i < 220
        g = lambda: "0/0" if in_run and r.random() < 0.5 else "1/1" if in_run else r.choice(["0/0", "0/1", "0/1", "1/1"])
        rows.append(site(1 + 10 * i, samples=((g(), 1, None), (r.choice(["0/0", "0/1", "1/1"]), 1, None))))
    df = frame(spark, rows)
    whole = {(x.sample, x.pos): x.state for x in hmm.runs_of_homozygosity(df, 1e-3, 1e-3).collect()}
    for piece in (1, 7, 120):
        assert whole == {(x.sample, x.pos): x.state for x in hmm.runs_of_homozygosity(df, 1e-3, 1e-3, piece=piece).collect()}
    inside = [whole[0, 1 + 10 * i] for i in range(110, 210) if (0, 1 + 10 * i) in whole]  # sites of one allele are left out
    assert len(inside) > 50 and sum(inside) > 0.9 * len(inside)


def test_calling():
    alleles, calls, qual = calling.site_call(np.array([[0, 30, 60], [40, 0, 40], [60, 30, 0]]), np.array([0.5, 0.5]))
    assert alleles == (0, 1) and [c[:2] for c in calls] == [(0, 0), (0, 1), (1, 1)] and qual > 20
    assert calling.site_call(np.array([[0, 60, 90]] * 4), np.array([0.99, 0.01]))[0] == (0,)


def test_consensus_and_consequences(spark):
    seq = "ACGTACGTACGTACGTACGT"
    chunks = sequence.chunked(spark.createDataFrame([("1", seq)], "chrom string, seq string"), 6)
    df = frame(spark, [site(2, ref="C", alts=("T",)), site(6, ref="CGT", alts=("C",)), site(7, ref="G", alts=("A",)), site(12, ref="T", alts=("TGG",))])
    out = "".join(r.seq for r in sequence.consensus(df, chunks, 6).orderBy("chunk").collect())
    assert out == "AT" + "GTAC" + "ACGTGG" + "ACGTACGT"
    cds = spark.createDataFrame([("t", "1", 3, 14, "+", 0, "ATGGCATGGTAA")], "transcript string, chrom string, beg long, end long, strand string, offset long, seq string")
    v = frame(spark, [site(3, ref="A", alts=("T",)), site(8, ref="A", alts=("G",)), site(7, ref="C", alts=("T",)), site(11, ref="G", alts=("A",)), site(9, ref="T", alts=("TA",)), site(6, ref="GCA", alts=("G",))])
    got = {r.pos: r.consequence for r in sequence.consequences(v, cds).collect()}
    assert got == {3: "start_lost", 8: "synonymous", 7: "missense", 11: "stop_gained", 9: "frameshift", 6: "frameshift"}


def test_windows(spark):
    df = frame(spark, [site(p, samples=(("0/0", d, None), ("0/1", 1, None))) for p, d in ((1, 30), (2, 31), (3, 5), (7, 6), (8, 40))]).withColumn("samples", F.transform("samples", lambda s: s.withField("DP", s["GQ"])))
    blocks = sorted((r.beg, r.end, r.min_dp, r.n) for r in windows.reference_blocks(df, [0, 20]).collect())
    assert blocks == [(1, 2, 30, 2), (3, 3, 5, 1), (7, 7, 6, 1), (8, 8, 40, 1)]
    assert {r.pos: r.n_in_window for r in windows.window_counts(df, 3).collect()} == {1: 3, 2: 3, 3: 3, 7: 2, 8: 2}
    over = frame(spark, [site(1, ref="ACGT", alts=("A",), qual=5.0), site(3, qual=9.0), site(10, qual=1.0)])
    assert {r.pos: r.removed for r in windows.best_non_overlapping(over).collect()} == {1: True, 3: False, 10: False}
    assert {r.pos: r.overlap for r in windows.overlaps(over).collect()} == {1: True, 3: True, 10: False}


def test_text_round_trip(spark, tmp_path):
    text = """##fileformat=VCFv4.2
##contig=<ID=2,length=1000>
##contig=<ID=1,length=1000>
##FILTER=<ID=q10,Description="low">
##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">
##INFO=<ID=AF,Number=A,Type=Float,Description="frequency">
##INFO=<ID=DB,Number=0,Type=Flag,Description="known">
##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="depths">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB
2\t5\trs1\tA\tC,G\t50\tPASS\tDP=3;AF=0.5,0.25;DB\tGT:AD\t0/1:1,2,.\t.|.:.
1\t7\t.\tAC\t.\t.\t.\t.\tGT:AD\t0/0:5\t1:2
"""
    path = tmp_path / "x.vcf"
    path.write_text(text)
    df, schema = vcf.read_vcf(spark, str(path))
    rows = {r.pos: r for r in df.collect()}
    assert rows[5].info.DP == 3 and rows[5].info.AF == [0.5, 0.25] and rows[5].info.DB and rows[5].contig_idx == 0
    assert rows[5].samples[0].GT.alleles == [0, 1] and rows[5].samples[0].AD == [1, 2, None] and rows[5].samples[1].GT.alleles == [None, None] and rows[5].samples[1].GT.phased
    assert rows[7].alts == [] and rows[7].qual is None and rows[7].filters == [] and rows[7].end == 8
    assert [r.line for r in vcf.lines(df, schema).orderBy("contig_idx", "pos").collect()] == text.splitlines()[-2:]
    assert vcf.parse_header(vcf.header_lines(schema)) == schema
    vcf.write_vcf(df, schema, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/records")).count() == 2
    line = project(df, r"%CHROM\t%POS\t%ALT{1}\t%INFO/AF\t[%SAMPLE=%GT ]", schema.samples).where("pos = 5").first().line
    assert line == "2\t5\tG\t0.5,0.25\tA=0/1 B=.|. \n"


def test_side_tables(spark, tmp_path):
    (tmp_path / "a.bed").write_text("1\t0\t10\n")
    (tmp_path / "a.txt").write_text("1\t5\n")
    (tmp_path / "a.fa").write_text(">1 first\nACGT\nAC\n>2\nGG\n")
    assert [tuple(r) for r in tables.read_intervals(spark, str(tmp_path / "a.bed")).collect()] == [("1", 1, 10)]
    assert [tuple(r) for r in tables.read_intervals(spark, str(tmp_path / "a.txt")).collect()] == [("1", 5, 5)]
    assert [tuple(r) for r in tables.parse_regions(spark, "1:5-9,2,3:7").collect()] == [("1", 5, 9), ("2", 1, 1 << 40), ("3", 7, 7)]
    assert {r.chrom: r.seq for r in tables.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == {"1": "ACGTAC", "2": "GG"}


def test_consequence_annotations(spark):
    df = spark.createDataFrame([("1", 1, "A|missense_variant&splice_region_variant|g1,A|stop_gained|g2"), ("1", 2, "A|odd_thing|g1")], "chrom string, pos long, csq string")
    out = sequence.split_consequences(df, F.col("csq"), ["Allele", "Consequence", "gene"], "worst").collect()
    assert {r.pos: (r.gene, r.severity) for r in out} == {1: ("g2", 17), 2: ("g1", len(sequence.SEVERITY))}


def test_tests_of_formats_are_per_sample(spark):
    df = frame(spark, [site(1, samples=(("0/1", 1, (10, 10)), ("0/1", 1, (1, 30)))), site(2, samples=(("0/0", 1, (8, 0)), ("./.", 1, (3, 4))))])
    got = {r.pos: r.v for r in df.select("pos", compile_value("BINOM(FMT/AD)", SCHEMA).col.alias("v")).collect()}
    assert got[1][0] == 1.0 and got[1][1] == pytest.approx(2 * 32 / 2**31) and got[2] == [1.0, None]
    assert [r.pos for r in select.where(df, "BINOM(FMT/AD)<0.01").collect()] == [1]


def test_merge_renumbers_values_of_alleles(spark):
    a = frame(spark, [site(1, ref="A", alts=("C",), samples=(("0/1", 1, (1, 2)), ("0/0", 1, (3, 4))))])
    b = frame(spark, [site(1, ref="A", alts=("G",), samples=(("0/1", 1, (5, 6)), ("1/1", 1, (7, 8))))])
    c = frame(spark, [site(1, ref="A", alts=("G", "C"), samples=(("1/2", 1, (9, 10, 11)), ("0/2", 1, (12, 13, 14))))])
    m = merge.merge_all([a, b, c], [2, 2, 2], "both", numbers={"AD": "R"}).first()
    assert m.alts == ["C", "G"]
    assert [s.AD for s in m.samples] == [[1, 2, None], [3, 4, None], [5, None, 6], [7, None, 8], [9, 11, 10], [12, 14, 13]]
    assert [s.GT.alleles for s in m.samples] == [[0, 1], [0, 0], [0, 2], [2, 2], [2, 1], [0, 1]]


def test_general_numbers(spark):
    from siteloom.functions.text import general

    values = [0.0, 1.0, -2.5, 123456.0, 1234567.0, 1e7, 0.0001, 0.00001234, 100.0, 3.14159265, 999999.6, None, float("inf")]
    # halves that are exact, and decimals of seven digits that lie just above or below one
    values += [38.90625, -38.90625, 2.000005, 1.000005, 999999.5, 1000005.0, 1000015.0, 12345650.0, 0.1234565, 0.1234575, 1.5e-9, 1234565e-20, 1234575e-20]
    r = random.Random(7)
    values += [k / 2**j for j in range(1, 12) for k in (r.randrange(1, 1 << 22) for _ in range(40))]
    values += [float(f"{r.randrange(100000, 1000000)}5e{r.randrange(-16, 4)}") for _ in range(600)] + [float(np.float32(r.uniform(0, 1000))) for _ in range(200)]
    got = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(general(F.col("v")).alias("t")).collect()]
    assert got == [None if v is None else "%g" % v for v in values]


def test_variant_keys():
    from siteloom.functions.variantkey import allele_code, contig_code

    assert [contig_code(x) for x in ("1", "chr22", "X", "chrY", "MT", "M", "GL000")] == [1, 22, 23, 24, 25, 25, 0]
    assert allele_code("A", "C") == 1 << 27 | 1 << 23 | 1 << 19
    assert allele_code("GCA", "G") == 3 << 27 | 1 << 23 | 2 << 21 | 1 << 19 | 0 << 17 | 2 << 15
    long = [allele_code("A" * n, "C" * (14 - n)) for n in range(1, 14)]
    assert len(set(long)) == 13 and all(x & 1 and x < 1 << 31 for x in long)


def test_sliding_prune_against_a_window_by_window_check():
    r = random.Random(3)
    for _ in range(50):
        pos = sorted(r.sample(range(1000), 60))
        for rank in (None, [r.random() for _ in pos]):
            kept = windows.slid(pos, rank, 3, 50)
            assert kept == sorted(kept)
            # no window that starts at a site kept holds more than one site beyond the bound (the one that closed it)
            assert all(sum(pos[k] <= pos[j] < pos[k] + 50 for j in kept) <= 4 for k in kept)
    assert windows.slid([1, 2, 3, 4, 100], None, 2, 10) == [0, 1, 4]
    assert windows.slid([1, 2, 3, 4, 100], [0.1, 0.4, 0.3, 0.2, 0.0], 2, 10) == [1, 2, 4]


def test_left_alignment_over_many_chunks(spark):
    ref = "G" + "A" * 200
    chunks = sequence.chunked(spark.createDataFrame([("1", ref)], "chrom string, seq string"), 8)
    out = normalize.left_align(frame(spark, [site(150, ref="AA", alts=("A",))]), chunks, 8).first()
    assert (out.pos, out.ref, out.alts) == (1, "GA", ["G"])


def test_more_projection_fields(spark):
    df = frame(spark, [site(1, samples=(("0/1", 1, (10, 10)), ("0/1", 1, (1, 30))))])
    info, lines, p = (project(df, f).first().line for f in ("%INFO", "%LINE", "[%PBINOM(AD) ]"))
    assert info.startswith("DP=") and lines.split("\t")[7] == info.strip() and p.split()[0] == "0" and float(p.split()[1]) == pytest.approx(75.2575, rel=1e-4)
