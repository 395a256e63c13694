"""Merging of blocks against a plain sweep over positions, with any number of partitions."""

import random

import pytest

from siteloom.operators import gvcf, merge
from tests.test_variants import frame, site


def random_tables(seed):
    """Three tables of blocks and sites on two contigs; blocks of one table don't overlap."""
    r = random.Random(seed)
    out = []
    for t in range(3):
        rows, dp = [], 100 * t
        for chrom in "12":
            pos = r.randint(1, 10)
            while pos < 120:
                dp += 1
                if r.random() < 0.25:
                    rows.append((chrom, pos, pos, "G", r.choice([("T",), ("T", "<*>"), ("A",)]), dp))
                    pos += r.randint(1, 3)
                else:
                    n = r.choice([2, 5, 11, 40])
                    rows.append((chrom, pos, pos + n - 1, "ACGT"[pos % 4], ("<*>",) if r.random() < 0.7 else (), dp))
                    pos += n + r.choice([0, 0, 1, 6])
        out.append(rows)
    return out


def plain(tables, logic_key):
    """{(chrom, at, until, alts): depths of the tables} by walking over every position."""
    out = []
    for chrom in "12":
        cuts = set()
        for rows in tables:
            for c, b, e, _, _, _ in rows:
                if c == chrom:
                    cuts |= {b, e + 1}
        at = sorted(cuts)
        for lo, hi in zip(at, at[1:], strict=False):
            blocks = {t: next((x for x in rows if x[0] == chrom and x[1] <= lo and x[2] >= lo and x[2] > x[1]), None) for t, rows in enumerate(tables)}
            sites = [(t, x) for t, rows in enumerate(tables) for x in rows if x[0] == chrom and x[1] == x[2] == lo]
            keys = {logic_key(x) for _, x in sites} or {None}
            for k in keys:
                depths, alts = [], []
                for t in range(3):
                    own = next((x for s, x in sites if s == t and logic_key(x) == k), None)
                    x = own if own else None if any(s == t for s, _ in sites) else blocks[t]
                    depths.append(x[5] if x else None)
                    alts += [a for a in (x[4] if x else ()) if a not in alts]
                if any(d is not None for d in depths):
                    out.append((chrom, lo, hi - 1, ",".join(alts), tuple(depths)))
    return sorted(out)


def table(spark, rows):
    return frame(spark, [(*site(b, ref=ref, alts=alts, samples=(("0/0" if not alts or alts == ("<*>",) else "0/1", dp, None),), chrom=c)[:3], e, *site(b, ref=ref, alts=alts, samples=(("0/0" if not alts or alts == ("<*>",) else "0/1", dp, None),), chrom=c)[4:]) for c, b, e, ref, alts, dp in rows])


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("partitions", ["1", "13"])
def test_pieces_equal_a_plain_sweep(spark, seed, partitions):
    tables = random_tables(seed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((x.chrom, x.pos, x.end, ",".join(x.alts), tuple(s.GQ for s in x.samples)) for x in gvcf.merge_blocks([table(spark, t) for t in tables], [1, 1, 1], "none").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(tables, lambda x: (x[3], tuple(sorted(x[4]))))


def test_values_of_the_unseen_allele(spark):
    """A block gives its unseen allele's values for alleles it doesn't know; REF from bases, blocks or N."""
    block = lambda pos, end, pl, ref="C": (*site(pos, ref=ref, alts=("<*>",), samples=(("0/0", 5, pl),))[:3], end, *site(pos, ref=ref, alts=("<*>",), samples=(("0/0", 5, pl),))[4:])
    a = frame(spark, [block(1, 10, (0, 4, 10))])
    b = frame(spark, [site(5, ref="C", alts=("T",), samples=(("0/1", 7, (4, 0, 9)),))])
    rows = gvcf.merge_blocks([a, b], [1, 1], "both", numbers={"AD": "G"}).orderBy("pos").collect()
    assert [(x.pos, x.end, x.ref, x.alts) for x in rows] == [(1, 4, "C", ["<*>"]), (5, 5, "C", ["<*>", "T"]), (6, 10, "N", ["<*>"])]
    assert rows[1].samples[0].AD == [0, 4, 10, 10, 10, 10] and rows[1].samples[1].AD == [4, 0, 0, 0, 0, 9]
    assert [s.GT.alleles for s in rows[1].samples] == [[0, 0], [0, 2]] and rows[0].samples[1].GT.alleles == [None, None]
    bases = spark.createDataFrame([("1", 6, "g")], "chrom string, pos long, base string")
    assert [x.ref for x in gvcf.merge_blocks([a, b], [1, 1], bases=bases).orderBy("pos").collect()] == ["C", "C", "G"]
    # a site cuts a block of its own contig; its own block gives way; blocks of one base are sites; empty tables
    c = frame(spark, [block(1, 10, (0, 4, 10)), site(3, ref="A", alts=("G",), samples=(("1/1", 9, None),)), block(12, 12, None)])
    got = [(x.pos, x.end, x.samples[0].GQ) for x in gvcf.merge_blocks([c, b.where("false")], [1, 1]).orderBy("pos").collect()]
    assert got == [(1, 2, 5), (3, 3, 9), (4, 10, 5), (12, 12, 5)]
    assert gvcf.merge_blocks([b.where("false"), a.where("false")], [1, 1]).count() == 0


def test_missing_rules(spark):
    a, b = frame(spark, [site(5, ref="C", alts=("T",), samples=(("0/1", 7, (4, 0, 9)),))]), frame(spark, [site(5, ref="C", alts=("G",), samples=(("0/1", 7, (8, None, 1)),))])
    got = {k: [s.AD for s in merge.merge_all([a, b], [1, 1], "both", numbers={"AD": "G"}, missing=rule).first().samples] for k, rule in (("none", None), ("dot", {"AD": "."}), ("max", {"AD": "max"}), ("zero", {"AD": 0}))}
    assert got["none"] == got["dot"] == [[4, 0, 9, None, None, None], [8, None, None, None, None, 1]]
    assert got["max"] == [[4, 0, 9, 9, 9, 9], [8, 8, 8, None, 8, 1]] and got["zero"] == [[4, 0, 9, 0, 0, 0], [8, 0, 0, None, 0, 1]]


def test_local_alleles(spark):
    schema = "chrom string, pos long, alts array<string>, samples array<struct<PL:array<int>,AD:array<int>,DP:int>>"
    pl = [90, 80, 70, 60, 50, 40, 0, 30, 20, 10]  # of 00 01 11 02 12 22 03 13 23 33
    rows = [("1", 1, ["C", "G", "T"], [(pl, [5, 0, 1, 7], 3), (None, None, None), ([1, 2], [1, 2, 3, 4], 4)]), ("1", 2, ["C"], [([0, 3, 9], [4, 1], 5)]), ("1", 3, [], [([0], [4], 5)])]
    df, numbers = spark.createDataFrame(rows, schema), {"PL": "G", "AD": "R"}
    got = {x.pos: x.samples for x in merge.localized(df, 1, numbers).collect()}
    assert [tuple(s) for s in got[1]] == [([3], [90, 0, 10], [5, 7], 3), ([1, 2, 3], None, None, None), ([1, 2, 3], [1, 2], [1, 2, 3, 4], 4)]
    assert tuple(got[2][0]) == ([1], [0, 3, 9], [4, 1], 5) and tuple(got[3][0]) == ([], [0], [4], 5)
    two = merge.localized(df, 2, numbers)
    assert {x.pos: x.samples[0].LAA for x in two.collect()} == {1: [2, 3], 2: [1], 3: []}
    # all that is kept comes back, what was left out by the rule
    back = {x.pos: x.samples for x in merge.delocalized(two, numbers, {"PL": "max", "AD": 0}).collect()}
    assert tuple(back[1][0]) == ([90, 90, 90, 60, 90, 40, 0, 90, 20, 10], [5, 0, 1, 7], 3) and tuple(back[2][0]) == ([0, 3, 9], [4, 1], 5)
    whole = merge.delocalized(merge.localized(df, 3, numbers), numbers)
    assert sorted(map(str, whole.where("pos > 1").collect())) == sorted(map(str, df.where("pos > 1").collect())) and whole.first().samples[0].PL == pl
