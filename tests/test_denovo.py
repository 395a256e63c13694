"""Trio scores against a triple loop over genotypes."""

import math
import random

import numpy as np
import pytest

from siteloom.operators import denovo


def plain(pls, n, way, novel_only=False):
    """The best de-novo combination against the sum of all, one by one; inheritance by listing the child's alleles."""
    g = denovo.genotypes(n)
    total, best = 0.0, (0.0, None)
    for i, f in enumerate(g):
        for j, m in enumerate(g):
            for k, c in enumerate(g):
                passed, copies = denovo.transmission(f, m, c, way, novel_only)
                w = denovo.parental_prior(f, m, way) * (denovo.MUTATION**copies if copies else passed * (1 - denovo.MUTATION))
                p = w * 10 ** (-(pls[0][i] + pls[1][j] + pls[2][k]) / 10)
                total += p
                if passed == 0 and p > best[0]:
                    best = (p, c)
    return math.log(best[0] / total), best[1]


@pytest.mark.parametrize("way", ["autosome", "son", "daughter"])
@pytest.mark.parametrize("n", [2, 3, 4])
def test_scores_equal_a_triple_loop(way, n):
    r = np.random.default_rng(n)
    size = n * (n + 1) // 2
    pls = r.integers(0, 60, (12, 3, size)).astype(float)
    for novel_only in (False, True):
        got, allele = denovo.scores(pls[:, 0], pls[:, 1], pls[:, 2], n, way, novel_only=novel_only)
        for i in range(12):
            want, child = plain(pls[i], n, way, novel_only)
            assert got[i] == pytest.approx(want, abs=1e-9) and allele[i] in child


@pytest.mark.parametrize("way", ["autosome", "son", "daughter"])
def test_inheritance(way):
    """What the parents' alleles can give isn't de novo, and the rest is, but for a son's two alleles."""
    for f in denovo.genotypes(3):
        for m in denovo.genotypes(3):
            if way == "daughter" and f[0] != f[1]:
                continue
            possible = {(x, x) for x in m} if way == "son" else {tuple(sorted((x, y))) for x in f for y in m}
            for c in denovo.genotypes(3):
                if way == "son" and c[0] != c[1]:
                    continue
                passed, copies = denovo.transmission(f, m, c, way)
                assert (passed > 0) == (c in possible) == (copies == 0)
    assert sum(denovo.parental_prior(f, m, "autosome") > 0 for f in denovo.genotypes(4) for m in denovo.genotypes(4)) == 100


def test_de_novo(spark):
    clear = {"00": [0, 120, 250], "01": [250, 0, 250], "11": [250, 120, 0]}
    rows = []
    for i, (c, f, m) in enumerate([("01", "00", "00"), ("01", "01", "00"), ("11", "00", "00"), ("11", "11", "01"), ("00", "11", "00")]):
        rows.append(("1", i, "A", ["C"], [(clear[x], [10, 30]) for x in (c, f, m)]))
        rows.append(("X", i, "A", ["C"], [(clear[x], [10, 30]) for x in (c, f, m)]))
    rows += [("1", 20, "A", ["C"], [(None, None), (clear["00"], None), (clear["00"], None)]), ("1", 21, "A", [], [([0], [1])] * 3), ("1", 22, "A", ["C", "G"], [(clear["00"], None)] * 3)]
    df = spark.createDataFrame(rows, "chrom string, pos long, ref string, alts array<string>, samples array<struct<PL:array<int>,AD:array<int>>>")
    from pyspark.sql import functions as F

    got = {(x.chrom, x.pos, x.trio): x for x in denovo.de_novo(df, [(0, 1, 2, "m"), (0, 1, 2, "f")], F.col("chrom") == "X").collect()}
    assert len(got) == 20
    new = {(c, p): got[c, p, 0].dnm > -1 for c, p, _ in got}
    assert [new["1", p] for p in range(5)] == [True, False, True, False, True]
    # a son has his X from the mother: what his father has doesn't matter; a daughter has her father's only X
    assert [got["X", p, 0].dnm > -1 for p in (2, 3, 4)] == [True, False, False] and got["X", 4, 1].dnm > -1
    assert got["1", 0, 0].allele == 1 and got["1", 0, 0].vaf == 0.75 and got["1", 4, 0].dnm <= 0
    novel = {(x.chrom, x.pos): x.dnm for x in denovo.de_novo(df, [(0, 1, 2, "m")], novel_only=True).collect()}
    assert novel["1", 0] > -1 and novel["1", 4] < -5
    assert denovo.de_novo(df.where("false"), [(0, 1, 2, "m")]).count() == 0


def test_published_example():
    """A heterozygous child of two parents without the allele, deep."""
    child, mother, father = [255, 0, 255, 255, 255, 255], [0, 196, 255, 196, 255, 255], [0, 202, 255, 202, 255, 255]
    score, allele = denovo.scores(*(np.array([x], float) for x in (father, mother, child)), 3, "autosome")
    assert abs(score[0]) < 1e-3 and allele[0] == 1
    r = random.Random(2)
    assert all(denovo.weights(n, w)[0].shape == (n * (n + 1) // 2,) * 3 for n in (2, r.randint(3, 4)) for w in denovo.REF_ONLY)
