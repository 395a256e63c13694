"""The consensus caller against enumeration over all genotypes."""

import itertools
import math

import numpy as np
import pytest

from siteloom.operators import calling


def enumerated(like):
    """Likelihood of each number of ALT alleles: all genotypes of all samples."""
    n = len(like)
    out = [0.0] * (2 * n + 1)
    for g in itertools.product(range(3), repeat=n):
        out[sum(g)] += math.prod(math.comb(2, x) * like[i][x] for i, x in enumerate(g))
    return [v / math.comb(2 * n, k) for k, v in enumerate(out)]


@pytest.mark.parametrize("n", range(1, 7))
def test_spectrum_equals_enumeration(n):
    like = 10 ** (-np.random.default_rng(n).uniform(0, 6, (5, n, 3)))
    z, scale = calling.allele_count_spectrum(like)
    for i in range(5):
        want = enumerated(like[i])
        assert (z[i] * np.exp(scale[i])).tolist() == pytest.approx(want, rel=1e-9)


def frame(spark, rows):
    return spark.createDataFrame([("1", i, [(p,) for p in pl]) for i, pl in enumerate(rows)], "chrom string, pos long, samples array<struct<PL:array<int>>>")


def test_calls(spark):
    r = np.random.default_rng(3)
    rows = [[[int(v) for v in r.integers(0, 80, 3)] for _ in range(4)] for _ in range(20)]
    rows += [[[0, 30, 200]] * 4, [[200, 0, 200], [0, 40, 200], [0, 0, 0], None], [[0, 1], [0, None, 4], None, [0, 0, 0]], []]
    got = {x.pos: x for x in calling.consensus_calls(frame(spark, rows).coalesce(1), first_group=[0, 1]).collect()}
    for i, pl in enumerate(rows[:-1]):
        like = [[10 ** (-v / 10) for v in p] if p and len(p) == 3 and None not in p else [1.0] * 3 for p in pl]
        n = len(like)
        prior = [0.0] + [1e-3 / k for k in range(1, 2 * n + 1)]
        prior[0] = 1 - sum(prior)
        post = [a * b for a, b in zip(prior, enumerated(like), strict=True)]
        p_ref, af = post[0] / sum(post), sum(k * v for k, v in enumerate(post)) / sum(post) / (2 * n)
        x = got[i]
        assert (x.p_ref, x.af) == pytest.approx((p_ref, af), abs=1e-9)
        grid = np.linspace(0, 1, 4001)
        ll = lambda some: max(np.log(np.prod([(1 - grid) ** 2 * v[0] + 2 * grid * (1 - grid) * v[1] + grid**2 * v[2] for v in some], axis=0)))
        assert x.chi2 == pytest.approx(2 * (ll(like[:2]) + ll(like[2:]) - ll(like)), abs=5e-3)
        for p, gt, v in zip(pl, x.gts, like, strict=True):
            if v[0] == v[1] == v[2]:
                assert gt == "./."
            elif p_ref >= 0.5:
                assert gt == "0/0"
            else:
                w = [(1 - af) ** 2 * v[0], 2 * af * (1 - af) * v[1], af**2 * v[2]]
                assert gt == ["0/0", "0/1", "1/1"][w.index(max(w))]
    assert got[20].p_ref > 0.99 and got[21].gts[:2] == ["0/1", "0/0"] and got[len(rows) - 1].qual is None
    assert calling.consensus_calls(frame(spark, rows).where("false")).count() == 0


def test_many_samples_stay_finite(spark):
    rows = [[[0, 60, 255]] * 300 + [[255, 0, 255]] * 100]
    x = calling.consensus_calls(frame(spark, rows)).first()
    assert x.qual > 500 and abs(x.af - 0.125) < 0.01 and x.gts.count("0/1") == 100
