"""Distinctive sites against the plain greedy choice."""

import itertools
import random

from siteloom.operators import distinctive
from tests.test_variants import frame, site


def plain(rows, samples, least, blocks):
    pairs = list(itertools.combinations(range(samples), 2))
    apart = {}
    for x in rows:
        gts = [None if None in s[0][0] else tuple(sorted(s[0][0])) for s in x[10]]
        apart[x[0], x[2], x[5], ",".join(x[6])] = {(a, b) for a, b in pairs if gts[a] is not None and gts[b] is not None and gts[a] != gts[b]}
    out, used = [], set()
    for block in range(blocks):
        done = set()
        while len(done) < least:
            free = [(-len(p - done), k) for k, p in apart.items() if k not in used and p - done]
            if not free:
                return out
            site_ = min(free)[1]
            used.add(site_)
            done |= apart[site_]
            out.append((*site_, len(done), block))
    return out


def test_choice_equals_the_plain_one(spark):
    r = random.Random(2)
    gts = ["0/0", "0/1", "1|0", "1/1", "./.", "1"]
    rows = [site(p, samples=tuple((r.choice(gts), 1, None) for _ in range(8)), chrom=r.choice("12")) for p in range(60)] + [site(99, samples=(("0/0", 1, None),) * 8)]
    df = frame(spark, rows)
    for least, blocks in ((1.0, 2), (20, 3), (0.5, 1)):
        want = plain(rows, 8, 28 if least == 1.0 else 14 if least == 0.5 else least, blocks)
        assert distinctive.distinctive_sites(df.repartition(5), least, blocks) == want == distinctive.distinctive_sites(df.coalesce(1), least, blocks)
    assert distinctive.distinctive_sites(df.where("false")) == [] and distinctive.distinctive_sites(df.where("pos = 99")) == []
