"""Genotype likelihoods and base alignment quality against plain enumerations."""

import itertools
import math
import random

import numpy as np
import pytest

from siteloom import queries_models
from siteloom.operators import calling
from siteloom.operators import likelihoods as lk


def plain_tail(q, n, k):
    e = 10 ** (-q / 10)
    return math.fsum(math.comb(n, i) * e**i * (1 - e) ** (n - i) for i in range(k, n + 1))


def plain_likelihoods(reads):
    """reads: (quality, strand, base) of one sample; {(a, b): phred}, read by read from the best quality down."""
    n, against, seen, strands = len(reads), [0.0] * 5, [0] * 5, {}
    for q, strand, base in sorted(reads, key=lambda x: (x[0], x[1], x[2]), reverse=True):
        w = strands.get((strand, base), 0)
        weight = (1 - lk.ETA) * (1 - lk.THETA) ** w + lk.ETA
        against[base] += weight * -10 * math.log10(plain_tail(q, n, seen[base] + 1) / plain_tail(q, n, seen[base]))
        seen[base] += 1
        strands[strand, base] = w + 1
    out = {}
    for a in range(5):
        for b in range(a, 5):
            other = sum(against) - against[a] - (against[b] if a != b else 0)
            het = -4.343 * math.log(math.comb(seen[a] + seen[b], seen[a]) / 2 ** (seen[a] + seen[b])) if a != b else 0
            out[a, b] = max(0.0, other + het)
    return out


def test_likelihoods_equal_a_plain_version():
    r = random.Random(1)
    sites = [[(r.randint(4, 63), r.randint(0, 1), r.randint(0, 3)) for _ in range(r.choice([1, 2, 5, 30]))] for _ in range(40)]
    rows, codes, counts = [], [], []
    for i, reads in enumerate(sites):
        for x in set(reads):
            rows.append(i)
            codes.append(x[0] << 3 | x[1] << 2 | x[2])
            counts.append(reads.count(x))
    order = list(range(len(rows)))
    r.shuffle(order)
    got = lk.genotype_likelihoods(*(np.array([x[k] for k in order]) for x in (rows, codes, counts)), len(sites))
    for i, reads in enumerate(sites):
        for (a, b), v in plain_likelihoods(reads).items():
            assert got[i, a, b] == pytest.approx(v, abs=1e-6) and got[i, b, a] == got[i, a, b]


def test_deep_positions_count_every_read():
    code = np.array([30 << 3, 30 << 3 | 4, 25 << 3 | 1, 25 << 3 | 5])
    got = [lk.genotype_likelihoods(np.zeros(4, int), code, np.array([k, k, k, k]), 1)[0] for k in (50, 500, 5000)]
    assert got[0][0, 0] < got[1][0, 0] < got[2][0, 0]  # against AA, by reads of C
    assert all(g[0, 1] < min(g[0, 0], g[1, 1]) for g in got) and np.isfinite(got[2]).all()
    assert lk.genotype_likelihoods(*[np.zeros(0, int)] * 3, 2).tolist() == np.zeros((2, 5, 5)).tolist()


def enumerated(query, errors, window, band):
    """Chances that base i is a match at place i + band, over all paths of the alignment."""
    length, width = len(query), 2 * band + 1
    stay, leave = 1 - 2 * lk.GAP_OPEN, 1 - lk.GAP_EXTEND
    total, hit = 0.0, [0.0] * length

    def shows(i, place):
        ref = window[place]
        return 1.0 if ref > 3 or query[i] > 3 else 1 - errors[i] if ref == query[i] else errors[i] / 3

    def walk(i, place, state, p, at):
        nonlocal total
        k = place - i
        if not 0 <= k < width:
            return
        if state == "M":
            at = [*at, (i, place)]
        if i == length - 1 and state in "MI":
            total += p
            for x, y in at:
                if y == x + band:
                    hit[x] += p
        to_m, to_i, to_d = {"M": (stay, lk.GAP_OPEN, lk.GAP_OPEN), "I": (leave, lk.GAP_EXTEND, 0), "D": (leave, 0, lk.GAP_EXTEND)}[state]
        if i < length - 1:
            if 0 <= place + 1 - (i + 1) < width:
                walk(i + 1, place + 1, "M", p * to_m * shows(i + 1, place + 1), at)
            if to_i and state != "D":
                walk(i + 1, place, "I", p * to_i * lk.INSERTED, at)
        if to_d and place + 1 - i < width:
            walk(i, place + 1, "D", p * to_d, at)

    for k in range(width):
        walk(0, k, "M", shows(0, k) * (1 - lk.GAP_OPEN) / width, [])
        walk(0, k, "I", lk.INSERTED * lk.GAP_OPEN / width, [])
    return [h / total for h in hit]


@pytest.mark.parametrize("band", [1, 2])
def test_alignment_posteriors_equal_all_paths(band, monkeypatch):
    monkeypatch.setattr(lk, "GAP_OPEN", 0.07)
    monkeypatch.setattr(lk, "GAP_EXTEND", 0.3)
    r = np.random.default_rng(band)
    query, errors, window = r.integers(0, 5, (6, 4)), r.uniform(0.001, 0.3, (6, 4)), r.integers(0, 5, (6, 4 + 2 * band))
    got = lk.match_posteriors(query, errors, window, band)
    for i in range(6):
        assert got[i] == pytest.approx(enumerated(query[i], errors[i], window[i], band), abs=1e-9)


def test_bases_beside_a_missed_indel_are_lowered():
    r = random.Random(5)
    ref = [r.randrange(4) for _ in range(80)]
    exact = ref[20:60]
    shifted = ref[20:52] + ref[54:62]  # two bases are gone near the end, but it is read as one run of matches
    window = np.array(ref[20 - lk.BAND : 60 + lk.BAND])
    quals = [np.full(40, 40), np.full(40, 40)]
    a, b = lk.lowered([np.array(exact), np.array(shifted)], quals, [[(0, 0, 40)]] * 2, [window, window])
    assert a[10:30].min() >= 35 and b[36:].max() < 10 < b[:20].min() and (quals[0] == 40).all()


def test_reads_to_calls(spark):
    """A sample with half of its reads showing another base, one without, odd reads, and partitions that don't matter."""
    ref = "ACGTTGCAAGCTTACGGATCCATGCAGTCA"
    chunks = spark.createDataFrame([("1", k, ref[k * 8 : k * 8 + 8]) for k in range(4)], "chrom string, chunk long, seq string")
    bases = spark.createDataFrame([("1", i + 1, b) for i, b in enumerate(ref)], "chrom string, pos long, base string")
    changed = ref[:14] + "T" + ref[15:]
    rows = [("1", 1, "a", "30M", changed if k % 2 else ref, "I" * 30, 60, k % 3 == 0) for k in range(40)]
    rows += [("1", 1, "b", "30M", ref, "I" * 30, None, None) for _ in range(25)]
    rows += [("1", 3, "b", "2S5M2D6M1S", "NN" + ref[2:7] + ref[9:15] + "A", "I" * 14, 255, True), ("1", 1, "a", "*", "", "", 60, False), ("1", None, "a", "5M", "ACGTT", "IIIII", 60, False), ("1", 1, None, "5M", "ACGTN", "II!II", 60, False), ("1", 1, "a", "5M", None, None, 60, False), ("1", 1, "a", "5M", "ACGTT", "II", 60, False)]
    reads = spark.createDataFrame(rows, "chrom string, pos long, sample string, cigar string, seq string, qual string, mapq int, reverse boolean")
    for baq in (False, True):
        results = [sorted(map(str, lk.sample_likelihoods(lk.base_codes(reads.repartition(k), chunks, 8, baq=baq)).collect())) for k in (1, 7)]
        assert results[0] == results[1]
        sites = lk.likelihood_sites(lk.sample_likelihoods(lk.base_codes(reads, chunks, 8, baq=baq)), ["a", "b"], bases)
        got = {x.pos: x for x in sites.collect()}
        assert len(got) == 30 and got[15].ref == ref[14] and got[15].alts == ["T", "<*>"]
        assert got[15].samples[0].AD[:2] == [20, 20] and got[15].samples[0].PL[1] == 0 and got[15].samples[1].PL[0] == 0
        assert got[8].samples[1].AD[0] == 25 and got[5].samples[0].DP == 40  # deleted in one read; short quality left out
        calls = {x.pos: x for x in calling.multiallelic_calls(sites).collect()}
        assert calls[15].gts == ["0/1", "0/0"] and calls[15].qual > 30 and all(c.gts == ["0/0", "0/0"] for p, c in calls.items() if p != 15)
    assert lk.sample_likelihoods(lk.base_codes(reads.where("false"), chunks, 8, baq=True)).count() == 0


def test_pairs_of_genotypes_are_in_order():
    assert [a * 5 + b for b in range(3) for a in range(b + 1)] == [0, 1, 6, 2, 7, 12]
    assert list(itertools.islice(calling.genotype_pairs(3), 6)) == [(0, 0), (0, 1), (1, 1), (0, 2), (1, 2), (2, 2)]


def plain_call(pls, freqs, theta=calling.THETA, most=3):
    """One site, set after set."""
    pairs = calling.genotype_pairs(len(freqs))
    like = np.nan_to_num(10.0 ** (-pls / 10), nan=1 / len(pairs))
    found = []
    for size in range(1, min(most, len(freqs)) + 1):
        for alleles in itertools.combinations(range(len(freqs)), size):
            total = sum(freqs[a] for a in alleles)
            if total > 0:
                w = [(freqs[a] * freqs[b] / total**2 * (1 + (a != b)) if a in alleles and b in alleles else 0) for a, b in pairs]
                found.append((sum(math.log(max(x @ w, 1e-300)) for x in like) + math.log(theta) * sum(a > 0 for a in alleles), alleles, w))
    ll, best, w = max(found, key=lambda x: x[0])
    calls = []
    for x, raw in zip(like * w, pls, strict=True):
        if np.isnan(raw).any() or len(set(raw)) == 1 and len(raw) > 1:
            calls.append((None, None, 0))
        else:
            rest = 1 - x.max() / x.sum()
            calls.append((*pairs[int(x.argmax())], int(min(127, -4.34294 * math.log(rest))) if rest > 0 else 127))
    p_ref = sum(math.exp(x[0] - ll) for x in found if x[1] == (0,)) / sum(math.exp(x[0] - ll) for x in found)
    return best, calls, min(999.0, -4.34294 * math.log(max(1 - p_ref if best == (0,) else p_ref, 1e-100)))


def test_sites_called_together_equal_sites_called_alone(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(200):
        n_alleles, n_samples = int(r.integers(1, 6)), int(r.integers(1, 4))
        size = len(calling.genotype_pairs(n_alleles))
        pl = [None if r.random() < 0.1 else [7] * size if r.random() < 0.1 else r.integers(0, 120, size if r.random() < 0.9 else size + 1).tolist() for _ in range(n_samples)]
        rows.append(("1", i, "A", list("CGT*")[: n_alleles - 1], [(x,) for x in pl]))
    df = spark.createDataFrame(rows, "chrom string, pos long, ref string, alts array<string>, samples array<struct<PL:array<int>>>")
    got = {x.pos: x for x in calling.multiallelic_calls(df.repartition(3)).collect()}
    assert len(got) == len(rows)
    for _, pos, _, alts, samples in rows:
        pairs = calling.genotype_pairs(len(alts) + 1)
        pls = np.array([[np.nan] * len(pairs) if x is None or len(x) != len(pairs) else x for (x,) in samples], float)
        post = np.nan_to_num(10.0 ** (-pls / 10))
        w = (post / np.maximum(post.sum(1, keepdims=True), 1e-300)).sum(0)
        freqs = np.array([sum(x * ((a == k) + (b == k)) for x, (a, b) in zip(w, pairs, strict=True)) for k in range(len(alts) + 1)])
        freqs = freqs / freqs.sum() if freqs.sum() else np.full(len(freqs), 1 / len(freqs))
        best, calls, qual = plain_call(pls, freqs)
        x = got[pos]
        assert tuple(x.alleles) == best and x.gts == ["./." if a is None else f"{a}/{b}" for a, b, _ in calls] and x.qual == pytest.approx(qual, abs=1e-6)
        assert all(abs(a - c[2]) <= 1 for a, c in zip(x.gqs, calls, strict=True))


def test_read_calls_go_through_the_reads_once(spark):
    """Alignment quality is computed once: the sites' REF comes from the reference, not from the positions found."""
    plan = queries_models.read_calls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4 and "MapInPandas" not in plan


def test_rows_of_a_position_meet_over_batches(spark):
    """Positions whose rows fill several batches, or end with one: batches of any size give the same; no aggregation of single bases is left."""
    r = random.Random(6)
    text = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    rows = [(str(k % 2), 1 + k % 5, r.choice(["a", "b", None]), "6M", text(6, "ACGTN"), text(6, "#+5?I"), r.choice([60, 20, None]), r.random() < 0.5) for k in range(120)]
    reads = spark.createDataFrame(rows, "chrom string, pos long, sample string, cigar string, seq string, qual string, mapq int, reverse boolean").repartition(9)
    bases = spark.createDataFrame([(c, p, "ACGT"[p % 4]) for c in "01" for p in range(1, 12)], "chrom string, pos long, base string")
    found, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for size in ("1", "2", "7", "10000"):
            spark.conf.set(name, size)
            likely = lk.sample_likelihoods(lk.base_codes(reads))
            sites = lk.likelihood_sites(likely, ["a", "b"], bases)
            plain = {}
            for c, p, s, _, seq, qual, mapq, _ in rows:
                for i, b in enumerate(seq):
                    if b != "N":
                        plain.setdefault((c, p + i, s), [0] * 4)["ACGT".index(b)] += 1
            assert {(x.chrom, x.pos, x.sample): x.depth for x in likely.collect()} == plain
            found.append((sorted(str((x.chrom, x.pos, x.sample, np.round(x.likelihoods, 9).tolist())) for x in likely.collect()), sorted(str((x.chrom, x.pos, x.ref, x.alts, x.samples)) for x in sites.collect())))
    finally:
        spark.conf.set(name, before)
    assert all(x == found[0] for x in found) and len(found[0][1]) == 20
    assert "Aggregate" not in queries_models.read_likelihoods(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
