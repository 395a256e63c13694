"""Calling: alleles and genotypes from genotype likelihoods; pileup counts from aligned reads."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The prior of a site to vary, and the likelihood ratio that makes it one.
THETA = 1.1e-3


def genotype_pairs(n_alleles: int) -> list[tuple[int, int]]:
    return [(a, b) for b in range(n_alleles) for a in range(b + 1)]


def site_calls(pls: np.ndarray, freqs: np.ndarray, theta: float = THETA, most: int = 3) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Calls of sites with as many alleles and samples, by maximum likelihood: sets of alleles, the set that each site keeps, genotype
    (a place in :func:`genotype_pairs`, -1: none) and quality of each sample, site quality.

    ``pls``: sites x samples x genotypes, phred; ``freqs``: sites x alleles. Sets of one to ``most`` alleles compete; each
    further allele costs a factor theta. All sites go through a set together.
    """
    n_alleles = freqs.shape[1]
    pairs = genotype_pairs(n_alleles)
    like = 10.0 ** (-pls / 10)
    like = np.where(np.isnan(like), 1 / len(pairs), like)
    sets = [x for size in range(1, min(most, n_alleles) + 1) for x in combinations(range(n_alleles), size)]

    def weights(alleles: tuple[int, ...], some: np.ndarray, least: float) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        f = freqs[some][:, list(alleles)]
        total = f.sum(1)
        q = dict(zip(alleles, (f / np.maximum(total, least)[:, None]).T, strict=True))
        return total, [(k, q[a] * q[b] * (1 if a == b else 2)) for k, (a, b) in enumerate(pairs) if a in q and b in q]

    every = np.arange(len(pls))
    ll = np.empty((len(sets), len(pls)))
    for i, alleles in enumerate(sets):
        total, w = weights(alleles, every, 1e-300)
        fit = sum(like[:, :, k] * x[:, None] for k, x in w)
        ll[i] = np.where(total > 0, np.log(np.maximum(fit, 1e-300)).sum(1) + np.log(theta) * len([a for a in alleles if a]), -np.inf)
    best = ll.argmax(0) if len(pls) else np.zeros(0, int)
    gt, gq = np.full(pls.shape[:2], -1), np.zeros(pls.shape[:2], int)
    flat = (pls == pls[:, :, :1]).all(2) & (len(pairs) > 1)
    for i, alleles in enumerate(sets):
        some = np.flatnonzero(best == i)
        if not len(some):
            continue
        row = np.zeros((len(some), *pls.shape[1:]))
        for k, x in weights(alleles, some, 1e-12)[1]:
            row[:, :, k] = like[some, :, k] * x[:, None]
        s, k = row.sum(2), row.argmax(2)
        none = (s <= 0) | np.isnan(pls[some]).any(2) | flat[some]
        rest = 1 - np.take_along_axis(row, k[:, :, None], 2)[:, :, 0] / np.where(s > 0, s, 1)
        sure = np.where(rest > 0, np.minimum(127, -4.34294 * np.log(np.where(rest > 0, rest, 1))), 127).astype(int)
        gt[some], gq[some] = np.where(none, -1, k), np.where(none, 0, sure)
    top = ll.max(0)
    top = np.where(np.isfinite(top), top, 0)
    p_ref = np.exp(ll[0] - top) / np.maximum(np.exp(ll - top).sum(0), 1e-300)
    p = np.where(best == 0, 1 - p_ref, p_ref)
    return sets, best, gt, gq, np.minimum(999.0, -4.34294 * np.log(np.maximum(p, 1e-100)))


def site_call(pls: np.ndarray, freqs: np.ndarray, theta: float = THETA, most: int = 3) -> tuple[tuple[int, ...], list[tuple[int | None, int | None, int]], float]:
    """:func:`site_calls` of one site: alleles kept, (allele, allele, quality) of each sample, site quality."""
    sets, best, gt, gq, qual = site_calls(np.asarray(pls, float)[None], np.asarray(freqs, float)[None], theta, most)
    pairs = [*genotype_pairs(len(freqs)), (None, None)]
    return sets[best[0]], [(*pairs[k], int(q)) for k, q in zip(gt[0], gq[0], strict=True)], float(qual[0])


def multiallelic_calls(df: DataFrame, theta: float = THETA) -> DataFrame:
    """chrom, pos, alleles, gts, gqs, qual for sites with FORMAT/PL; allele frequencies from the likelihoods themselves.

    Sites of a batch with as many alleles and samples are solved together. Null PL and those of another length say nothing.
    """
    t = df.select("chrom", F.col("pos").cast("long").alias("pos"), (F.size("alts") + 1).alias("n"), F.transform("samples", lambda s: F.transform(s["PL"], lambda v: v.cast("double"))).alias("pl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n").to_numpy(zero_copy_only=False).astype(int)
            lengths = lambda c: c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
            samples, inner = lengths(b.column("pl")), b.column("pl").flatten()
            sizes, values = lengths(inner), inner.flatten().to_numpy(zero_copy_only=False)
            first, begin = np.cumsum(samples) - samples, np.cumsum(sizes) - sizes
            for n_alleles, n_samples in sorted(set(zip(n.tolist(), samples.tolist(), strict=True))):
                pairs = genotype_pairs(n_alleles)
                names = pa.array([f"{a}/{c}" for a, c in pairs] + ["./."])
                rows = np.flatnonzero((n == n_alleles) & (samples == n_samples))
                # as many sites at once as keep the likelihoods within some MB
                step = max(1, 1_000_000 // max(1, n_samples * len(pairs)))
                for some in (rows[k : k + step] for k in range(0, len(rows), step)):
                    at = first[some][:, None] + np.arange(n_samples)
                    known = sizes[at] == len(pairs) if at.size else np.zeros(at.shape, bool)
                    m = np.full((*at.shape, len(pairs)), np.nan)
                    m[known] = values[begin[at[known]][:, None] + np.arange(len(pairs))] if known.any() else np.nan
                    post = np.nan_to_num(10.0 ** (-m / 10))
                    w = (post / np.maximum(post.sum(2, keepdims=True), 1e-300)).sum(1)
                    share = np.zeros((len(some), n_alleles))
                    for k, (x, y) in enumerate(pairs):
                        share[:, x] += w[:, k]
                        share[:, y] += w[:, k]
                    total = share.sum(1, keepdims=True)
                    share = np.where(total > 0, share / np.where(total > 0, total, 1), 1 / n_alleles)
                    sets, best, gt, gq, qual = site_calls(m, share, theta)
                    cuts = pa.array(np.arange(len(some) + 1) * n_samples, pa.int32())
                    gts = pa.ListArray.from_arrays(cuts, names.take(pa.array(np.where(gt < 0, len(pairs), gt).ravel(), pa.int64())))
                    columns = [pa.array([list(x) for x in sets], pa.list_(pa.int32())).take(pa.array(best, pa.int64())), gts, pa.ListArray.from_arrays(cuts, pa.array(gq.ravel(), pa.int32())), pa.array(qual, pa.float64())]
                    keys = [b.column(c).take(pa.array(some, pa.int64())) for c in ("chrom", "pos")]
                    yield pa.RecordBatch.from_arrays([*keys, *columns], names=["chrom", "pos", "alleles", "gts", "gqs", "qual"])

    return t.mapInArrow(run, "chrom string, pos long, alleles array<int>, gts array<string>, gqs array<int>, qual double")


def allele_count_spectrum(likelihoods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """sites x (2n + 1) likelihoods of each number of ALT alleles among n diploid samples, each row scaled, and the logs of the scales.

    ``likelihoods``: sites x samples x 3 (by number of ALT alleles). All ways to deal k alleles to the samples weigh the
    same; samples are added one by one.
    """
    sites, n, _ = likelihoods.shape
    z, scale = np.zeros((sites, 2 * n + 1)), np.zeros(sites)
    z[:, 0] = 1
    for j in range(1, n + 1):
        k, m = np.arange(2 * j + 1), 2 * j
        one, two = np.zeros((sites, m + 1)), np.zeros((sites, m + 1))
        one[:, 1:], two[:, 2:] = z[:, :m], z[:, : m - 1]
        p = likelihoods[:, j - 1, :, None]
        new = ((m - k) * (m - k - 1) * p[:, 0] * z[:, : m + 1] + 2 * k * (m - k) * p[:, 1] * one + k * (k - 1) * p[:, 2] * two) / (m * (m - 1))
        total = np.maximum(new.sum(1), 1e-300)
        z[:, : m + 1] = new / total[:, None]
        scale += np.log(total)
    return z, scale


def _best_frequency(like: np.ndarray, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """ALT frequency of sites x samples x 3 likelihoods by expectation and maximisation, and its log likelihood.

    There may be several summits: it begins at a low, an even and a high frequency, and the best end counts.
    """
    weigh = lambda g: np.stack([(1 - g) ** 2, 2 * g * (1 - g), g * g], 1)[:, None]
    best, best_ll = np.zeros(len(like)), np.full(len(like), -np.inf)
    for start in (0.02, 0.5, 0.98):
        f = np.full(len(like), start)
        moving = np.arange(len(like)) if like.shape[1] else np.zeros(0, int)
        while len(moving):
            post = like[moving] * weigh(f[moving])
            post /= np.maximum(post.sum(2, keepdims=True), 1e-300)
            new = (post[:, :, 1] + 2 * post[:, :, 2]).mean(1) / 2
            still = np.abs(new - f[moving]) >= tolerance
            f[moving] = new
            moving = moving[still]
        ll = np.log(np.maximum((like * weigh(f)).sum(2), 1e-300)).sum(1)
        best, best_ll = np.where(ll > best_ll, f, best), np.maximum(ll, best_ll)
    return best, best_ll


def consensus_calls(df: DataFrame, theta: float = 1e-3, variant_below: float = 0.5, first_group: list[int] | None = None) -> DataFrame:
    """chrom, pos, qual, p_ref, af, gts, gqs, chi2 of REF and the first ALT by the spectrum of allele counts.

    The prior of k ALT alleles among 2n is theta / k. ``p_ref`` is the chance of none of them, ``af`` the expected share; a
    site varies if ``p_ref`` is below ``variant_below``. Genotypes take the proportions of that share as their prior. ``chi2``:
    twice the gain in log likelihood if the samples of ``first_group`` have a frequency of their own (null without one).
    Null, short and flat PL say nothing; a site without samples has null results. Sites of a batch are solved together.
    """
    pl = F.transform("samples", lambda s: F.when((F.size(s["PL"]) >= 3) & F.forall(s["PL"], lambda v: v.isNotNull()), F.slice(s["PL"], 1, 3)).otherwise(F.array(F.lit(0), F.lit(0), F.lit(0))))
    t = df.select("chrom", F.col("pos").cast("long").alias("pos"), F.transform(F.flatten(pl), lambda v: v.cast("double")).alias("p"))
    schema = "chrom string, pos long, qual double, p_ref double, af double, gts array<string>, gqs array<int>, chi2 double"

    def solved(p: np.ndarray) -> list[tuple]:
        like = 10 ** (-p / 10)
        n = p.shape[1]
        z, _ = allele_count_spectrum(like)
        k = np.arange(2 * n + 1)
        prior = np.concatenate([[0.0], theta / k[1:]])
        prior[0] = max(1 - prior.sum(), 1e-300)
        post = z * prior
        post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
        p_ref, rest = post[:, 0], post[:, 1:].sum(1)
        af = post @ k / (2 * n)
        qual = -4.343 * np.log(np.maximum(np.where(p_ref < variant_below, p_ref, rest), 1e-100))
        f = af[:, None]
        weigh = np.stack([(1 - f) ** 2, 2 * f * (1 - f), f * f], 2)
        g = like * weigh
        g /= np.maximum(g.sum(2, keepdims=True), 1e-300)
        best = np.where((p_ref < variant_below)[:, None], g.argmax(2), 0)
        wrong = 1 - np.take_along_axis(g, best[:, :, None], 2)[:, :, 0]
        gq = np.minimum(99, np.floor(-4.343 * np.log(np.maximum(wrong, 1e-10)) + 0.499)).astype(int)
        flat = (p == p[:, :, :1]).all(2)
        chi2 = [None] * len(p)
        if first_group is not None:
            other = [i for i in range(n) if i not in set(first_group)]
            parts = [_best_frequency(like[:, x])[1] for x in (list(range(n)), [i for i in first_group if i < n], other)]
            chi2 = np.maximum(0, 2 * (parts[1] + parts[2] - parts[0])).tolist()
        names = np.array(["0/0", "0/1", "1/1"])
        return [(float(min(q, 999.0)), float(a), float(b), np.where(m, "./.", names[c]).tolist(), np.where(m, 0, d).tolist(), x) for q, a, b, c, d, m, x in zip(qual, p_ref, af, best, gq, flat, chi2, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.float64()]
        for b in batches:
            column = b.column("p")
            sizes, flat = np.diff(column.offsets.to_numpy()) // 3, column.flatten().to_numpy(zero_copy_only=False)
            starts, out = np.concatenate([[0], np.cumsum(3 * sizes)]), [(None,) * 6] * b.num_rows
            for n in set(sizes.tolist()) - {0}:
                rows = np.flatnonzero(sizes == n)
                # as many sites at once as keep the spectrum within some MB
                for at in range(0, len(rows), max(1, 1_000_000 // (2 * n + 1))):
                    some = rows[at : at + max(1, 1_000_000 // (2 * n + 1))]
                    p = np.stack([flat[starts[i] : starts[i] + 3 * n].reshape(n, 3) for i in some])
                    for i, x in zip(some, solved(p), strict=True):
                        out[i] = x
            yield pa.RecordBatch.from_arrays([b.column("chrom"), b.column("pos"), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names=["chrom", "pos", "qual", "p_ref", "af", "gts", "gqs", "chi2"])

    return t.mapInArrow(run, schema)


def pileup(reads: DataFrame, least_quality: int = 0) -> DataFrame:
    """chrom, pos, sample and counts of bases from aligned reads (chrom, pos, sample, cigar, seq, mapq).

    CIGAR operations are walked by array functions; only M, = and X give bases. A partial aggregation precedes the shuffle.
    """
    ops = F.expr(r"regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 0)")
    parsed = F.transform(ops, lambda o: F.struct(F.regexp_extract(o, r"^\d+", 0).cast("int").alias("n"), F.right(o, F.lit(1)).alias("op")))
    zero = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<r:int,q:int,n:int>>").alias("out"))

    def step(acc, o):
        both = o["op"].isin("M", "=", "X")
        r = acc["r"] + F.when(both | o["op"].isin("D", "N"), o["n"]).otherwise(0)
        q = acc["q"] + F.when(both | o["op"].isin("I", "S"), o["n"]).otherwise(0)
        return F.struct(r.alias("r"), q.alias("q"), F.when(both, F.concat(acc["out"], F.array(F.struct(acc["r"].alias("r"), acc["q"].alias("q"), o["n"].alias("n"))))).otherwise(acc["out"]).alias("out"))

    blocks = F.aggregate(parsed, zero, step)["out"]
    e = reads.where(F.col("mapq") >= least_quality).select("chrom", "pos", "sample", "seq", F.explode(blocks).alias("b"))
    b = e.select("chrom", "sample", "seq", "pos", "b", F.explode(F.sequence(F.lit(0), F.col("b.n") - 1)).alias("i"))
    base = b.select("chrom", (F.col("pos") + F.col("b.r") + F.col("i")).alias("pos"), "sample", F.upper(F.substr("seq", F.col("b.q") + F.col("i") + 1, F.lit(1))).alias("base"))
    return base.groupBy("chrom", "pos", "sample").agg(*[F.count_if(F.col("base") == x).alias(f"n_{x.lower()}") for x in "ACGT"], F.count(F.lit(1)).alias("depth"))
