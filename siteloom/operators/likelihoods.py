"""Genotype likelihoods of bases from aligned reads.

1. Reads may first have their base qualities lowered by *base alignment quality*: a hidden Markov model aligns the read to
   the reference around it, in a band, and a base is worth no more than the chance that it lies where its alignment has
   it. Reads of a batch that are equally long go through the model together, as numpy arrays of reads by band.
2. Every read gives its bases with a code of quality, strand and base. Codes are counted inside the task, a row for each
   position and sample of a batch of reads; one exchange by position, sorted by it, brings the rows of a position
   together. Nothing is left out however deep it is.
3. The likelihoods take reads from the best quality down. A base that a strand has shown before counts less, as errors
   aren't independent: of its w-th read the weight is (1 - eta) * (1 - theta)**w + eta. What a read says against a
   genotype is the share of binomial tails, for as many errors as have been seen.
4. A site's alleles are REF, the other bases by their share of quality, and ``<*>``; its samples get PL, DP and AD in
   the layout of variant tables, as :func:`siteloom.operators.calling.multiallelic_calls` takes them.

Defined results: bases other than A, C, G and T, bases below ``least_quality`` and those in insertions, deletions, skips and
clips don't count; a null or unknown mapping quality (255) counts as 20; reads with a null sequence, CIGAR or position
are left out, and so are reads whose qualities are missing or of another length; samples without reads at a site have
null PL; repeated reads count each time. REF is the base of ``chunks``; positions without one are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dependence of errors (theta) and the weight that no read falls below (eta), of the published error model.
THETA, ETA = 0.83, 0.03
#: Bounds of a base's quality, and a mapping quality for reads that have none.
LEAST_Q, MOST_Q, UNKNOWN_MAPQ = 4, 63, 20
#: Gap opening and extension of the alignment model, half its band, and how likely an error shows any one other base.
GAP_OPEN, GAP_EXTEND, BAND, INSERTED = 1e-3, 0.1, 7, 0.25
BASES = "ACGT"
CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
_CODE = np.full(256, 4, np.int8)
for _i, _b in enumerate(BASES):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


# --- base alignment quality
def match_posteriors(query: np.ndarray, errors: np.ndarray, window: np.ndarray, band: int = BAND) -> np.ndarray:
    """The chance that base i of each read is a match at place i + band of its window.

    ``query``: reads x length, codes of bases; ``errors``: chances of an error; ``window``: reads x (length + 2 band), the
    reference from ``band`` bases before the read on. Forward and backward over reads at once; column k of the band is
    place i + k of the window.
    """
    n, length = query.shape
    width = 2 * band + 1
    stay, leave = 1 - 2 * GAP_OPEN, 1 - GAP_EXTEND
    match = np.zeros((length, n, width))
    inserted, deleted = np.zeros_like(match), np.zeros_like(match)
    scale = np.zeros((length, n))

    def emission(i: int) -> np.ndarray:
        ref, q, e = window[:, i : i + width], query[:, i, None], errors[:, i, None]
        return np.where((ref > 3) | (q > 3), 1.0, np.where(ref == q, 1 - e, e / 3))

    for i in range(length):
        if i == 0:  # it may begin anywhere in the band
            m, ins = emission(0) * (1 - GAP_OPEN) / width, np.full((n, width), INSERTED * GAP_OPEN / width)
        else:
            m = emission(i) * (stay * match[i - 1] + leave * (inserted[i - 1] + deleted[i - 1]))
            # a base without a place in the reference: the band moves by one
            ins = np.zeros((n, width))
            ins[:, :-1] = INSERTED * (GAP_OPEN * match[i - 1][:, 1:] + GAP_EXTEND * inserted[i - 1][:, 1:])
        d = np.zeros((n, width))
        for k in range(1, width):
            d[:, k] = GAP_OPEN * m[:, k - 1] + GAP_EXTEND * d[:, k - 1]
        s = (m + ins + d).sum(1)
        scale[i] = s
        match[i], inserted[i], deleted[i] = m / s[:, None], ins / s[:, None], d / s[:, None]
    # the end: in a match or an insertion
    last = (match[-1] + inserted[-1]).sum(1)
    bm, bi = np.ones((n, width)) / last[:, None], np.ones((n, width)) / last[:, None]
    bd = np.zeros((n, width))
    out = np.zeros((n, length))
    for i in range(length - 1, -1, -1):
        if i < length - 1:
            ahead = emission(i + 1) * bm / scale[i + 1][:, None]
            grown = np.zeros((n, width))
            grown[:, 1:] = INSERTED * bi[:, :-1] / scale[i + 1][:, None]
            new_i = leave * ahead + GAP_EXTEND * grown
            new_d = leave * ahead
            new_m = stay * ahead + GAP_OPEN * grown
            for k in range(width - 2, -1, -1):
                new_d[:, k] += GAP_EXTEND * new_d[:, k + 1]
                new_m[:, k] += GAP_OPEN * new_d[:, k + 1]
            bm, bi, bd = new_m, new_i, new_d
        out[:, i] = match[i][:, band] * bm[:, band]
    del bd
    return np.clip(out, 0, 1)


def _runs(cigar: str) -> list[tuple[int, int, int]]:
    """(place in the reference, place in the read, length) of each run of matches."""
    out, r, q = [], 0, 0
    for n, op in CIGAR.findall(cigar):
        n = int(n)
        if op in "M=X":
            out.append((r, q, n))
            r, q = r + n, q + n
        elif op in "DN":
            r += n
        elif op in "IS":
            q += n
    return out


def lowered(codes: list[np.ndarray], quals: list[np.ndarray], runs: list[list[tuple[int, int, int]]], windows: list[np.ndarray], band: int = BAND) -> list[np.ndarray]:
    """Base qualities capped by alignment quality; ``windows``: reference codes from ``band`` bases before each read's place on.

    Each run of matches is aligned with ``band`` bases to either side. A base keeps the best of what the bases before it
    and those after it in the run are sure of, the lower of the two (so ends of runs fall, not whole runs).
    """
    pieces: dict[int, list[tuple[int, int, int]]] = {}
    for i, rs in enumerate(runs):
        for r, q, n in rs:
            pieces.setdefault(n, []).append((i, r, q))
    out = [x.copy() for x in quals]
    for n, some in pieces.items():
        query = np.stack([codes[i][q : q + n] for i, _, q in some])
        qual = np.stack([quals[i][q : q + n] for i, _, q in some])
        window = np.stack([windows[i][r : r + n + 2 * band] for i, r, _ in some])
        for (i, _, q), row in zip(some, _capped(query, qual, window, band), strict=True):
            out[i][q : q + n] = row
    return out


def _capped(query: np.ndarray, qual: np.ndarray, window: np.ndarray, band: int = BAND) -> np.ndarray:
    """:func:`lowered` of runs of one length: reads x length, and reads x (length + 2 band)."""
    p = match_posteriors(query, 10.0 ** (-np.maximum(qual, 1) / 10), window, band)
    sure = np.minimum(99, np.floor(-4.343 * np.log(np.maximum(1 - p, 1e-10)) + 0.5)).astype(np.int64)
    return np.minimum(qual, np.minimum(np.maximum.accumulate(sure, 1), np.maximum.accumulate(sure[:, ::-1], 1)[:, ::-1]))


# --- the error model
@lru_cache(maxsize=20_000)
def _tails(q: int, n: int) -> np.ndarray:
    """For k = 0..n-1: what the next error after k says, in phred, among ``n`` reads of quality ``q``.

    It is the ratio of the chances of more than k and of at least k errors.
    """
    e = 10.0 ** (-q / 10)
    k = np.arange(n + 1)
    choose = np.concatenate([[0.0], np.cumsum(np.log(np.arange(n, 0, -1)) - np.log(np.arange(1, n + 1)))])
    terms = choose + k * np.log(e) + (n - k) * np.log1p(-e)
    tail = np.logaddexp.accumulate(terms[::-1])[::-1]  # ln of at least k errors
    return -10 / np.log(10) * (tail[1:] - tail[:-1])


def genotype_likelihoods(row: np.ndarray, code: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """rows x 5 x 5 phred likelihoods of unordered genotypes; the fifth base is one that nobody shows.

    ``code``: quality << 3 | strand << 2 | base of ``count`` reads of ``row``.
    """
    order = np.lexsort((-code, row))
    row, code = np.repeat(row[order], count[order]), np.repeat(code[order], count[order])
    base, strand, q = code & 3, code >> 2 & 1, np.clip(code >> 3, LEAST_Q, MOST_Q)

    def seen_before(group: np.ndarray) -> np.ndarray:
        by = np.argsort(group, kind="stable")
        s = group[by]
        first = np.r_[0, np.flatnonzero(np.diff(s)) + 1] if len(s) else np.zeros(0, np.int64)
        at = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
        out = np.empty(len(s), np.int64)
        out[by] = at
        return out

    weight = (1 - ETA) * (1 - THETA) ** seen_before(row * 8 + strand * 4 + base) + ETA
    errors = seen_before(row * 4 + base)
    depth = np.bincount(row, minlength=rows)
    # the tails of each (quality, depth) that occurs, one after the other
    key, which = np.unique(q * (1 << 40) + depth[row], return_inverse=True)
    tails = [_tails(k >> 40, k & ((1 << 40) - 1)) for k in key.tolist()]
    starts = np.cumsum([0, *[len(x) for x in tails]])[:-1].astype(np.int64)
    said = np.concatenate([*tails, np.zeros(0)])[starts[which] + errors] if len(key) else np.zeros(0)
    against = np.bincount(row * 4 + base, weights=weight * said, minlength=rows * 4).reshape(rows, 4)
    seen = np.bincount(row * 4 + base, minlength=rows * 4).reshape(rows, 4)
    against, seen = (np.concatenate([x, np.zeros((rows, 1))], 1) for x in (against, seen))
    total = against.sum(1)
    out = np.zeros((rows, 5, 5))
    factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, depth.max(initial=0) + 1)))])
    for j in range(5):
        out[:, j, j] = total - against[:, j]
        for k in range(j + 1, 5):
            a, b = seen[:, j].astype(int), seen[:, k].astype(int)
            het = -4.343 * (factorial[a + b] - factorial[a] - factorial[b] - np.log(2) * (a + b))
            out[:, j, k] = out[:, k, j] = total - against[:, j] - against[:, k] + het
    return np.maximum(out, 0)


# --- the Spark side
def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a column of texts, where each begins, and how many it has; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    cuts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), cuts[:-1], np.diff(cuts)


def _matrix(texts: tuple[np.ndarray, np.ndarray, np.ndarray], rows: np.ndarray, length: int) -> np.ndarray:
    """rows x length bytes of :func:`_texts`."""
    return texts[0][texts[1][rows, None] + np.arange(length)] if length else np.zeros((len(rows), 0), np.uint8)


def _counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of whole numbers, sorted, and how often each occurs. They are sorted as one number where they fit in it."""
    least = [int(c.min()) if len(c) else 0 for c in columns]
    wide = [int(c.max()) - m + 1 if len(c) else 1 for c, m in zip(columns, least, strict=True)]
    if math.prod(wide) >= 1 << 62:
        keys, n = np.unique(np.stack(columns), axis=1, return_counts=True)
        return list(keys), n
    key = np.zeros(len(columns[0]), np.int64)
    for c, m, w in zip(columns, least, wide, strict=True):
        key = key * w + (c - m)
    key, n = np.unique(key, return_counts=True)
    out = []
    for m, w in zip(least[::-1], wide[::-1], strict=True):
        out.append(key % w + m)
        key = key // w
    return out[::-1], n


def base_codes(reads: DataFrame, chunks: DataFrame | None = None, width: int = 0, least_quality: int = 1, baq: bool = False) -> DataFrame:
    """chrom, pos, sample, codes: the codes of the bases that reads show, each as count << 9 | code.

    A row is what a batch of reads shows; a position and sample may have several, in one partition and beside each other.

    ``reads``: chrom, pos (of the first matched base), sample, cigar, seq, qual (text, from 33), mapq, reverse. With ``baq``
    the qualities are lowered first, by the reference in ``chunks`` (chrom, chunk, seq) of ``width`` bases.
    """
    t = reads.select("chrom", F.col("pos").cast("long").alias("pos"), F.col("sample").cast("string").alias("sample"), "cigar", "seq", "qual", F.coalesce(F.nullif("mapq", F.lit(255)), F.lit(UNKNOWN_MAPQ)).cast("int").alias("mapq"), F.coalesce("reverse", F.lit(False)).alias("reverse"))
    t = t.where("chrom is not null and pos is not null and cigar is not null and seq is not null and length(seq) = length(qual)")
    if baq:
        # a read's stretch of reference: the few chunks that it touches
        span = F.aggregate(F.expr(r"transform(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), x -> cast(x as int))"), F.lit(0), lambda a, b: a + b)
        t = t.withColumn("_id", F.monotonically_increasing_id()).withColumn("_from", F.greatest((F.col("pos") - 1 - BAND).cast("long"), F.lit(0).cast("long"))).withColumn("_to", F.col("pos") - 1 + span + BAND)
        places = t.select("chrom", F.col("_from"), F.col("_to")).distinct()
        cut = places.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width)))).join(chunks, ["chrom", "chunk"])
        window = cut.groupBy("chrom", "_from", "_to").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias("_s"), (F.min("chunk") * width).alias("_at"))
        window = window.select("chrom", "_from", "_to", F.substr("_s", (F.col("_from") - F.col("_at") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int")).alias("window"))
        t = t.join(window, ["chrom", "_from", "_to"], "left").drop("_id", "_to")
    else:
        t = t.withColumn("_from", F.lit(0).cast("long")).withColumn("window", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 4000):
                b = whole.slice(begin, 4000)
                seq, qual, window = (_texts(b.column(c)) for c in ("seq", "qual", "window"))
                cigar = b.column("cigar").dictionary_encode()
                pos, start, mapq = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "_from", "mapq"))
                strand = b.column("reverse").to_numpy(zero_copy_only=False).astype(np.int64) << 2
                off = BAND - (pos - 1 - start)  # less before the contig's first base
                # reads alike in CIGAR and lengths are matrices
                alike = np.stack([cigar.indices.to_numpy(), seq[2], *([window[2], off] if baq else [])])
                alike, which = np.unique(alike[:, seq[2] == qual[2]], axis=1, return_inverse=True)
                members = np.flatnonzero(seq[2] == qual[2])[np.argsort(which.ravel(), kind="stable")]
                groups, pieces = [], {}
                for k, rows in zip(alike.T.tolist(), np.split(members, np.cumsum(np.bincount(which.ravel(), minlength=alike.shape[1]))[:-1]), strict=True):
                    runs = [r for r in _runs(cigar.dictionary[k[0]].as_py()) if r[1] + r[2] <= k[1]]
                    codes, quals = _CODE[_matrix(seq, rows, k[1])], _matrix(qual, rows, k[1]).astype(np.int64) - 33
                    groups.append((rows, runs, codes, quals))
                    if baq and runs:
                        need = runs[-1][0] + runs[-1][2] + 2 * BAND
                        ref, have = np.full((len(rows), need), 4, np.int8), _CODE[_matrix(window, rows, k[2])]
                        ref[:, k[3] : k[3] + k[2]] = have[:, : max(0, need - k[3])]
                        for r, q, n in runs:
                            pieces.setdefault(n, []).append((len(groups) - 1, q, codes[:, q : q + n], quals[:, q : q + n], ref[:, r : r + n + 2 * BAND]))
                for n, some in pieces.items():
                    low = _capped(*(np.concatenate([x[k] for x in some]) for k in (2, 3, 4)))
                    for (g, q, x, _, _), rows in zip(some, np.split(low, np.cumsum([len(x[2]) for x in some])[:-1]), strict=True):
                        groups[g][3][:, q : q + n] = rows
                flat = [(np.repeat(rows, n), (pos[rows, None] + r + np.arange(n)).ravel(), codes[:, q : q + n].ravel(), quals[:, q : q + n].ravel()) for rows, runs, codes, quals in groups for r, q, n in runs]
                if not flat:
                    continue
                read, place, base, quality = (np.concatenate(x) for x in zip(*flat, strict=True))
                keep = (base < 4) & (quality >= least_quality)
                read, place, base, quality = read[keep], place[keep], base[keep].astype(np.int64), quality[keep]
                code = np.clip(np.minimum(quality, mapq[read]), LEAST_Q, MOST_Q) << 3 | strand[read] | base
                # reads of a batch that show the same are counted here, and a position and sample is one row
                names = b.column("sample").dictionary_encode(), b.column("chrom").dictionary_encode()
                sample, chrom = (x.indices.fill_null(len(x.dictionary)).to_numpy().astype(np.int64)[read] for x in names)
                keys, n = _counted([place, chrom, sample, code])
                if not len(n):
                    continue
                new = np.flatnonzero(np.r_[True, (np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0) | (np.diff(keys[2]) != 0)])
                codes = pa.ListArray.from_arrays(pa.array(np.r_[new, len(n)], pa.int32()), pa.array(n.astype(np.int64) << 9 | keys[3], pa.int64()))
                take = lambda x, i: pa.concat_arrays([x.dictionary, pa.nulls(1, x.dictionary.type)]).take(pa.array(i))
                yield pa.RecordBatch.from_arrays([take(names[1], keys[1][new]), pa.array(keys[0][new], pa.int64()), take(names[0], keys[2][new]), codes], names=["chrom", "pos", "sample", "codes"])

    coded = t.select("chrom", "pos", "sample", "cigar", "seq", "qual", "mapq", "reverse", "_from", "window").mapInArrow(run, "chrom string, pos long, sample string, codes array<bigint>")
    return coded.repartition("chrom", "pos").sortWithinPartitions("pos", "chrom", "sample")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows in batches of whole groups (rows alike in ``keys``), with each row's group, from 0."""

    def numbers(b: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            c = b.column(k)
            c = c.dictionary_encode().indices.fill_null(-1) if pa.types.is_string(c.type) else c
            new[1:] |= np.diff(c.to_numpy(zero_copy_only=False)) != 0
        return np.cumsum(new)

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and int(numbers(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), b]))[-1]) == 0:
            held.append(b)
            continue
        whole = pa.concat_batches([*held, b])
        group = numbers(whole)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield whole.slice(0, cut), group[:cut]
        held = [whole.slice(cut)]
    if held:
        whole = pa.concat_batches(held)
        yield whole, numbers(whole)


LIKELIHOODS = "chrom string, pos long, sample string, depth array<long>, quality array<long>, likelihoods array<double>"


def sample_likelihoods(codes: DataFrame) -> DataFrame:
    """:data:`LIKELIHOODS` of each position and sample: reads and summed qualities of A, C, G, T; 25 phred values of base pairs (A, C, G, T, unseen)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, group in _groups(batches, ["pos", "chrom", "sample"]):
            lists, rows = b.column("codes"), int(group[-1]) + 1
            row, code = np.repeat(group, lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            code, n = code & 511, code >> 9
            values = genotype_likelihoods(row, code, n, rows)
            sums = [np.bincount(row * 4 + (code & 3), weights=w, minlength=rows * 4).astype(np.int64) for w in (n, n * np.clip(code >> 3, LEAST_Q, MOST_Q))]
            first = pa.array(np.searchsorted(group, np.arange(rows)))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(first) for c in ("chrom", "pos", "sample")), _fixed(sums[0], 4, pa.int64()), _fixed(sums[1], 4, pa.int64()), _fixed(values.ravel(), 25, pa.float64())], names=["chrom", "pos", "sample", "depth", "quality", "likelihoods"])

    return codes.mapInArrow(run, LIKELIHOODS)


def _fixed(x: np.ndarray, k: int, kind: pa.DataType, mask: np.ndarray | None = None) -> pa.ListArray:
    """Lists of ``k`` values each; those of ``mask`` are null."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, k), pa.int32()), pa.array(x, kind), mask=None if mask is None else pa.array(mask))


SITES = "chrom string, pos long, end long, ref string, alts array<string>, info struct<DP:int,QS:array<double>>, samples array<struct<PL:array<int>,DP:int,AD:array<int>>>"


def likelihood_sites(found: DataFrame, samples: list[str], bases: DataFrame) -> DataFrame:
    """A variant table (chrom, pos, ref, alts, info.DP, info.QS, samples with PL, DP, AD) from :func:`sample_likelihoods`.

    ``bases``: chrom, pos, base of the reference. ALTs are the bases shown, by their summed shares of a sample's quality
    (then by letter), and ``<*>``. Samples and bases meet in one exchange; a batch's sites with as many alleles are made together.
    """
    kinds = {c: kind for c, kind in (x.split(" ") for x in LIKELIHOODS.split(", "))}
    ref = bases.select("chrom", F.col("pos").cast("long").alias("pos"), *[F.lit(None).cast(kind).alias(c) for c, kind in kinds.items() if c not in ("chrom", "pos")], F.upper("base").alias("ref")).where(F.col("ref").isin(*BASES))
    t = found.select(*kinds, F.lit(None).cast("string").alias("ref")).unionByName(ref).where("chrom is not null and pos is not null")
    t = t.repartition("chrom", "pos").sortWithinPartitions("pos", "chrom", "sample")
    names = list(samples)
    schema = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.struct([("DP", pa.int32()), ("QS", pa.list_(pa.float64()))]), pa.list_(pa.struct([("PL", pa.list_(pa.int32())), ("DP", pa.int32()), ("AD", pa.list_(pa.int32()))]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, group in _groups(batches, ["pos", "chrom"]):
            n_groups = int(group[-1]) + 1
            shows = np.flatnonzero(b.column("depth").is_valid().to_numpy(zero_copy_only=False))
            mine = group[shows]
            depth, quality, likelihoods = (b.column(c).flatten().to_numpy().reshape(len(shows), k) for c, k in (("depth", 4), ("quality", 4), ("likelihoods", 25)))
            part = quality / np.maximum(quality.sum(1, keepdims=True), 1)
            share = np.stack([np.bincount(mine, weights=part[:, k], minlength=n_groups) for k in range(4)], 1)
            total = np.bincount(mine, weights=depth.sum(1), minlength=n_groups).astype(np.int64)
            sample = b.column("sample").take(pa.array(shows)).to_numpy(zero_copy_only=False)
            place = np.full((len(names), n_groups), -1)
            for i, name in enumerate(names):
                at = np.flatnonzero(sample == name)[::-1]  # the first one stays
                place[i, mine[at]] = at
            # a row of the reference is a site if samples show something there
            site = np.flatnonzero(b.column("ref").is_valid().to_numpy(zero_copy_only=False))
            site = site[np.isin(group[site], mine)]
            if not len(site):
                continue
            g = group[site]
            r = _CODE[np.array([ord(x) for x in b.column("ref").take(pa.array(site)).to_pylist()])].astype(np.int64)
            by = np.argsort(-share[g], axis=1, kind="stable")
            taken = (np.take_along_axis(share[g], by, 1) > 0) & (by != r[:, None])
            n_others = taken.sum(1)
            others = np.take_along_axis(by, np.argsort(~taken, axis=1, kind="stable"), 1)
            for k in np.unique(n_others).tolist():
                some = np.flatnonzero(n_others == k)
                order = np.concatenate([r[some, None], others[some, :k], np.full((len(some), 1), 4)], 1)
                at, width = pa.array(site[some]), k + 2
                pairs = np.stack([order[:, x] * 5 + order[:, y] for y in range(width) for x in range(y + 1)], 1)
                who = place[:, g[some]].T.ravel()  # site by sample
                none, who = who < 0, np.maximum(who, 0)
                values = np.take_along_axis(likelihoods[who], np.repeat(pairs, len(names), 0), 1)
                pl = np.minimum(np.floor(values - values.min(1, keepdims=True) + 0.499), 255).astype(np.int32) if len(names) else np.zeros((0, pairs.shape[1]), np.int32)
                ad = np.take_along_axis(np.concatenate([depth[who], np.zeros((len(who), 1), np.int64)], 1), np.repeat(order, len(names), 0), 1)
                one = pa.StructArray.from_arrays([_fixed(pl.ravel(), pairs.shape[1], pa.int32(), none), pa.array(np.where(none, 0, depth[who].sum(1)), pa.int32()), _fixed(ad.astype(np.int32).ravel(), width, pa.int32(), none)], fields=list(schema[6].value_type))
                qs = np.take_along_axis(np.concatenate([share[g[some]], np.zeros((len(some), 1))], 1), order, 1)
                info = pa.StructArray.from_arrays([pa.array(total[g[some]], pa.int32()), _fixed(qs.ravel(), width, pa.float64())], fields=list(schema[5]))
                alts = _fixed(np.array([*BASES, "<*>"], object)[order[:, 1:]].ravel(), k + 1, pa.string())
                cuts = pa.array(np.arange(len(some) + 1) * len(names), pa.int32())
                columns = [b.column("chrom").take(at), b.column("pos").take(at), b.column("pos").take(at), b.column("ref").take(at), alts, info, pa.ListArray.from_arrays(cuts, one)]
                yield pa.RecordBatch.from_arrays([c.cast(kind) for c, kind in zip(columns, schema, strict=True)], names=["chrom", "pos", "end", "ref", "alts", "info", "samples"])

    return t.mapInArrow(run, SITES)
