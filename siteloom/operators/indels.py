"""Indels from aligned reads, by edit distance to the haplotypes of a site.

1. Insertions and deletions of the reads' alignments, counted inside the task and then by position, give candidate sites.
2. Reads meet the sites that they span by a join of points and intervals in small bins. A site's haplotypes are its stretch of reference with each of
   its indels. All (read, haplotype) pairs of a batch go through a bit-vector edit distance together: a column of the
   distance matrix is a few 64-bit words a pair, so numpy takes a base of all pairs at once. The read may begin and end
   anywhere in the haplotype.
3. A read is for its nearest haplotype, by as much as the second one is further away, and never by more than an indel of
   that length is worth in a homopolymer run. What reads say is counted by (site, sample, strand, type, quality), so a
   site of any depth is a bounded row, and goes through the error model of :mod:`siteloom.operators.likelihoods`.

Defined results: reads without bases, alignment or position and those with skipped stretches take no part; a read equally near
to two haplotypes has quality 0 and counts for depth only; inserted sequences with other letters than A, C, G and T aren't candidates;
sites whose reference isn't in ``chunks`` are left out; repeated reads count each time. Of a site's indels all are
compared; likelihoods are of the three with most support.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.operators.likelihoods import CIGAR, genotype_likelihoods
from siteloom.operators.ranges import point_join
from siteloom.sources.shared import stored

#: Bases of reference to either side of a site that reads are compared with.
WINDOW = 60
#: What an edit is worth, and an indel: opening, each further base, and in a run of one base (by length / run).
EDIT_Q, OPEN_Q, EXTEND_Q, RUN_Q = 30, 40, 20, 500
#: Reads that a sample must show with an indel at a site, and their share of its reads there.
LEAST_READS, LEAST_SHARE = 2, 0.05
_LETTER = np.full(256, 4, np.int64)
for _i, _b in enumerate("ACGT"):
    _LETTER[ord(_b)] = _LETTER[ord(_b.lower())] = _i


def edit_distances(patterns: list[bytes], texts: list[bytes]) -> np.ndarray:
    """The least edit distance of each pattern to any piece of its text, all pairs side by side.

    Column after column of the distance matrix as vertical differences in 64-bit words (pattern length / 64 of them);
    other letters than A, C, G and T equal nothing.
    """
    n = len(patterns)
    size = np.array([len(p) for p in patterns], np.int64)
    best = size.copy()  # the empty piece
    longest = max((len(t) for t in texts), default=0)
    words = max(1, -(-int(size.max(initial=0)) // 64))
    if not n or not longest:
        return best
    equal = np.zeros((5, n, words), np.uint64)
    for i, p in enumerate(patterns):
        codes = _LETTER[np.frombuffer(p, np.uint8)]
        for c in range(4):
            bits = np.zeros(words * 64, np.uint8)
            bits[: len(p)] = codes == c
            equal[c, i] = np.packbits(bits, bitorder="little").view(np.uint64)
    text = np.full((n, longest), 4, np.int64)
    length = np.array([len(t) for t in texts])
    for i, t in enumerate(texts):
        text[i, : len(t)] = _LETTER[np.frombuffer(t, np.uint8)]
    plus, minus = np.full((n, words), ~np.uint64(0)), np.zeros((n, words), np.uint64)
    end, bit = np.maximum(size - 1, 0) // 64, np.maximum(size - 1, 0).astype(np.uint64) % np.uint64(64)
    one, top, rows = np.uint64(1), np.uint64(63), np.arange(n)
    score = size.copy()
    for j in range(longest):
        carry = np.zeros(n, np.int64)  # a piece may begin at any place of the text
        for w in range(words):
            eq, p, m = equal[text[:, j], rows, w], plus[:, w], minus[:, w]
            low = (carry < 0).astype(np.uint64)
            xv = eq | m
            eq = eq | low
            xh = (((eq & p) + p) ^ p) | eq
            up, down = m | ~(xh | p), p & xh
            mine = end == w
            score += np.where(mine, ((up >> bit) & one).astype(np.int64) - ((down >> bit) & one).astype(np.int64), 0)
            out = (up >> top).astype(np.int64) - (down >> top).astype(np.int64)
            up, down = up << one | (carry > 0).astype(np.uint64), down << one | low
            plus[:, w], minus[:, w] = down | ~(xv | up), up & xv
            carry = out
        best = np.where((j < length) & (score < best), score, best)
    return np.where(size > 0, best, 0)


def _walk(cigar: str) -> tuple[int, list[tuple[int, int, int, str]]] | None:
    """Bases of reference that an alignment spans, and its steps (place in the reference, place in the read, length, kind)."""
    steps, r, q = [], 0, 0
    for n, op in CIGAR.findall(cigar):
        n = int(n)
        if op == "N":
            return None
        if op in "M=X":
            steps.append((r, q, n, "M"))
            r, q = r + n, q + n
        elif op == "D":
            steps.append((r, q, n, "D"))
            r += n
        elif op in "IS":
            steps.append((r, q, n, op))
            q += n
    return r, steps


def spans(reads: DataFrame) -> DataFrame:
    """The reads that can take part, with ``end`` and ``indels``, an array of (pos, length, seq): after which base, and what is inserted."""
    t = reads.select("chrom", F.col("pos").cast("long").alias("pos"), F.col("sample").cast("string").alias("sample"), "cigar", "seq", F.coalesce("reverse", F.lit(False)).alias("reverse"))
    t = t.where("chrom is not null and pos is not null and cigar is not null and length(seq) > 0")
    schema = "chrom string, pos long, end long, sample string, cigar string, seq string, reverse boolean, indels array<struct<pos:bigint,length:int,seq:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int64()), ("length", pa.int32()), ("seq", pa.string())]))
        for b in batches:
            # alignments of a batch are often alike: each is walked once
            cigar = b.column("cigar").dictionary_encode()
            known = [(w, [x for x in w[1] if x[0] and x[3] in "DI"], sum(n for _, _, n, k in w[1] if k in "MIS")) if (w := _walk(c)) and w[0] else None for c in cigar.dictionary.to_pylist()]
            which = cigar.indices.to_numpy()
            size = np.array([-1 if x is None else x[2] for x in known], np.int64)
            keep = np.flatnonzero(pc.utf8_length(b.column("seq")).to_numpy() == size[which]) if len(known) else np.zeros(0, np.int64)
            c, which = b.take(pa.array(keep, pa.int64())), which[keep]
            ends = c.column("pos").to_numpy() + np.array([0 if x is None else x[0][0] for x in known], np.int64)[which] - 1
            found = [None if x is None or x[1] else [] for x in known]
            found = [found[k] for k in which.tolist()]
            shown = [i for i, x in enumerate(found) if x is None]
            some = c.take(pa.array(shown, pa.int64()))
            for i, pos, seq in zip(shown, some.column("pos").to_pylist(), some.column("seq").to_pylist(), strict=True):
                found[i] = [{"pos": pos + r - 1, "length": -n if k == "D" else n, "seq": "" if k == "D" else seq[q : q + n].upper()} for r, q, n, k in known[which[i]][1] if k == "D" or not seq[q : q + n].upper().strip("ACGT")]
            yield pa.RecordBatch.from_arrays([c.column("chrom"), c.column("pos"), pa.array(ends, pa.int64()), *(c.column(x) for x in ("sample", "cigar", "seq", "reverse")), pa.array(found, kind)], names=["chrom", "pos", "end", "sample", "cigar", "seq", "reverse", "indels"])

    return t.mapInArrow(run, schema)


def candidates(spanned: DataFrame, least_reads: int = LEAST_READS, least_share: float = LEAST_SHARE) -> DataFrame:
    """chrom, at, idv, imf, depth and ``types`` (length, seq, n): positions before an indel that some sample shows often enough.

    ``idv`` and ``imf``: the most reads of a sample with an indel there, and their largest share of a sample's reads.
    """
    shown = spanned.select("chrom", "sample", F.explode("indels").alias("i")).groupBy("chrom", F.col("i.pos").alias("at"), "sample", F.col("i.length").alias("length"), F.col("i.seq").alias("seq")).agg(F.count(F.lit(1)).alias("n"))
    by_sample = shown.groupBy("chrom", "at", "sample").agg(F.sum("n").alias("with"), F.collect_list(F.struct("length", "seq", "n")).alias("types"))
    often = by_sample.groupBy("chrom", "at").agg(F.max("with").alias("most")).where(F.col("most") >= least_reads).select("chrom", "at")
    often = stored(often, "indel-places")
    over = point_join(spanned.select("chrom", "pos", "end", "sample"), often).groupBy("chrom", F.col("r_at").alias("at"), "sample").agg(F.count(F.lit(1)).alias("depth"))
    met = over.join(by_sample.withColumnRenamed("sample", "_s"), (over["chrom"] == by_sample["chrom"]) & (over["at"] == by_sample["at"]) & over["sample"].eqNullSafe(F.col("_s")), "left").select(over["chrom"], over["at"], "depth", F.coalesce("with", F.lit(0)).alias("with"), "types")
    g = met.groupBy("chrom", "at").agg(F.sum("depth").alias("depth"), F.max("with").alias("idv"), F.max(F.col("with") / F.col("depth")).alias("imf"), F.max((F.col("with") >= least_reads) & (F.col("with") / F.col("depth") >= least_share)).alias("ok"), F.flatten(F.collect_list("types")).alias("types"))
    same = lambda x: F.struct(x["length"].alias("length"), x["seq"].alias("seq"))
    distinct = F.array_sort(F.array_distinct(F.transform("types", same)))
    sums = F.transform(distinct, lambda d: F.struct(d["length"].alias("length"), d["seq"].alias("seq"), F.aggregate(F.filter("types", lambda x: (x["length"] == d["length"]) & (x["seq"] == d["seq"])), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n")))
    return g.where("ok").select("chrom", "at", "idv", F.col("imf").cast("double").alias("imf"), "depth", sums.alias("types"))


def worth(length: int, run: int) -> int:
    """The most that a read can say for an indel of a length beside a run of one base."""
    plain = OPEN_Q + EXTEND_Q * (abs(length) - 1)
    return min(plain, int(RUN_Q * abs(length) / run + 0.499)) if run >= 3 else plain


def run_length(window: str, at: int) -> int:
    """How long the run of one base is that begins after ``at``."""
    i = at + 1
    while i < len(window) and window[i] == window[at + 1]:
        i += 1
    return i - at - 1


def _segment(pos: int, steps: list[tuple[int, int, int, str]], seq: str, lo: int, hi: int) -> str:
    """The read's bases between two places of the reference, with what is inserted there; clipped ends aren't among them."""
    out = []
    for r, q, n, k in steps:
        if k == "M":
            a, b = max(lo, pos + r), min(hi, pos + r + n - 1)
            if a <= b:
                out.append(seq[q + a - pos - r : q + b - pos - r + 1])
        elif k == "I" and lo < pos + r <= hi:
            out.append(seq[q : q + n])
    return "".join(out).upper()


SAID = "chrom string, at long, sample string, strand int, type int, q int, n long"


def realigned(spanned: DataFrame, sites: DataFrame) -> DataFrame:
    """:data:`SAID`: for which of the site's types (0: none of its indels) so many reads are, how surely.

    ``sites``: of :func:`candidates`, with ``window``, the reference from ``left`` (a position) on.
    """
    points = sites.select("chrom", "at", "window", "left", F.transform("types", lambda x: F.struct(x["length"].alias("length"), x["seq"].alias("seq"))).alias("types"))
    pairs = point_join(spanned.drop("indels"), points).select("chrom", "pos", "sample", "cigar", "seq", "reverse", F.col("r_at").alias("at"), F.col("r_window").alias("window"), F.col("r_left").alias("left"), F.col("r_types").alias("types"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 10_000):
                part = whole.slice(begin, 10_000)
                chroms, places, samples, cigars, seqs, reverses, ats = (part.column(c).to_pylist() for c in ("chrom", "pos", "sample", "cigar", "seq", "reverse", "at"))
                # what holds for a site, and for an alignment, is made once a batch, and so is the distance of equal pairs
                first: dict[tuple, int] = {}
                for i, key in enumerate(zip(chroms, ats, strict=True)):
                    first.setdefault(key, i)
                sites_ = {}
                for key, x in zip(first, part.select(["at", "window", "left", "types"]).take(pa.array(first.values(), pa.int64())).to_pylist(), strict=True):
                    at, window, lengths = x["at"] - x["left"], x["window"].upper(), [t["length"] for t in x["types"]]
                    run_ = run_length(window, at)
                    haplotypes = [window, *(window[: at + 1] + t["seq"] + window[at + 1 + max(0, -t["length"]) :] for t in x["types"])]
                    sites_[key] = max(0, *(-n for n in lengths)), [h.encode() for h in haplotypes], [worth(n, run_) for n in lengths]
                walks = {c: _walk(c)[1] for c in set(cigars)}
                slots: dict[tuple[bytes, bytes], int] = {}
                of = []
                for chrom, pos, cigar, seq, at in zip(chroms, places, cigars, seqs, ats, strict=True):
                    reach, haplotypes, _ = sites_[chrom, at]
                    shown = _segment(pos, walks[cigar], seq, at - WINDOW // 2, at + WINDOW // 2 + reach).encode()
                    of.append([slots.setdefault((shown, h), len(slots)) for h in haplotypes])
                unique, distance, told = list(slots), [], Counter()
                for k in range(0, len(unique), 2500):
                    distance += edit_distances(*(list(x) for x in zip(*unique[k : k + 2500], strict=True))).tolist()
                for chrom, at, sample, reverse, mine in zip(chroms, ats, samples, reverses, of, strict=True):
                    d = [distance[k] for k in mine]
                    best, second = sorted(range(len(d)), key=d.__getitem__)[:2]
                    # against the reference if an indel is nearest, else against the nearest indel
                    rival = second if best == 0 else 0
                    q = min((d[rival] - d[best]) * EDIT_Q, sites_[chrom, at][2][(best or second) - 1], 63)
                    told[chrom, at, sample, int(reverse), best, q if d[second] > d[best] else 0] += 1
                columns = list(zip(*((*key, n) for key, n in told.items()), strict=True)) or [[]] * 7
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["chrom", "at", "sample", "strand", "type", "q", "n"])

    return pairs.mapInArrow(run, SAID).groupBy("chrom", "at", "sample", "strand", "type", "q").agg(F.sum("n").alias("n"))


def with_windows(sites: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """``sites`` with ``left`` and ``window``, by an equi-join on (contig, chunk)."""
    reach = F.greatest(F.lit(0), F.array_max(F.transform("types", lambda t: -t["length"])))
    t = sites.withColumn("left", F.greatest(F.col("at") - WINDOW, F.lit(1).cast("long"))).withColumn("_to", F.col("at") + WINDOW + reach)
    cut = t.select("chrom", "at", "left", "_to", F.explode(F.sequence(F.floor((F.col("left") - 1) / width), F.floor((F.col("_to") - 1) / width))).alias("chunk")).join(chunks, ["chrom", "chunk"])
    w = cut.groupBy("chrom", "at", "left", "_to").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias("_s"), (F.min("chunk") * width).alias("_at"))
    w = w.select("chrom", "at", F.substr("_s", (F.col("left") - F.col("_at")).cast("int"), (F.col("_to") - F.col("left") + 1).cast("int")).alias("window"))
    return t.drop("_to").join(w, ["chrom", "at"]).where(F.length("window") > F.col("at") - F.col("left") + reach)


def indel_sites(reads: DataFrame, chunks: DataFrame, width: int, samples: list[str], least_reads: int = LEAST_READS, least_share: float = LEAST_SHARE) -> DataFrame:
    """A variant table (chrom, pos, end, ref, alts, info.IDV, info.IMF, info.DP, samples with PL and AD) of the indels that reads show."""
    spanned = stored(spans(reads), "spanned")
    sites = stored(with_windows(candidates(spanned, least_reads, least_share), chunks, width), "indel-sites")
    said = realigned(spanned, sites)
    g = said.groupBy("chrom", "at").agg(F.collect_list(F.struct("sample", "strand", "type", "q", "n")).alias("said")).join(sites, ["chrom", "at"])
    names = list(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample_kind = pa.list_(pa.struct([("PL", pa.list_(pa.int32())), ("AD", pa.list_(pa.int32()))]))
        for b in batches:
            rows, row, code, count, depth = b.to_pylist(), [], [], [], {}
            kept = []
            for i, x in enumerate(rows):
                support = Counter()
                for s in x["said"]:
                    support[s["type"]] += s["q"] * s["n"]
                order = [0, *sorted((t for t in support if t and support[t] > 0), key=lambda t: (-support[t], t))[:3]]
                kept.append(order)
                for s in x["said"]:
                    if s["type"] in order and s["sample"] in names and s["q"] > 0:
                        at = i * len(names) + names.index(s["sample"])
                        row.append(at)
                        code.append(s["q"] << 3 | s["strand"] << 2 | order.index(s["type"]))
                        count.append(s["n"])
                        depth[at, order.index(s["type"])] = depth.get((at, order.index(s["type"])), 0) + s["n"]
            values = genotype_likelihoods(*(np.array(c, np.int64) for c in (row, code, count)), len(rows) * len(names))
            out = []
            for i, (x, order) in enumerate(zip(rows, kept, strict=True)):
                if len(order) < 2:
                    continue
                types = [x["types"][t - 1] for t in order[1:]]
                at, gone = x["at"] - x["left"], max(0, *(-t["length"] for t in types))
                window = x["window"].upper()
                ref = window[at : at + 1 + gone]
                alts = [ref[0] + t["seq"] + ref[1 + max(0, -t["length"]) :] for t in types]
                pairs = [(j, k) for k in range(len(order)) for j in range(k + 1)]
                of = []
                for s in range(len(names)):
                    v = values[i * len(names) + s]
                    pl = [v[p] for p in pairs]
                    some = any((i * len(names) + s, k) in depth for k in range(len(order)))
                    of.append({"PL": [min(255, int(y - min(pl) + 0.499)) for y in pl] if some else None, "AD": [depth.get((i * len(names) + s, k), 0) for k in range(len(order))]})
                out.append((x["chrom"], x["at"], x["at"] + len(ref) - 1, ref, alts, {"IDV": x["idv"], "IMF": x["imf"], "DP": x["depth"]}, of))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.struct([("IDV", pa.int64()), ("IMF", pa.float64()), ("DP", pa.int64())]), sample_kind]
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["chrom", "pos", "end", "ref", "alts", "info", "samples"])

    return g.mapInArrow(run, "chrom string, pos long, end long, ref string, alts array<string>, info struct<IDV:bigint,IMF:double,DP:bigint>, samples array<struct<PL:array<int>,AD:array<int>>>")
