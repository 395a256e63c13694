"""Operators that put several steps in the one order that gives the right result, and smaller analyses of sites."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import alleles as al
from siteloom.functions import genotype as g
from siteloom.operators import select


def recounted(df: DataFrame) -> DataFrame:
    """INFO/AC and INFO/AN (added where there are none) of the samples that the table has now."""
    ac = F.coalesce(g.allele_counts(F.col("samples"), F.col("alts")), F.transform("alts", lambda _: F.lit(0)))
    an = g.allele_number(F.col("samples"))
    return df.withColumn("info", F.col("info").withField("AC", ac).withField("AN", an)) if "info" in df.columns else df.withColumn("info", F.struct(ac.alias("AC"), an.alias("AN")))


def view(
    df: DataFrame, least_alleles: int | None = None, most_alleles: int | None = None, known: bool | None = None, types: list[str] | None = None, not_types: list[str] | None = None, where: str | None = None, exclude: str | None = None,
    samples: list[int] | None = None, recount: bool = True, trim_alts: bool = False, least_ac: int | None = None, most_ac: int | None = None, low_af: float | None = None, high_af: float | None = None, uncalled: bool | None = None, phased: bool | None = None,
    private: bool | None = None, genotype: str | None = None, drop_genotypes: bool = False, numbers: dict[str, str] | None = None,
) -> DataFrame:
    """One pass in a fixed order.

    Tests of the site as it was read come first (numbers of alleles, ID, types, expressions), with the counts of all
    samples. Then samples are chosen, ALTs that are left without a carrier are trimmed, AC and AN are counted anew; then
    come the tests of what is left (genotypes, counts, frequencies, calls, phase); genotypes are dropped last. ``private``
    compares the chosen samples with all of them.
    """
    out = select.allele_bounds(df, least_alleles, most_alleles)
    if known is not None:
        out = select.known(out, novel=not known)
    if types:
        out = select.of_types(out, types)
    if not_types:
        out = select.of_types(out, not_types, exclude=True)
    if where:
        out = select.where(out, where)
    if exclude:
        out = select.where(out, exclude, exclude=True)
    if samples is not None:
        if private is not None:
            out = select.private(out, samples, exclude=not private)
        out = select.subset_samples(out, samples)
    if trim_alts:
        out = select.trim_alts(out, numbers=numbers)
    if samples is not None and recount:
        out = recounted(out)
    if genotype:
        out = select.genotype(out, genotype)
    if least_ac is not None or most_ac is not None:
        out = select.counts(out, least=least_ac, most=most_ac)
    if low_af is not None or high_af is not None:
        out = select.counts(out, frequency=True, low=low_af, high=high_af)
    if uncalled is not None:
        out = select.uncalled(out, exclude=not uncalled)
    if phased is not None:
        out = select.phased(out, exclude=not phased)
    return select.drop_genotypes(out) if drop_genotypes else out


def head(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` sites in the order of the table; each task keeps ``n`` at most."""
    return df.orderBy("contig_idx", "pos", "ref", F.array_join("alts", ",")).limit(n)


def random_sites(df: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """About ``share`` of the sites, the same ones in every run: a hash of the site decides."""
    h = F.pmod(F.xxhash64(F.lit(seed), "chrom", "pos", "ref", F.array_join("alts", ",")), F.lit(1_000_000))
    return df.where(h < int(share * 1_000_000))


def with_old_record(df: DataFrame, tag: str = "OLD_REC") -> DataFrame:
    """A column with the site as it is now (``chrom|pos|ref|alts``), to be taken before it is normalised."""
    return df.withColumn(tag, F.concat_ws("|", "chrom", F.col("pos").cast("string"), "ref", F.array_join("alts", ",")))


def counted_cube(df: DataFrame, keys: dict[str, Column], rollup: bool = False) -> DataFrame:
    """Numbers of sites by all subsets of the keys (or their prefixes); null stands for all. ``level`` tells them apart."""
    t = df.select(*[c.alias(k) for k, c in keys.items()])
    grouped = t.rollup(*keys) if rollup else t.cube(*keys)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


# --- pairing by some common allele
def minimal_allele(ref: Column, alt: Column) -> Column:
    """``REF>ALT`` without the bases that both end with, so that the same change reads the same in REFs of any length."""
    most = F.least(F.length(ref), F.length(alt)) - 1
    at = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: (k > most) | (F.substr(ref, F.length(ref) - k + 1, F.lit(1)) != F.substr(alt, F.length(alt) - k + 1, F.lit(1))))
    common = F.when(alt.rlike("^[A-Za-z]+$"), F.when(F.size(at) > 0, F.get(at, F.lit(0)) - 1).otherwise(most)).otherwise(F.lit(0))
    common = F.greatest(common, F.lit(0))
    return F.upper(F.concat(F.substr(ref, F.lit(1), F.length(ref) - common), F.lit(">"), F.substr(alt, F.lit(1), F.length(alt) - common)))


def share_some_allele(a: DataFrame, b: DataFrame, exclude: bool = False) -> DataFrame:
    """Sites of ``a`` of which some ALT is one of a site of ``b`` at the same position (with ``exclude``: none is)."""
    keys = lambda d: d.select("chrom", "pos", F.explode(F.transform("alts", lambda x: minimal_allele(F.col("ref"), x))).alias("_allele"))
    site = ["chrom", "pos", "ref", "alts"]
    hit = a.select(*site, F.explode(F.transform("alts", lambda x: minimal_allele(F.col("ref"), x))).alias("_allele")).join(keys(b).distinct(), ["chrom", "pos", "_allele"], "left_semi").select(*site).distinct()
    return a.join(hit, site, "left_anti" if exclude else "left_semi")


# --- strand and reference
_FLIP = ("ACGTacgt", "TGCAtgca")


def fix_reference(df: DataFrame, bases: DataFrame, drop: bool = False) -> DataFrame:
    """SNPs of two alleles brought to the reference (chrom, pos, base): ``fixed`` is ok, swap, flip, flip_swap, ambiguous or none.

    A pair of complementary bases (A/T, C/G) doesn't tell the strand: it stays unless REF is already right. Swapped
    sites have their genotypes' alleles exchanged. ``drop``: what can't be brought there goes.
    """
    ref, alt = F.upper("ref"), F.upper(F.get("alts", F.lit(0)))
    fref, falt = F.translate(ref, *_FLIP), F.translate(alt, *_FLIP)
    snp = (F.size("alts") == 1) & ref.rlike("^[ACGT]$") & alt.rlike("^[ACGT]$")
    base = F.upper("base")
    j = df.join(bases.select("chrom", "pos", "base"), ["chrom", "pos"], "left")
    fixed = F.when(~snp | base.isNull(), "none").when(ref == base, "ok").when(fref == alt, "ambiguous").when(alt == base, "swap").when(fref == base, "flip").when(falt == base, "flip_swap").otherwise("none")
    j = j.withColumn("fixed", fixed)
    swaps = F.col("fixed").isin("swap", "flip_swap")
    new_ref = F.when(F.col("fixed") == "swap", alt).when(F.col("fixed") == "flip", fref).when(F.col("fixed") == "flip_swap", falt).otherwise(F.col("ref"))
    new_alts = F.when(F.col("fixed") == "swap", F.array(ref)).when(F.col("fixed") == "flip", F.array(falt)).when(F.col("fixed") == "flip_swap", F.array(fref)).otherwise(F.col("alts"))
    turn = lambda s: s.withField("GT", F.struct(F.transform(s["GT"]["alleles"], lambda x: F.when(x.isNotNull(), 1 - x)).alias("alleles"), s["GT"]["phased"].alias("phased")))
    out = j.withColumns({"ref": new_ref, "alts": new_alts, "samples": F.when(swaps, F.transform("samples", turn)).otherwise(F.col("samples"))}).drop("base")
    return out.where(F.col("fixed").isin("ok", "swap", "flip", "flip_swap")) if drop else out


# --- per-sample indels, rank tests, frequencies by expectation
def per_sample_indels(df: DataFrame) -> DataFrame:
    """Per sample: heterozygous and homozygous carriers of insertions and of deletions (by the first ALT carried)."""
    e = df.select("ref", "alts", F.posexplode("samples").alias("sample", "s")).where(~g.is_missing(F.col("s.GT")) & g.has_alt(F.col("s.GT")))
    first = F.get(F.filter(F.col("s.GT.alleles"), lambda a: a > 0), F.lit(0))
    e = e.withColumn("change", F.get(al.indel_length(F.col("ref"), F.col("alts")), first - 1)).where("change <> 0")
    het = g.is_het(F.col("s.GT"))
    n = lambda c: F.count_if(c)
    return e.groupBy("sample").agg(n(het & (F.col("change") > 0)).alias("n_ins_het"), n(~het & (F.col("change") > 0)).alias("n_ins_hom"), n(het & (F.col("change") < 0)).alias("n_del_het"), n(~het & (F.col("change") < 0)).alias("n_del_hom"))


def rank_z(a: Column, b: Column) -> Column:
    """The z score of the Mann-Whitney test of two histograms over the same places (arrays of counts), corrected for ties.

    Null if either is empty, 0 without variance. Negative if ``a`` lies to the right. Each column stands once in the result, so
    that Spark, which writes columns out where they are used, computes it once.
    """
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("a"), y.cast("double").alias("b")))
    # u: pairs with a before b count one, ties a half
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("na", "nb", "u", "t")])

    def step(acc: Column, p: Column) -> Column:
        u = acc["u"] + p["b"] * (acc["na"] + p["a"] / 2)
        t = acc["t"] + F.pow(p["a"] + p["b"], F.lit(3.0)) - (p["a"] + p["b"])
        return F.struct((acc["na"] + p["a"]).alias("na"), (acc["nb"] + p["b"]).alias("nb"), u.alias("u"), t.alias("t"))

    def score(acc: Column) -> Column:
        na, nb, n = acc["na"], acc["nb"], acc["na"] + acc["nb"]
        var = na * nb / 12 * (n + 1 - F.try_divide(acc["t"], n * (n - 1)))
        return F.when((na > 0) & (nb > 0), F.when(var > 0, (acc["u"] - na * nb / 2) / F.sqrt(var)).otherwise(0.0))

    return F.aggregate(pairs, start, step, score)


def rank_z_of(values: Column) -> Column:
    """:func:`rank_z` of an array of (place, which): places of the rows with ``which`` false, and of those with it true.

    Histograms are over the places that occur. Entries without a place or without ``which`` are left out.
    """
    known = F.filter(values, lambda x: x["place"].isNotNull() & x["which"].isNotNull())
    n = lambda v, place, which: F.size(F.filter(v, lambda x: (x["place"] == place) & (x["which"] == F.lit(which))))
    # an array of one element, for a name inside the expression
    places = lambda v: F.array(F.array_sort(F.array_distinct(F.transform(v, lambda x: x["place"]))))
    z = lambda v: F.get(F.transform(places(v), lambda p: rank_z(F.transform(p, lambda k: n(v, k, False)), F.transform(p, lambda k: n(v, k, True)))), F.lit(0))
    return F.get(F.transform(F.array(known), z), F.lit(0))


def em_frequencies(df: DataFrame, likelihoods: str = "PL", tolerance: float = 1e-9) -> DataFrame:
    """chrom, pos, af, n: the ALT frequency that fits diploid genotype likelihoods best, by expectation and maximisation.

    ``likelihoods``: a FORMAT tag of three phred-scaled values; samples without one are left out. Each site goes on until
    its own frequency moves by less than ``tolerance`` (steps shrink, so each one gets there), whatever its neighbours
    in a batch do: those that are done leave it.
    """
    pl = F.filter(F.transform("samples", lambda s: s[likelihoods]), lambda x: x.isNotNull() & (F.size(x) == 3) & F.forall(x, lambda v: v.isNotNull()))
    t = df.select("chrom", "pos", F.transform(F.flatten(pl), lambda v: v.cast("double")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("p")
            sizes = np.diff(column.offsets.to_numpy()) // 3
            like = 10 ** (-column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3) / 10)
            site = np.repeat(np.arange(len(sizes)), sizes)
            f, going = np.full(len(sizes), 0.5), np.flatnonzero(sizes)
            while len(going):
                # the rows of the sites that still move, numbered anew
                mine = np.isin(site, going)
                like, site = like[mine], site[mine]
                at = np.searchsorted(going, site)
                for _ in range(64):
                    now = f[going]
                    prior = np.stack([(1 - now) ** 2, 2 * now * (1 - now), now * now], 1)[at]
                    post = like * prior
                    post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
                    new = np.bincount(at, weights=post[:, 1] + 2 * post[:, 2], minlength=len(going)) / (2 * sizes[going])
                    still = np.abs(new - now) >= tolerance
                    f[going] = np.where(still, new, now)
                    if not still.any():
                        break
                going = going[still]
            yield pa.RecordBatch.from_arrays([b.column("chrom"), b.column("pos"), pa.array(np.where(sizes > 0, f, np.nan)), pa.array(sizes.astype(np.int32))], names=["chrom", "pos", "af", "n"])

    return t.mapInArrow(run, "chrom string, pos long, af double, n int")
