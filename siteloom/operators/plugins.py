"""Named operators: a registry from names to functions DataFrame -> DataFrame, and the smaller analyses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import alleles as al
from siteloom.functions import genotype as g
from siteloom.functions.stats import binom_udf, fisher_udf

PLUGINS: dict[str, Callable[..., DataFrame]] = {}


def plugin(name: str) -> Callable:
    """Registers a function under a name; a second registration of a name is an error."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in PLUGINS:
            raise ValueError(f"{name} is registered already")
        PLUGINS[name] = f
        return f

    return add


def run(name: str, df: DataFrame, *args, **kw) -> DataFrame:
    if name not in PLUGINS:
        raise KeyError(f"no operator {name}; there are {', '.join(sorted(PLUGINS))}")
    return PLUGINS[name](df, *args, **kw)


def _depths(s: Column) -> tuple[Column, Column]:
    """Reads of REF and of all ALTs."""
    ref = F.coalesce(F.get(s["AD"], F.lit(0)), F.lit(0))
    return ref, F.aggregate(s["AD"], F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) - ref


@plugin("ad-bias")
def ad_bias(df: DataFrame, pairs: list[tuple[int, int]], threshold: float = 1e-3) -> DataFrame:
    """Sites and sample pairs whose shares of ALT reads differ: a Fisher test of the depths."""
    p = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    e = df.select("chrom", "pos", "ref", "alts", "samples", F.explode(p).alias("p"))
    (r1, a1), (r2, a2) = _depths(F.get("samples", F.col("p.a"))), _depths(F.get("samples", F.col("p.b")))
    t = e.select("chrom", "pos", "ref", "alts", F.col("p.a").alias("sample_a"), F.col("p.b").alias("sample_b"), r1.alias("ref_a"), a1.alias("alt_a"), r2.alias("ref_b"), a2.alias("alt_b")).where("ref_a + alt_a > 0 and ref_b + alt_b > 0")
    return t.withColumn("p", fisher_udf("ref_a", "alt_a", "ref_b", "alt_b")).where(F.col("p") <= threshold)


@plugin("af-dist")
def frequency_deviation(df: DataFrame, frequency: Column, bins: int = 10) -> DataFrame:
    """Histogram of the difference between an expected ALT frequency and that of the genotypes."""
    an = g.allele_number(F.col("samples"))
    ac = F.size(F.filter(g.called_alleles(F.col("samples")), lambda a: a > 0))
    t = df.where(an > 0).select(F.abs(frequency - F.try_divide(ac.cast("double"), an)).alias("d")).where("d is not null")
    return t.groupBy(F.least(F.floor(F.col("d") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@plugin("guess-ploidy")
def guess_ploidy(df: DataFrame, error: float = 0.01) -> DataFrame:
    """Per sample the summed log-likelihoods of one and of two copies, from genotypes and ALT frequencies."""
    an = g.allele_number(F.col("samples"))
    ac = F.size(F.filter(g.called_alleles(F.col("samples")), lambda a: a > 0))
    f = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.try_divide(ac.cast("double"), an)))
    e = df.where(an > 0).select(f.alias("f"), F.posexplode("samples").alias("sample", "s")).select("f", "sample", F.least(g.dosage(F.col("s.GT")), F.lit(2)).alias("d")).where("d is not null")
    q = 1 - F.col("f")
    like = lambda k: F.when(F.col("d") == k, 1 - error).otherwise(error / 2)
    hap = F.log(like(0) * q + like(2) * F.col("f"))
    dip = F.log(like(0) * q * q + like(1) * 2 * q * F.col("f") + like(2) * F.col("f") * F.col("f"))
    out = e.groupBy("sample").agg(F.sum(hap).alias("log_hap"), F.sum(dip).alias("log_dip"), F.count(F.lit(1)).alias("n_sites"))
    return out.withColumn("ploidy", F.when(F.col("log_hap") > F.col("log_dip"), 1).otherwise(2))


def strand_report(df: DataFrame, bases: DataFrame) -> DataFrame:
    """How alleles agree with reference bases (chrom, pos, base): ok, swapped, flipped, flipped and swapped, none."""
    j = df.join(bases.select("chrom", "pos", F.upper("base").alias("_b")), ["chrom", "pos"]).where((F.length("ref") == 1) & (F.size("alts") == 1))
    flip = lambda c: F.translate(F.upper(c), "ACGT", "TGCA")
    r, a = F.upper("ref"), F.upper(F.get("alts", F.lit(0)))
    state = F.when(r == F.col("_b"), "ok").when(a == F.col("_b"), "swapped").when(flip(r) == F.col("_b"), "flipped").when(flip(a) == F.col("_b"), "flipped_swapped").otherwise("none")
    return j.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.concat(r, a).isin("AT", "TA", "CG", "GC")).alias("n_ambiguous"))


@plugin("parental-origin")
def parental_origin(df: DataFrame, child: int, father: int, mother: int, kind: str = "del") -> DataFrame:
    """Counts of informative sites for either parent, and the binomial p of the difference.

    ``del``: the child shows one parent's allele only. ``dup``: the child is heterozygous and its share of ALT reads
    leans to the parent with the ALT.
    """
    s = lambda k: F.get("samples", F.lit(k))
    c, f, m = s(child)["GT"], s(father)["GT"], s(mother)["GT"]
    hom = lambda x: ~g.is_missing(x) & ~g.is_het(x)
    first = lambda x: F.get(x["alleles"], F.lit(0))
    t = df.where(hom(f) & hom(m) & (first(f) != first(m)))
    if kind == "del":
        t = t.where(hom(c))
        from_f, from_m = first(c) == first(f), first(c) == first(m)
    else:
        ref, alt = _depths(s(child))
        t = t.where(g.is_het(c) & (ref + alt > 0))
        more_alt = alt > ref
        from_f, from_m = (first(f) > 0) == more_alt, (first(m) > 0) == more_alt
    out = t.agg(F.count_if(from_f).alias("n_father"), F.count_if(from_m).alias("n_mother"))
    return out.withColumn("p", binom_udf("n_father", "n_mother"))


@plugin("vrfs")
def site_noise(pile: DataFrame, bins: int = 20) -> DataFrame:
    """A noise profile a site over many samples: histogram of the share of reads that aren't the commonest base.

    ``pile``: chrom, pos, sample, n_a, n_c, n_g, n_t. Partial sums over batches of samples merge by adding.
    """
    total = F.col("n_a") + F.col("n_c") + F.col("n_g") + F.col("n_t")
    share = 1 - F.greatest("n_a", "n_c", "n_g", "n_t") / total
    t = pile.where(total > 0).withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int"))
    return t.groupBy("chrom", "pos").agg(*[F.count_if(F.col("bin") == b).alias(f"b{b}") for b in range(bins)], F.avg(share).alias("mean"), F.coalesce(F.stddev_pop(share), F.lit(0.0)).alias("sd"))


@plugin("counts")
def counts(df: DataFrame) -> DataFrame:
    from siteloom.operators.summaries import simple_counts

    return simple_counts(df)


@plugin("indel-stats")
def indel_stats(df: DataFrame) -> DataFrame:
    """Indels by length change, with the mean share of ALT reads and whether the change is a frameshift."""
    alt = F.get("alts", F.lit(0))
    t = df.where(F.array_contains(al.variant_types(F.col("ref"), F.col("alts")), "indel") & alt.rlike("^[A-Za-z]+$"))
    e = t.select((F.length(alt) - F.length("ref")).alias("change"), F.explode("samples").alias("s")).where(g.has_alt(F.col("s.GT")))
    ref, reads = _depths(F.col("s"))
    return e.groupBy("change").agg(F.count(F.lit(1)).alias("n_genotypes"), F.avg(F.try_divide(reads.cast("double"), ref + reads)).alias("mean_vaf")).withColumn("frameshift", F.col("change") % 3 != 0)


def _register_others() -> None:
    from siteloom.operators import denovo, fill_tags, genotypes, ranges, select, sequence, summaries, views, windows

    for name, f in {
        "fill-tags": fill_tags.filled, "fill-AN-AC": fill_tags.filled, "setGT": genotypes.set_gt, "missing2ref": genotypes.missing_to_ref, "dosage": genotypes.dosages, "fixploidy": genotypes.fix_ploidy, "impute-info": genotypes.impute_info,
        "contrast": genotypes.allele_contrast, "add-variantkey": genotypes.variant_key, "isecGT": genotypes.isec_genotypes, "mendelian2": genotypes.mendelian, "trio-stats": genotypes.trio_stats, "trio-switch-rate": genotypes.switch_rate,
        "GTsubset": select.genotype_subset, "check-sparsity": select.sparse_samples, "GTisec": summaries.genotype_intersections, "smpl-stats": summaries.thresholds, "allele-length": summaries.allele_lengths, "check-ploidy": summaries.ploidy_runs,
        "prune": windows.ld_pruned, "fixref": views.fix_reference, "trio-dnm3": denovo.de_novo, "remove-overlaps": windows.best_non_overlapping, "gvcfz": windows.runs_by, "variant-distance": ranges.nearest, "fill-from-fasta": sequence.fill_from_reference, "frameshifts": sequence.frameshifts, "split-vep": sequence.split_consequences,
    }.items():
        plugin(name)(f)


_register_others()
