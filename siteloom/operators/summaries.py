"""Statistics of call sets, a DataFrame for each section of the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import alleles as al
from siteloom.functions import genotype as g
from siteloom.operators.carried import carried, ranged


def _has(kind: str) -> Column:
    return F.array_contains("_kinds", kind)


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumn("_kinds", al.variant_types(F.col("ref"), F.col("alts")))


def totals(df: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """Records, without ALT, SNPs, MNPs, indels, others, multiallelic; a site may count in several classes."""
    t = _typed(df)
    n_alt = F.size("alts")
    return t.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_if(n_alt <= 0).alias("n_no_alt"), F.count_if(_has("snp")).alias("n_snps"), F.count_if(_has("mnp")).alias("n_mnps"), F.count_if(_has("indel")).alias("n_indels"),
        F.count_if(_has("other") | _has("bnd")).alias("n_others"), F.count_if(n_alt > 1).alias("n_multi"), F.count_if((n_alt > 1) & (F.size("_kinds") == 1) & _has("snp")).alias("n_multi_snps"),
    )


def ts_tv(df: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """Transitions and transversions over all ALTs that are SNPs, and of the first ALT only; the ratio of none is 0."""
    e = df.select("*", F.posexplode("alts").alias("_i", "_alt")).where(al.allele_type(F.col("ref"), F.col("_alt")) == "snp")
    ts = al.is_transition(F.col("ref"), F.col("_alt"))
    out = e.groupBy(*(by or [])).agg(F.count_if(ts).alias("ts"), F.count_if(~ts).alias("tv"), F.count_if(ts & (F.col("_i") == 0)).alias("ts_1st"), F.count_if(~ts & (F.col("_i") == 0)).alias("tv_1st"))
    return out.withColumn("ts_tv", F.coalesce(F.try_divide("ts", "tv"), F.lit(0.0))).withColumn("ts_tv_1st", F.coalesce(F.try_divide("ts_1st", "tv_1st"), F.lit(0.0)))


def substitutions(df: DataFrame) -> DataFrame:
    e = df.select(F.upper("ref").alias("ref"), F.explode("alts").alias("alt")).where(al.allele_type(F.col("ref"), F.col("alt")) == "snp")
    return e.groupBy("ref", F.upper("alt").alias("alt")).agg(F.count(F.lit(1)).alias("n"))


def allele_frequencies(df: DataFrame, bins: int = 10) -> DataFrame:
    """Sites by bin of the first ALT's frequency; bin 0 holds singletons and sites without calls."""
    ac = F.get(g.allele_counts(F.col("samples"), F.col("alts")), F.lit(0))
    an = g.allele_number(F.col("samples"))
    at = F.when(ac.isNull() | (ac == 1), 0).otherwise(1 + F.least(F.floor(F.try_divide(ac.cast("double"), an) * bins), F.lit(bins - 1)))
    t = _typed(df).withColumn("bin", at.cast("int"))
    return t.groupBy("bin").agg(F.count_if(_has("snp")).alias("n_snps"), F.count_if(_has("indel")).alias("n_indels"), F.count(F.lit(1)).alias("n_sites"))


def qualities(df: DataFrame) -> DataFrame:
    t = _typed(df).withColumn("qual10", F.floor(F.col("qual").cast("double") * 10))
    return t.groupBy("qual10").agg(F.count_if(_has("snp")).alias("n_snps"), F.count_if(_has("indel")).alias("n_indels"))


def indel_lengths(df: DataFrame, most: int = 60) -> DataFrame:
    e = df.select("ref", F.explode("alts").alias("alt")).where(al.allele_type(F.col("ref"), F.col("alt")) == "indel").where(~F.col("alt").startswith("<"))
    length = F.greatest(F.lit(-most), F.least(F.lit(most), F.length("alt") - F.length("ref")))
    return e.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("n"))


def binned(df: DataFrame, value: Column, low: float, high: float, bins: int) -> DataFrame:
    """Ts and tv by a user's tag, in equal bins with clamped ends."""
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((value - low) / ((high - low) / bins)).cast("int")))
    return ts_tv(df.withColumn("bin", at), [F.col("bin")])


def depths(df: DataFrame) -> DataFrame:
    """Genotypes by FORMAT/DP."""
    e = df.select(F.explode("samples").alias("s")).where(F.col("s.DP").isNotNull())
    return e.groupBy(F.col("s.DP").alias("dp")).agg(F.count(F.lit(1)).alias("n_genotypes"))


def per_sample(df: DataFrame) -> DataFrame:
    """Counts of each sample: missing, haploid, homozygous and heterozygous, ts, tv, indels, singletons, mean depth."""
    t = _typed(df)
    nonref = F.size(F.filter("samples", lambda s: ~g.is_missing(s["GT"]) & g.has_alt(s["GT"]) & (g.ploidy(s["GT"]) > 1)))
    e = t.withColumn("_nonref", nonref).select("ref", "alts", "_kinds", "_nonref", F.posexplode("samples").alias("sample", "s"))
    gt = F.col("s.GT")
    mis, het, alt = g.is_missing(gt), g.is_het(gt), g.has_alt(gt)
    hap, dip = ~mis & (g.ploidy(gt) == 1), ~mis & (g.ploidy(gt) > 1)
    of = lambda kind: F.exists(F.array_distinct(F.filter(gt["alleles"], lambda a: a > 0)), lambda a: al.allele_type(F.col("ref"), F.get("alts", a - 1)) == kind)
    snp, indel = of("snp"), of("indel")
    only_ref = ~alt
    ts = F.aggregate(F.filter(F.array_distinct(F.filter(gt["alleles"], lambda a: a > 0)), lambda a: al.allele_type(F.col("ref"), F.get("alts", a - 1)) == "snp"), F.lit(0), lambda n, a: n + F.when(al.is_transition(F.col("ref"), F.get("alts", a - 1)), 1).otherwise(0))
    snps = F.size(F.filter(F.array_distinct(F.filter(gt["alleles"], lambda a: a > 0)), lambda a: al.allele_type(F.col("ref"), F.get("alts", a - 1)) == "snp"))
    return e.groupBy("sample").agg(
        F.count_if(mis).alias("n_missing"), F.count_if(hap & only_ref).alias("n_hap_ref"), F.count_if(hap & alt).alias("n_hap_alt"),
        F.count_if(dip & only_ref).alias("n_hom_ref"), F.count_if(dip & ~het & alt & snp).alias("n_hom_alt"), F.count_if(dip & het & snp).alias("n_het"),
        F.coalesce(F.sum(F.when(dip, ts)), F.lit(0)).alias("n_ts"), F.coalesce(F.sum(F.when(dip, snps - ts)), F.lit(0)).alias("n_tv"), F.count_if(dip & indel).alias("n_indels"),
        F.count_if(dip & alt & (F.col("_nonref") == 1)).alias("n_singletons"), F.coalesce(F.avg(F.when(~mis, F.col("s.DP"))), F.lit(0.0)).alias("avg_depth"),
    )


def het_share_by_frequency(df: DataFrame, bins: int = 10) -> DataFrame:
    """Heterozygosity by frequency bin: 25th, 50th and 75th percentile of the share of heterozygotes."""
    called = F.size(F.filter("samples", lambda s: ~g.is_missing(s["GT"])))
    hets = F.size(F.filter("samples", lambda s: g.is_het(s["GT"])))
    ac, an = F.get(g.allele_counts(F.col("samples"), F.col("alts")), F.lit(0)), g.allele_number(F.col("samples"))
    t = df.where(called > 0).select(F.least(F.floor(F.try_divide(ac.cast("double"), an) * bins), F.lit(bins - 1)).cast("int").alias("bin"), (hets / called).alias("share"))
    return t.groupBy("bin").agg(*[F.percentile("share", p).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)], F.count(F.lit(1)).alias("n"))


def vaf_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """Per sample: sites by the share of ALT reads in AD."""
    e = df.select(F.posexplode("samples").alias("sample", "s"))
    total = F.aggregate(F.col("s.AD"), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    alt = total - F.coalesce(F.get("s.AD", F.lit(0)), F.lit(0))
    e = e.where(total > 0).withColumn("bin", F.least(F.floor(alt / total * bins), F.lit(bins - 1)).cast("int"))
    return e.groupBy("sample", "bin").agg(F.count(F.lit(1)).alias("n"))


def concordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per sample: the matrix of dosages in both tables, non-reference discordance, squared dosage correlation."""
    on = ["chrom", "pos", "ref", "alts"]
    j = a.select(*on, F.col("samples").alias("x")).join(b.select(*on, F.col("samples").alias("y")), on)
    e = j.select(F.posexplode(F.arrays_zip("x", "y")).alias("sample", "p")).select("sample", g.dosage(F.col("p.x.GT")).alias("d1"), g.dosage(F.col("p.y.GT")).alias("d2"))
    both = e.where("d1 is not null and d2 is not null")
    at = lambda x, y: F.count_if((F.col("d1") == x) & (F.col("d2") == y))
    out = both.groupBy("sample").agg(
        *[at(x, y).alias(f"m{x}{y}") for x in range(3) for y in range(3)], F.corr("d1", "d2").alias("_r"),
    )
    x = sum((F.col(f"m{i}{j}") for i in range(3) for j in range(3) if i != j), F.lit(0))
    m = F.col("m11") + F.col("m22")
    return out.withColumn("nrd", F.coalesce(F.try_divide(100.0 * x, x + m), F.lit(0.0))).withColumn("r2", F.col("_r") * F.col("_r")).drop("_r")


def site_discordance(a: DataFrame, b: DataFrame) -> DataFrame:
    on = ["chrom", "pos", "ref", "alts"]
    j = a.select(*on, F.col("samples").alias("x")).join(b.select(*on, F.col("samples").alias("y")), on)
    pairs = F.filter(F.zip_with("x", "y", lambda s, t: F.struct(g.dosage(s["GT"]).alias("a"), g.dosage(t["GT"]).alias("b"))), lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    return j.select("chrom", "pos", F.size(pairs).alias("n_compared"), F.size(F.filter(pairs, lambda p: p["a"] != p["b"])).alias("n_discordant"))


def contig_counts(df: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
    """Sites a contig; with ``contigs`` (chrom, length) also of those without any."""
    n = df.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
    return n if contigs is None else contigs.join(n, "chrom", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def allele_lengths(df: DataFrame) -> DataFrame:
    e = df.select(F.length("ref").alias("ref_len"), F.explode("alts").alias("alt")).where(~F.col("alt").startswith("<")).select("ref_len", F.length("alt").alias("alt_len"))
    return e.groupBy("ref_len", "alt_len").agg(F.count(F.lit(1)).alias("n"))


def simple_counts(df: DataFrame) -> DataFrame:
    return totals(df).select(F.col("n_records").alias("n_sites"), "n_snps", "n_indels", "n_mnps", "n_others")


def thresholds(df: DataFrame, tag: Column, values: list[float]) -> DataFrame:
    """Per-sample counts of genotypes at several thresholds of a FORMAT value (a column over ``s``) in one pass."""
    e = df.select(F.posexplode("samples").alias("sample", "s"))
    t = e.select("sample", F.explode(F.array(*[F.lit(v) for v in values])).alias("threshold"), tag.alias("v"), g.is_missing(F.col("s.GT")).alias("mis"), g.is_het(F.col("s.GT")).alias("het"), g.has_alt(F.col("s.GT")).alias("alt"))
    ok = (F.col("v") >= F.col("threshold")) & ~F.col("mis")
    return t.groupBy("sample", "threshold").agg(F.count_if(ok).alias("n_pass"), F.count_if(ok & F.col("het")).alias("n_het"), F.count_if(ok & F.col("alt") & ~F.col("het")).alias("n_hom_alt"))


def genotype_intersections(df: DataFrame) -> DataFrame:
    """Genotypes by the exact set of samples (places, in order) that share them: ``samples``, ``n``. Any number of samples."""
    key = lambda s: F.array_join(F.array_sort(s["GT"]["alleles"]), "/")
    called = F.filter(F.transform("samples", lambda s, i: F.struct(F.when(~g.is_missing(s["GT"]), key(s)).alias("gt"), i.alias("i"))), lambda x: x["gt"].isNotNull())
    kinds = F.array_distinct(F.transform(called, lambda x: x["gt"]))
    # within a site's row: no shuffle but that of the sets' counts
    sets = F.transform(kinds, lambda k: F.transform(F.filter(called, lambda x: x["gt"] == k), lambda x: x["i"]))
    return df.select(F.explode(sets).alias("samples")).groupBy("samples").agg(F.count(F.lit(1)).alias("n"))


def ploidy_runs(df: DataFrame) -> DataFrame:
    """Runs of constant ploidy of each sample and contig."""
    e = df.select("chrom", "pos", F.posexplode("samples").alias("sample", "s")).where(~g.is_missing(F.col("s.GT"))).select("chrom", "pos", "sample", g.ploidy(F.col("s.GT")).alias("ploidy"))
    keys = ["sample", "chrom"]
    r = carried(ranged(e, keys, ["pos"]), keys, ["pos"], before={"_last": F.col("ploidy")})
    r = carried(r, keys, ["pos"], sums={"run": F.coalesce((F.col("_last") != F.col("ploidy")).cast("int"), F.lit(1))})
    return r.groupBy("sample", "chrom", "run").agg(F.min("pos").alias("beg"), F.max("pos").alias("end"), F.first("ploidy").alias("ploidy")).drop("run")


def sample_pairs(df: DataFrame, error: float = 0.0) -> DataFrame:
    """Discordance of all pairs of samples: genotypes as bits (1, 2, 4), a mismatch is an empty intersection.

    Pairs are made inside each site's row, so the shuffle holds pair sums only. ``n_matches`` counts the rest.
    """
    bits = F.transform("samples", lambda s: F.coalesce(F.expr("1") * F.pow(F.lit(2), g.dosage(s["GT"])).cast("int"), F.lit(0)))
    t = df.select(bits.alias("b"))
    n = F.size("b")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(F.lit(0), i - 1), lambda j: F.struct(i.alias("a"), j.alias("b"), F.get("b", i).alias("x"), F.get("b", j).alias("y")))))
    e = t.where(n > 1).select(F.explode(pairs).alias("p")).where("p.x > 0 and p.y > 0")
    match = F.col("p.x").bitwiseAND(F.col("p.y")) > 0
    out = e.groupBy(F.col("p.a").alias("sample_a"), F.col("p.b").alias("sample_b")).agg(F.count(F.lit(1)).alias("n_sites"), F.count_if(match).alias("n_matches"))
    if not error:
        return out.withColumn("discordance", (F.col("n_sites") - F.col("n_matches")).cast("double"))
    # with an error rate: minus log of the likelihood of equal genotypes
    hit, miss = -F.log(F.lit(1 - error)), -F.log(F.lit(error))
    return out.withColumn("discordance", F.col("n_matches") * 2 * hit + (F.col("n_sites") - F.col("n_matches")) * (hit + miss))


def best_matches(pairs: DataFrame, n: int) -> DataFrame:
    """The ``n`` least discordant partners of each sample."""
    both = pairs.unionByName(pairs.withColumnsRenamed({"sample_a": "_x", "sample_b": "sample_a"}).withColumnRenamed("_x", "sample_b"))
    w = Window.partitionBy("sample_a").orderBy(F.col("discordance") / F.col("n_sites"), "sample_b")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
