"""Operators that rewrite genotypes or derive from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.expr import compile_filter
from siteloom.functions import alleles as al
from siteloom.functions import genotype as g


def with_gt(df: DataFrame, f) -> DataFrame:
    return df.withColumn("samples", F.transform("samples", lambda s: s.withField("GT", f(s))))


def _struct(alleles: Column, phased: Column) -> Column:
    return F.struct(alleles.alias("alleles"), phased.alias("phased"))


def set_gt(df: DataFrame, target: str, new: str, expr: str | None = None) -> DataFrame:
    """Genotypes of a kind set anew.

    ``target``: ``./.`` missing, ``./x`` partly missing, ``.`` either, ``a`` all, ``q`` those an expression keeps.
    ``new``: ``.`` missing, ``0`` reference, ``m`` the minor and ``M`` the major allele, ``p`` phased, ``u`` unphased and sorted,
    ``i`` inverted, ``c:GT`` a fixed genotype.
    """
    out = df
    if target == "q":
        out = out.withColumn("_mask", compile_filter(expr, df).sample_mask(F.size("samples")))
    called = g.called_alleles(F.col("samples"))
    n = F.transform(F.sequence(F.lit(0), F.size("alts")), lambda i: F.size(F.filter(called, lambda a: a == i)))
    out = out.withColumn("_n", n)
    order = F.array_sort(F.transform("_n", lambda c, i: F.struct((-c).alias("c"), i.alias("i"))))
    major, minor = F.get(order, F.lit(0))["i"], F.get(order, F.lit(1))["i"]
    hit_all = lambda s: F.forall(s["GT"]["alleles"], lambda a: a.isNull())
    hit_some = lambda s: F.exists(s["GT"]["alleles"], lambda a: a.isNull())
    hit = {"./.": lambda s, i: hit_all(s), "./x": lambda s, i: hit_some(s) & ~hit_all(s), ".": lambda s, i: hit_some(s), "a": lambda s, i: F.lit(True), "q": lambda s, i: F.get("_mask", i)}[target]
    const = lambda v: lambda s: _struct(F.transform(s["GT"]["alleles"], lambda _: v), s["GT"]["phased"])
    if new.startswith("c:"):
        sep = "|" if "|" in new else "/"
        fixed = F.array(*[F.lit(None if x == "." else int(x)).cast("int") for x in new[2:].split(sep)])
        make = lambda s: _struct(fixed, F.lit(sep == "|"))
    else:
        make = {
            ".": const(F.lit(None).cast("int")), "0": const(F.lit(0)), "M": const(major), "m": const(minor),
            "p": lambda s: _struct(s["GT"]["alleles"], F.lit(True)), "u": lambda s: _struct(F.array_sort(s["GT"]["alleles"]), F.lit(False)), "i": lambda s: _struct(F.reverse(s["GT"]["alleles"]), s["GT"]["phased"]),
        }[new]
    out = out.withColumn("samples", F.transform("samples", lambda s, i: F.when(F.coalesce(hit(s, i), F.lit(False)), s.withField("GT", make(s))).otherwise(s)))
    return out.drop("_mask", "_n")


def missing_to_ref(df: DataFrame, major: bool = False, phased: bool = False) -> DataFrame:
    """Missing genotypes become reference (or the major allele)."""
    out = set_gt(df, "./.", "M" if major else "0")
    return set_gt(out, "a", "p") if phased else out


def dosages(df: DataFrame) -> DataFrame:
    """chrom, pos, sample, dosage: expected number of ALT alleles from the genotype; -1 where it is missing."""
    e = df.select("chrom", "pos", F.posexplode("samples").alias("sample", "s"))
    return e.select("chrom", "pos", "sample", F.coalesce(g.dosage(F.col("s.GT")).cast("double"), F.lit(-1.0)).alias("dosage"))


def likelihoods_to_probabilities(pl: Column) -> Column:
    """Phred-scaled likelihoods to probabilities that sum to 1."""
    p = F.transform(pl, lambda x: F.pow(F.lit(10.0), -x / 10.0))
    total = F.aggregate(p, F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0)))
    return F.transform(p, lambda x: x / total)


def gl_to_pl(gl: Column) -> Column:
    """log10 likelihoods to phred-scaled ones, the best at 0."""
    top = F.array_max(gl)
    return F.transform(gl, lambda x: F.round(-10 * (x - top)).cast("int"))


def gp_to_gt(gp: Column, least: float = 0.1) -> Column:
    """A diploid genotype called from probabilities, missing if the best leaves more than ``least``."""
    best = F.array_max(gp)
    k = F.array_position(gp, best).cast("int") - 1
    # place k of the genotypes (0,0) (0,1) (1,1) (0,2) ...: the larger allele b is the last with b(b+1)/2 <= k
    b = F.floor((F.sqrt(8.0 * k + 1) - 1) / 2).cast("int")
    a = k - (b * (b + 1) / 2).cast("int")
    missing = F.lit(None).cast("int")
    return F.struct(F.when(1 - best <= least, F.array(a, b)).otherwise(F.array(missing, missing)).alias("alleles"), F.lit(False).alias("phased"))


def fix_ploidy(df: DataFrame, rules: DataFrame, sexes: list[str], default: int = 2) -> DataFrame:
    """Genotypes cut or padded to the ploidy of the site's region (chrom, beg, end, sex, ploidy) and the sample's sex."""
    from siteloom.operators.ranges import overlap_join

    keys = ["chrom", "pos", "ref", "alts"]
    met = overlap_join(df.select(*keys, "end"), rules).groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("r_sex", "r_ploidy"))).alias("_p"))
    names = F.array(*[F.lit(s) for s in sexes])
    j = df.join(met, keys, "left")

    def fixed(s: Column, i: Column) -> Column:
        n = F.coalesce(F.try_element_at(F.coalesce("_p", F.create_map().cast("map<string,int>")), F.get(names, i)), F.lit(default))
        a = s["GT"]["alleles"]
        padded = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.coalesce(F.get(a, k), F.get(a, F.lit(0))))
        return s.withField("GT", _struct(F.when(n == 0, F.array(F.lit(None).cast("int"))).otherwise(padded), s["GT"]["phased"]))

    return j.withColumn("samples", F.transform("samples", fixed)).drop("_p")


def impute_info(df: DataFrame) -> DataFrame:
    """The imputation quality 1 - (sum f - sum e^2) / (2 N theta (1 - theta)) from genotype probabilities GP."""
    gp = F.filter(F.transform("samples", lambda s: s["GP"]), lambda p: p.isNotNull() & (F.size(p) == 3))
    e = F.transform(gp, lambda p: F.get(p, F.lit(1)) + 2 * F.get(p, F.lit(2)))
    f = F.transform(gp, lambda p: F.get(p, F.lit(1)) + 4 * F.get(p, F.lit(2)))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    n = F.size(gp)
    t = df.withColumn("_n", n).withColumn("_e", add(e)).withColumn("_v", add(f) - add(F.transform(e, lambda x: x * x)))
    theta = F.col("_e") / (2 * F.col("_n"))
    out = F.when((F.col("_n") > 0) & (theta > 0) & (theta < 1), 1 - F.col("_v") / (2 * F.col("_n") * theta * (1 - theta))).when(F.col("_n") > 0, 1.0)
    return t.withColumn("INFO", out).drop("_n", "_e", "_v")


def allele_contrast(df: DataFrame, cases: list[int], controls: list[int]) -> DataFrame:
    """Case and control allele counts, the Fisher test of the difference, and whether a case has an allele no control has."""
    from siteloom.functions.stats import fisher_udf

    side = lambda at: F.transform(F.array(*[F.lit(i) for i in at]), lambda i: F.get("samples", i))
    a, b = g.called_alleles(side(cases)), g.called_alleles(side(controls))
    n = lambda x, alt: F.size(F.filter(x, lambda v: (v > 0) == F.lit(alt)))
    t = df.select("chrom", "pos", "ref", "alts", n(a, False).alias("case_ref"), n(a, True).alias("case_alt"), n(b, False).alias("control_ref"), n(b, True).alias("control_alt"), (F.size(F.array_except(a, b)) > 0).alias("novel_allele"))
    return t.withColumn("p", fisher_udf("case_ref", "case_alt", "control_ref", "control_alt"))


def variant_key(df: DataFrame) -> DataFrame:
    """``VKX``: the public 64-bit variant key in hex, of contig (5 bits), position from 0 (28) and alleles (31)."""
    from siteloom.functions.variantkey import variant_key_hex

    return df.withColumn("VKX", variant_key_hex("chrom", F.col("pos") - 1, "ref", F.coalesce(F.get("alts", F.lit(0)), F.lit(""))))


def rs_key(df: DataFrame) -> DataFrame:
    """``RSX``: the number of an ID like ``rs123`` in hex, 8 digits; null for other IDs."""
    number = F.try_to_number(F.regexp_extract("id", r"^[rR][sS](\d+)$", 1), F.lit("9999999999")).cast("long")
    return df.withColumn("RSX", F.lpad(F.lower(F.hex(number)), 8, "0"))


def isec_genotypes(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` with genotypes set missing where ``b`` disagrees."""
    on = ["chrom", "pos", "ref", "alts"]
    j = a.join(b.select(*on, F.col("samples").alias("_other")), on, "left")
    same = lambda s, t: F.array_sort(s["GT"]["alleles"]).eqNullSafe(F.array_sort(t["GT"]["alleles"]))
    gone = lambda s: s.withField("GT", _struct(F.transform(s["GT"]["alleles"], lambda _: F.lit(None).cast("int")), s["GT"]["phased"]))
    return j.withColumn("samples", F.when(F.col("_other").isNull(), F.col("samples")).otherwise(F.zip_with("samples", "_other", lambda s, t: F.when(same(s, t), s).otherwise(gone(s))))).drop("_other")


# --- trios
def trio_table(df: DataFrame, trios: list[tuple[int, int, int]]) -> DataFrame:
    """A row for each site and trio (child, father, mother places)."""
    t = F.array(*[F.struct(F.lit(k).alias("trio"), F.lit(c).alias("c"), F.lit(f).alias("f"), F.lit(m).alias("m")) for k, (c, f, m) in enumerate(trios)])
    e = df.select("chrom", "pos", "ref", "alts", "samples", F.explode(t).alias("t"))
    pick = lambda k: F.get("samples", F.col(f"t.{k}"))["GT"]
    return e.select("chrom", "pos", "ref", "alts", F.col("t.trio").alias("trio"), pick("c").alias("c"), pick("f").alias("f"), pick("m").alias("m"))


def mendelian(df: DataFrame, trios: list[tuple[int, int, int]]) -> DataFrame:
    """Each site and trio with its state: missing, good or error (no inheritance of one allele from each parent)."""
    t = trio_table(df, trios)
    c0, c1 = F.get("c.alleles", F.lit(0)), F.get("c.alleles", F.lit(1))
    has = lambda p, a: F.array_contains(F.col(f"{p}.alleles"), a)
    fits = (has("f", c0) & has("m", c1)) | (has("f", c1) & has("m", c0))
    mis = g.is_missing(F.col("c")) | g.is_missing(F.col("f")) | g.is_missing(F.col("m"))
    return t.withColumn("state", F.when(mis, "missing").when(F.when(mis, F.lit(False)).otherwise(fits), "good").otherwise("error"))


def mendelian_counts(df: DataFrame, trios: list[tuple[int, int, int]]) -> DataFrame:
    s = F.col("state")
    return mendelian(df, trios).groupBy("trio").agg(F.count_if(s == "good").alias("n_good"), F.count_if(s == "error").alias("n_error"), F.count_if(s == "missing").alias("n_missing"))


def trio_stats(df: DataFrame, trios: list[tuple[int, int, int]]) -> DataFrame:
    """Per trio: complete sites, those with an ALT allele, transitions, transversions, Mendelian errors, singletons and
    alleles new in the child."""
    t = mendelian(df, trios).where("state <> 'missing'")
    every = F.flatten(F.array("c.alleles", "f.alleles", "m.alleles"))
    alt1 = F.get("alts", F.lit(0))
    nonref = F.exists(every, lambda a: a > 0)
    snp = al.allele_type(F.col("ref"), alt1) == "snp"
    ts = al.is_transition(F.col("ref"), alt1)
    count_one = F.filter(F.array_distinct(F.filter(every, lambda a: a > 0)), lambda a: F.size(F.filter(every, lambda b: b == a)) == 1)
    new = F.exists(count_one, lambda a: F.array_contains("c.alleles", a))
    t = t.select("trio", "state", nonref.alias("nonref"), (nonref & snp & ts).alias("ts"), (nonref & snp & ~ts).alias("tv"), new.alias("new"), (~new & (F.size(count_one) > 0)).alias("single"))
    return t.groupBy("trio").agg(F.count(F.lit(1)).alias("n_complete"), F.count_if("nonref").alias("n_nonref"), F.count_if("ts").alias("n_ts"), F.count_if("tv").alias("n_tv"), F.count_if(F.col("state") == "error").alias("n_error"), F.count_if("new").alias("n_new"), F.count_if("single").alias("n_singleton"))


def switch_rate(df: DataFrame, trios: list[tuple[int, int, int]]) -> DataFrame:
    """Phase switches of each child over its heterozygous sites that one parent's allele explains."""
    from siteloom.operators.carried import carried, ranged

    t = trio_table(df, trios).where(g.is_het(F.col("c")) & F.col("c.phased"))
    c0, c1 = F.get("c.alleles", F.lit(0)), F.get("c.alleles", F.lit(1))
    has = lambda p, a: F.coalesce(F.array_contains(F.col(f"{p}.alleles"), a), F.lit(False))
    straight, crossed = has("f", c0) & has("m", c1), has("f", c1) & has("m", c0)
    t = t.withColumn("phase", F.when(straight & ~crossed, 0).when(crossed & ~straight, 1)).where("phase is not null")
    keys, order = ["trio", "chrom"], ["pos", "ref"]
    t = carried(ranged(t.select(*keys, *order, "phase"), keys, order), keys, order, before={"_last": F.col("phase")})
    t = t.withColumn("_s", (F.col("_last") != F.col("phase")).cast("int"))
    return t.groupBy("trio").agg(F.count(F.lit(1)).alias("n_tested"), F.coalesce(F.sum("_s"), F.lit(0)).alias("n_switches"))
