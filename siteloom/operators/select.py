"""Row selectors and soft filters. Selectors compose: each takes and returns a variant table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.expr import Compiled, compile_filter
from siteloom.functions import alleles as al
from siteloom.functions import genotype as g
from siteloom.operators.carried import carried, ranged
from siteloom.operators.ranges import overlap_join
from siteloom.schema import schema_of


def where(df: DataFrame, expr: str, exclude: bool = False, **kw) -> DataFrame:
    """Sites that an expression keeps; with ``exclude`` those it doesn't match."""
    c = compile_filter(expr, df, **kw)
    if not exclude:
        return df.filter(c.site)
    if c.samples is None:
        return df.filter(~c.site)
    return df.filter(F.exists(c.samples, lambda x: ~x) | ~c.site)


def allele_bounds(df: DataFrame, least: int | None = None, most: int | None = None) -> DataFrame:
    n = F.size(F.coalesce("alts", F.array().cast("array<string>"))) + 1
    out = df
    if least is not None:
        out = out.filter(n >= least)
    return out.filter(n <= most) if most is not None else out


def known(df: DataFrame, novel: bool = False) -> DataFrame:
    return df.filter(F.col("id").isNull() if novel else F.col("id").isNotNull())


def of_types(df: DataFrame, types: list[str], exclude: bool = False) -> DataFrame:
    hit = F.arrays_overlap(al.variant_types(F.col("ref"), F.col("alts")), F.array(*[F.lit(t) for t in types]))
    return df.filter(~hit if exclude else hit)


def apply_filters(df: DataFrame, names: list[str]) -> DataFrame:
    """Any of the names among the site's filters; ``.`` means none applied."""
    hit = F.arrays_overlap("filters", F.array(*[F.lit(n) for n in names]))
    return df.filter((hit | (F.size("filters") <= 0)) if "." in names else hit)


def genotype(df: DataFrame, kind: str) -> DataFrame:
    """At least one genotype that is hom, het or miss; with ``^`` none."""
    none, name = kind.startswith("^"), {"miss": "mis"}.get(kind.lstrip("^"), kind.lstrip("^"))
    hit = F.exists("samples", lambda s: g.genotype_class(s["GT"], name))
    return df.filter(~hit if none else hit)


def _picked_count(kind: str, ac: Column, an: Column) -> Column:
    """The count of an allele class: nref, alt1, minor, major, nonmajor. ``ac``: of each ALT."""
    total = F.aggregate(ac, F.lit(0), lambda x, y: x + y)
    every = F.concat(F.array((an - total).cast("int")), ac)
    if kind == "nref":
        return total
    if kind == "alt1":
        return F.coalesce(F.get(ac, F.lit(0)), F.lit(0))
    s = F.array_sort(every)
    if kind == "minor":
        return F.get(s, F.size(s) - 2)
    return F.array_max(every) if kind == "major" else an - F.array_max(every)


def counts(df: DataFrame, least: int | None = None, most: int | None = None, kind: str = "nref", frequency: bool = False, low: float | None = None, high: float | None = None) -> DataFrame:
    """Bounds of an allele count, or (``frequency``) of its share; the latter drops sites without calls."""
    an = g.allele_number(F.col("samples"))
    ac = F.coalesce(g.allele_counts(F.col("samples"), F.col("alts")), F.transform("alts", lambda _: F.lit(0)))
    n = _picked_count(kind, ac, an)
    if frequency:
        f = F.try_divide(n.cast("double"), an)
        out = df.filter(an > 0)
        out = out.filter(f >= low) if low is not None else out
        return out.filter(f <= high) if high is not None else out
    out = df.filter(n >= least) if least is not None else df
    return out.filter(n <= most) if most is not None else out


def private(df: DataFrame, subset: list[int], exclude: bool = False) -> DataFrame:
    """Sites whose ALT alleles are all in the samples ``subset`` (places)."""
    inside = F.size(F.filter(g.called_alleles(F.array(*[F.get("samples", F.lit(i)) for i in subset])), lambda a: a > 0))
    total = F.size(F.filter(g.called_alleles(F.col("samples")), lambda a: a > 0))
    hit = (inside > 0) & (inside == total)
    return df.filter(~hit if exclude else hit)


def uncalled(df: DataFrame, exclude: bool = False) -> DataFrame:
    hit = g.allele_number(F.col("samples")) == 0
    return df.filter(~hit if exclude else hit)


def phased(df: DataFrame, exclude: bool = False) -> DataFrame:
    """Sites with all genotypes phased (single alleles count as phased)."""
    hit = F.forall("samples", lambda s: F.coalesce(s["GT"]["phased"], F.lit(False)) | (g.ploidy(s["GT"]) == 1))
    return df.filter(~hit if exclude else hit)


def subset_samples(df: DataFrame, places: list[int]) -> DataFrame:
    """The samples at ``places``, in that order."""
    return df.withColumn("samples", F.transform(F.array(*[F.lit(i) for i in places]), lambda i: F.get("samples", i)))


def drop_genotypes(df: DataFrame) -> DataFrame:
    return df.drop("samples")


def trim_alts(df: DataFrame, only_unseen: bool = False, numbers: dict[str, str] | None = None) -> DataFrame:
    """ALTs that no genotype has (or the unseen-allele symbols only) taken out, genotypes renumbered, per-allele values cut.

    INFO and FORMAT fields of Number A, R or G, by the fields' metadata or by ``numbers``, keep the values of the alleles
    that stay, wherever they have one for each allele (a haploid G field has as many values as alleles).
    """
    called = g.called_alleles(F.col("samples"))
    unseen = lambda a: a.isin("<*>", "<NON_REF>")
    number = F.sequence(F.lit(1), F.size("alts"))
    keep = F.filter(number, lambda k: ~unseen(F.get("alts", k - 1)) if only_unseen else F.array_contains(called, k))
    keep = F.when(F.size("alts") > 0, keep).otherwise(F.array().cast("array<int>"))
    out = df.withColumn("_keep", keep)
    schema = schema_of(df)
    per_allele = {scope: {t.id: (numbers or {}).get(t.id, t.number) for t in tags.values()} for scope, tags in (("info", schema.info), ("samples", schema.format))}
    n = F.size("alts") + 1

    def cut(values: Column, kind: str) -> Column:
        k = F.col("_keep")
        if kind == "A":
            return F.when(F.size(values) == n - 1, al.remap_a(values, k)).otherwise(values)
        if kind == "R":
            return F.when(F.size(values) == n, al.remap_r(values, k)).otherwise(values)
        return F.when(F.size(values) == n * (n + 1) / 2, al.remap_g(values, k)).when(F.size(values) == n, al.remap_r(values, k)).otherwise(values)

    renumber = lambda a: F.when(a.isNull() | (a == 0), a).otherwise(F.nullif(F.array_position("_keep", a).cast("int"), F.lit(0)))

    def sample(s: Column) -> Column:
        new = s.withField("GT", F.struct(F.transform(s["GT"]["alleles"], renumber).alias("alleles"), s["GT"]["phased"].alias("phased")))
        for name, kind in per_allele["samples"].items():
            if kind in ("A", "R", "G"):
                new = new.withField(name, cut(s[name], kind))
        return new

    out = out.withColumn("samples", F.transform("samples", sample))
    for name, kind in per_allele["info"].items():
        if kind in ("A", "R", "G"):
            out = out.withColumn("info", F.col("info").withField(name, cut(F.col("info")[name], kind)))
    return out.withColumn("alts", F.transform("_keep", lambda k: F.get("alts", k - 1))).drop("_keep")


def soft_filter(df: DataFrame, expr: str | Column | Compiled, name: str, append: bool = False, reset: bool = False, exclude: bool = False) -> DataFrame:
    """Failing sites get the filter ``name`` (replacing, or with ``append`` added); passing ones PASS where none is set.

    ``reset``: passing sites get PASS whatever they had.
    """
    c = compile_filter(expr, df) if isinstance(expr, str) else expr
    ok = c.site if isinstance(c, Compiled) else c
    ok = ~ok if exclude else ok
    have = F.array_remove("filters", "PASS")
    failed = F.array_union(have, F.array(F.lit(name))) if append else F.array(F.lit(name))
    passed = F.array(F.lit("PASS")) if reset else F.when(F.size("filters") <= 0, F.array(F.lit("PASS"))).otherwise(F.col("filters"))
    return df.withColumn("filters", F.when(ok, passed).otherwise(failed))


def set_failed_genotypes(df: DataFrame, expr: str, to: str = ".") -> DataFrame:
    """Genotypes of samples that fail become missing (``.``) or reference (``0``)."""
    mask = compile_filter(expr, df).sample_mask(F.size("samples"))
    value = F.lit(None).cast("int") if to == "." else F.lit(0)
    blank = lambda s: s.withField("GT", F.struct(F.transform(s["GT"]["alleles"], lambda _: value).alias("alleles"), s["GT"]["phased"].alias("phased")))
    return df.withColumn("_mask", mask).withColumn("samples", F.zip_with("samples", "_mask", lambda s, ok: F.when(ok, s).otherwise(blank(s)))).drop("_mask")


def region_mask(df: DataFrame, regions: DataFrame, name: str, complement: bool = False) -> DataFrame:
    """Sites that overlap the regions (chrom, beg, end) get the filter ``name``."""
    keyed = df.withColumn("_key", F.struct("chrom", "pos", "ref", "alts"))
    hit = overlap_join(keyed, regions, how="semi").select("_key").distinct().withColumn("_hit", F.lit(True))
    out = keyed.join(hit, "_key", "left")
    inside = F.coalesce("_hit", F.lit(False))
    return soft_filter(out, inside if complement else ~inside, name, append=True).drop("_key", "_hit")


def regions(df: DataFrame, where_: DataFrame, targets: bool = False, complement: bool = False) -> DataFrame:
    """Sites in regions (chrom, beg, end). As regions a site comes once for each that it overlaps, as targets once."""
    if not targets:
        return overlap_join(df, where_, how="inner").select(*df.columns)
    by_pos = df.withColumn("_p", F.col("pos"))
    return overlap_join(by_pos, where_, ("chrom", "pos", "_p"), how="anti" if complement else "semi").drop("_p")


def snp_gap(df: DataFrame, gap: int, types: tuple[str, ...] = ("indel",), name: str = "SnpGap", block: int = 20) -> DataFrame:
    """SNPs within ``gap`` bases of another site that is an indel (or of the types given) get a filter.

    An earlier site reaches to its ``end`` (that of REF, or END of a symbolic allele). Contigs are cut into blocks of 2**``block`` bases; the sites that are
    looked for (narrow rows) go to every block that they reach, so each block is solved apart.
    """
    kinds = al.variant_types(F.col("ref"), F.col("alts"))
    t = df.withColumn("_hit", F.arrays_overlap(kinds, F.array(*[F.lit(x) for x in types]))).withColumn("_snp", F.array_contains(kinds, "snp"))
    t = t.withColumn("_block", F.shiftright(F.col("pos"), block)).withColumn("_end", F.lit(None).cast("long"))
    end = F.greatest(F.col("pos") + F.length("ref") - 1, F.coalesce("end", "pos"))
    reach = F.sequence(F.shiftright(F.greatest(F.col("pos") - gap, F.lit(0)), block), F.shiftright(end + gap, block))
    hits = t.where("_hit").select("chrom", "pos", F.explode(reach).alias("_block"), end.cast("long").alias("_end"))
    both = t.unionByName(hits, allowMissingColumns=True)
    w = Window.partitionBy("chrom", "_block").orderBy("pos")
    before = F.max("_end").over(w.rangeBetween(Window.unboundedPreceding, -1))
    here = F.count("_end").over(w.rangeBetween(0, gap)) - F.col("_hit").cast("int")
    near = F.col("_snp") & (F.coalesce(F.col("pos") - before <= gap, F.lit(False)) | (here > 0))
    out = both.withColumn("_near", near).where("_end is null").drop("_hit", "_snp", "_block", "_end")
    return soft_filter(out, ~F.col("_near"), name, append=True).drop("_near")


def indel_gap(df: DataFrame, gap: int, name: str = "IndelGap") -> DataFrame:
    """Of indels chained by gaps of at most ``gap`` the best stays (QUAL, then alternate alleles, then the first)."""
    is_indel = F.array_contains(al.variant_types(F.col("ref"), F.col("alts")), "indel")
    order = ["pos", "ref"]
    # the indels alone are put in order; what they reach and their chains are carried along the contig
    t = ranged(df.where(is_indel).withColumn("_n", F.size(F.filter(g.called_alleles(F.col("samples")), lambda a: a > 0))), ["chrom"], order)
    t = carried(t, ["chrom"], order, maxima={"_reach": F.col("pos") + F.length("ref") - 1}, inclusive=False)
    t = carried(t, ["chrom"], order, sums={"_cluster": F.coalesce((F.col("pos") - F.col("_reach") > gap).cast("int"), F.lit(1))})
    best = F.row_number().over(Window.partitionBy("chrom", "_cluster").orderBy(F.desc_nulls_last("qual"), F.desc("_n"), "pos", "ref"))
    t = t.withColumn("_best", best == 1).select(*df.columns, "_best")
    out = df.where(~is_indel).withColumn("_best", F.lit(True)).unionByName(t)
    return soft_filter(out, F.col("_best"), name, append=True).drop("_best")


def genotype_subset(df: DataFrame, places: list[int]) -> DataFrame:
    """Sites where the samples at ``places`` share one genotype that no other sample has."""
    key = F.transform("samples", lambda s: F.when(~g.is_missing(s["GT"]), F.array_join(F.array_sort(s["GT"]["alleles"]), "/")))
    chosen = F.array(*[F.lit(i) for i in places])
    inside, outside = F.filter(key, lambda _, i: F.array_contains(chosen, i)), F.filter(key, lambda _, i: ~F.array_contains(chosen, i))
    one = F.get(inside, F.lit(0))
    return df.filter(one.isNotNull() & F.forall(inside, lambda k: k.eqNullSafe(one)) & ~F.exists(outside, lambda k: k.eqNullSafe(one)))


def sparse_samples(df: DataFrame, least: int) -> DataFrame:
    """(chrom, sample) with fewer than ``least`` genotypes called."""
    long = df.select("chrom", F.posexplode("samples").alias("sample", "s"))
    return long.groupBy("chrom", "sample").agg(F.count_if(~g.is_missing(F.col("s.GT"))).alias("n_called")).where(F.col("n_called") < least)
