"""Tags filled from genotypes: AN AC AF MAF NS AC_Het AC_Hom AC_Hemi HWE ExcHet F_MISSING TYPE END VAF, per population too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.expr.compiler import compile_value, ieee_divide
from siteloom.functions import alleles as al
from siteloom.functions.stats import hwe_udf
from siteloom.schema import with_tag


def sample_class(s: Column, drop_partial: bool = False) -> Column:
    """none (nothing called), hemi (one allele), half (partly missing, with ``drop_partial``), hom or het."""
    called = F.filter(F.coalesce(s["GT"]["alleles"], F.array().cast("array<int>")), lambda a: a.isNotNull())
    n, total = F.size(called), F.size(s["GT"]["alleles"])
    return F.when(n == 0, "none").when((n == 1) & (total > 1) & F.lit(drop_partial), "half").when(n == 1, "hemi").when(F.size(F.array_distinct(called)) == 1, "hom").otherwise("het")


def _class_counts(samples: Column, kind: str, n_alleles: Column) -> Column:
    """Alleles 0..n-1 carried by samples of one class."""
    carried = F.flatten(F.transform(F.filter(samples, lambda s: sample_class(s) == kind), lambda s: F.filter(s["GT"]["alleles"], lambda a: a.isNotNull())))
    return F.transform(F.sequence(F.lit(0), n_alleles - 1), lambda i: F.size(F.filter(carried, lambda a: a == i)))


def filled(df: DataFrame, places: list[int] | None = None, suffix: str = "") -> DataFrame:
    """``df`` with the counts as columns (suffix ``_POP``), of the samples at ``places`` or all."""
    samples = F.col("samples") if places is None else F.transform(F.array(*[F.lit(i) for i in places]), lambda i: F.get("samples", i))
    n_alleles = F.size("alts") + 1
    out = df.withColumn("_s", samples)
    for kind in ("hom", "het", "hemi"):
        out = out.withColumn(f"_{kind}", _class_counts(F.col("_s"), kind, n_alleles))
    tot = F.zip_with(F.zip_with("_hom", "_het", lambda a, b: a + b), "_hemi", lambda a, b: a + b)
    out = out.withColumn("_tot", tot).withColumn(f"AN{suffix}", F.aggregate("_tot", F.lit(0), lambda a, b: a + b))
    tail = lambda c: F.slice(c, F.lit(2), F.size(c))
    an = F.col(f"AN{suffix}")
    freq = F.transform("_tot", lambda c: F.when(an > 0, c / an).otherwise(0.0))
    s = F.sort_array(freq, asc=False)
    ns = F.size(F.filter("_s", lambda x: sample_class(x) != "none"))
    out = (
        out.withColumn(f"AC{suffix}", tail("_tot")).withColumn(f"AC_Hom{suffix}", tail("_hom")).withColumn(f"AC_Het{suffix}", tail("_het")).withColumn(f"AC_Hemi{suffix}", tail("_hemi"))
        .withColumn(f"AF{suffix}", tail(freq)).withColumn(f"MAF{suffix}", F.coalesce(F.get(s, F.lit(1)), F.lit(0.0)))
        .withColumn(f"NS{suffix}", ns).withColumn(f"F_MISSING{suffix}", ieee_divide(F.size("_s") - ns, F.size("_s")))
    )
    # Hardy-Weinberg of the first ALT: reference alleles of homozygotes and of heterozygotes without it
    het = F.get("_het", F.lit(1))
    n_het = het
    all_het = F.aggregate("_het", F.lit(0), lambda a, b: a + b)
    n_ref = F.get("_hom", F.lit(0)) + all_het - het
    n_alt = het + F.get("_hom", F.lit(1))
    h = hwe_udf(n_ref, n_alt, n_het)
    out = out.withColumn("_h", h).withColumn(f"HWE{suffix}", F.col("_h.hwe")).withColumn(f"ExcHet{suffix}", F.col("_h.exc_het"))
    return out.drop("_s", "_hom", "_het", "_hemi", "_tot", "_h")


def filled_by_population(df: DataFrame, populations: dict[str, list[int]]) -> DataFrame:
    out = filled(df)
    for name, places in populations.items():
        out = filled(out, places, f"_{name}")
    return out


def with_type_and_end(df: DataFrame) -> DataFrame:
    return df.withColumn("TYPE", F.array_join(al.variant_types(F.col("ref"), F.col("alts")), ",")).withColumn("END", F.col("pos") + F.length("ref") - 1)


def with_vaf(df: DataFrame) -> DataFrame:
    """FORMAT/VAF (each ALT's share of AD) and VAF1 (of all ALTs)."""
    total = lambda s: F.aggregate(s["AD"], F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0)))
    alts = lambda s: F.slice(s["AD"], F.lit(2), F.size(s["AD"]))
    vaf = lambda s: F.when(total(s) > 0, F.transform(alts(s), lambda x: x / total(s)))
    one = lambda s: F.when(total(s) > 0, F.aggregate(alts(s), F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) / total(s))
    return df.withColumn("samples", F.transform("samples", lambda s: s.withField("VAF", vaf(s)).withField("VAF1", one(s))))


def with_expression(df: DataFrame, tag: str, expr: str, cast: str | None = None) -> DataFrame:
    """INFO/``tag`` from an expression of the filter language; ``cast``: int or float."""
    v = compile_value(expr, df)
    col = v.col
    if cast:
        col = F.transform(col, lambda x: x.cast(cast)) if v.vector or v.level == "sample" else col.cast(cast)
    return with_tag(df, tag, col)
