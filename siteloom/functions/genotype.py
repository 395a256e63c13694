"""Genotypes: classes, text, counts. A genotype is ``struct<alleles: array<int>, phased: boolean>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ploidy(gt: Column) -> Column:
    return F.coalesce(F.size(gt["alleles"]), F.lit(0))


def is_missing(gt: Column) -> Column:
    """Any allele missing, or none at all."""
    return gt.isNull() | gt["alleles"].isNull() | (F.size(gt["alleles"]) <= 0) | F.exists(gt["alleles"], lambda a: a.isNull())


def is_het(gt: Column) -> Column:
    """Not all alleles equal, at any ploidy."""
    return ~is_missing(gt) & (F.size(F.array_distinct(gt["alleles"])) > 1)


def has_alt(gt: Column) -> Column:
    return F.coalesce(F.exists(gt["alleles"], lambda a: a > 0), F.lit(False))


def genotype_class(gt: Column, name: str) -> Column:
    """Whether a genotype is of a class: ref alt mis, hom het hap, RR RA AR AA aA Aa R A (case counts for the last)."""
    a, n = gt["alleles"], ploidy(gt)
    mis, het = is_missing(gt), is_het(gt)
    ref = F.coalesce(F.exists(a, lambda x: x == 0), F.lit(False))
    simple = {
        "mis": mis,
        "alt": ~mis & (~ref | het),
        "ref": ~mis & ref & ~het,
        "hap": ~mis & (n == 1),
        "hom": ~mis & (n > 1) & ~het,
        "het": ~mis & (n > 1) & het,
    }
    exact = {
        "RR": ~mis & (n > 1) & ~het & ref, "RA": ~mis & (n > 1) & het & ref, "AR": ~mis & (n > 1) & het & ref,
        "AA": ~mis & (n > 1) & ~het & ~ref, "aA": ~mis & (n > 1) & het & ~ref, "Aa": ~mis & (n > 1) & het & ~ref,
        "R": ~mis & (n == 1) & ref, "A": ~mis & (n == 1) & ~ref, "r": ~mis & (n == 1) & ref, "a": ~mis & (n == 1) & ~ref,
        "rr": ~mis & (n > 1) & ~het & ref, "ra": ~mis & (n > 1) & het & ref, "ar": ~mis & (n > 1) & het & ref,
    }
    if name in exact:
        return F.coalesce(exact[name], F.lit(False))
    return F.coalesce(simple[name.lower()], F.lit(False))


CLASSES = {"mis", "alt", "ref", "hap", "hom", "het", "RR", "RA", "AR", "AA", "aA", "Aa", "R", "A", "r", "a", "rr", "ra", "ar"}


def gt_text(gt: Column) -> Column:
    """``0/1``, ``1|0``, ``./.``; ``.`` for no genotype."""
    sep = F.when(F.coalesce(gt["phased"], F.lit(False)), "|").otherwise("/")
    parts = F.transform(gt["alleles"], lambda a: F.coalesce(a.cast("string"), F.lit(".")))
    # array_join takes a literal separator only
    joined = F.when(sep == "|", F.array_join(parts, "|")).otherwise(F.array_join(parts, "/"))
    return F.when(gt.isNull() | gt["alleles"].isNull() | (F.size(gt["alleles"]) <= 0), ".").otherwise(joined)


def translated(gt: Column, ref: Column, alts: Column) -> Column:
    """The genotype in bases."""
    every = F.concat(F.array(ref), F.coalesce(alts, F.array().cast("array<string>")))
    parts = F.transform(gt["alleles"], lambda a: F.coalesce(F.get(every, a), F.lit(".")))
    return F.when(gt.isNull() | gt["alleles"].isNull(), ".").when(F.coalesce(gt["phased"], F.lit(False)), F.array_join(parts, "|")).otherwise(F.array_join(parts, "/"))


def called_alleles(samples: Column) -> Column:
    """All alleles of all samples that aren't missing."""
    return F.filter(F.flatten(F.transform(samples, lambda s: F.coalesce(s["GT"]["alleles"], F.array().cast("array<int>")))), lambda a: a.isNotNull())


def allele_number(samples: Column) -> Column:
    return F.size(called_alleles(samples))


def allele_counts(samples: Column, alts: Column) -> Column:
    """Count of each ALT among the called alleles; null where nothing is called."""
    called = called_alleles(samples)
    counts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(alts), F.lit(1))), lambda i: F.size(F.filter(called, lambda a: a == i)))
    return F.when((F.size(called) > 0) & (F.size(alts) > 0), counts)


def dosage(gt: Column) -> Column:
    """Number of ALT alleles; null if any allele is missing."""
    return F.when(~is_missing(gt), F.size(F.filter(gt["alleles"], lambda a: a > 0)))
