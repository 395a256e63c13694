"""Alleles: variant types, lengths, codes, and re-mapping of per-allele arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of variant types.
TYPE_BITS = {"ref": 0, "snp": 1, "mnp": 2, "indel": 4, "other": 8, "bnd": 16, "overlap": 32}
#: The IUPAC nucleotide codes.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K", "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N"}


def allele_type(ref: Column, alt: Column) -> Column:
    """The type of one ALT as a name."""
    r, a = F.upper(ref), F.upper(alt)
    return (
        F.when(alt.isNull() | alt.isin(".", "<*>", "<NON_REF>") | (a == r), "ref")
        .when(alt == "*", "overlap")
        .when(alt.rlike(r"[\[\]]"), "bnd")
        .when(alt.startswith("<"), F.when(alt.rlike("^<(DEL|INS|DUP)"), "indel").otherwise("other"))
        .when(F.length(r) == F.length(a), F.when(F.length(r) == 1, "snp").otherwise(
            F.when(F.size(F.filter(F.sequence(F.lit(1), F.length(r)), lambda i: F.substr(r, i, F.lit(1)) != F.substr(a, i, F.lit(1)))) == 1, "snp").otherwise("mnp")))
        .when(a.startswith(r) | r.startswith(a), "indel")
        .when((F.substr(r, F.lit(1), F.lit(1)) == F.substr(a, F.lit(1), F.lit(1))) | (F.right(r, F.lit(1)) == F.right(a, F.lit(1))), "indel")
        .otherwise("other")
    )


def variant_types(ref: Column, alts: Column) -> Column:
    """Distinct types of a site's ALTs, sorted; ``['ref']`` without any."""
    kinds = F.array_sort(F.array_distinct(F.transform(alts, lambda a: allele_type(ref, a))))
    return F.when(F.size(F.coalesce(alts, F.array().cast("array<string>"))) > 0, kinds).otherwise(F.array(F.lit("ref")))


def type_mask(ref: Column, alts: Column) -> Column:
    bits = F.create_map(*[F.lit(x) for kv in TYPE_BITS.items() for x in kv])
    return F.aggregate(variant_types(ref, alts), F.lit(0), lambda acc, t: acc.bitwiseOR(bits[t]))


def indel_length(ref: Column, alts: Column) -> Column:
    """len(ALT) - len(REF) of each ALT; null for symbolic ones."""
    return F.transform(alts, lambda a: F.when(a.rlike("^[A-Za-z]+$"), F.length(a) - F.length(ref)))


def is_transition(ref: Column, alt: Column) -> Column:
    pair = F.concat(F.upper(ref), F.upper(alt))
    return pair.isin("AG", "GA", "CT", "TC")


def iupac(ref: Column, alts: Column, alleles: Column) -> Column:
    """The IUPAC code of a genotype of single bases; the bases themselves where there is none."""
    bases = F.transform(alleles, lambda i: F.upper(F.get(F.concat(F.array(ref), alts), i)))
    key = F.array_join(F.array_sort(F.array_distinct(bases)), "")
    codes = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, key), F.array_join(bases, "/"))


def genotype_index(a: Column, b: Column) -> Column:
    """Place of the unordered diploid genotype a/b among genotype likelihoods."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return (hi * (hi + 1) / 2).cast("int") + lo


def remap_a(values: Column, keep: Column) -> Column:
    """Per-ALT values of the ALTs ``keep`` (allele numbers from 1)."""
    return F.transform(keep, lambda k: F.get(values, k - 1))


def remap_r(values: Column, keep: Column) -> Column:
    """Per-allele values of REF and the ALTs ``keep``."""
    return F.concat(F.array(F.get(values, F.lit(0))), F.transform(keep, lambda k: F.get(values, k)))


def remap_g(values: Column, keep: Column) -> Column:
    """Diploid per-genotype values of REF and the ALTs ``keep``."""
    alleles = F.concat(F.array(F.lit(0)), keep)
    n = F.size(alleles)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.transform(F.sequence(F.lit(0), j), lambda i: F.struct(F.get(alleles, i).alias("a"), F.get(alleles, j).alias("b")))))
    return F.transform(pairs, lambda p: F.get(values, genotype_index(p["a"], p["b"])))


def split_index(alt: Column) -> Column:
    """The kept allele of a site split to one ALT."""
    return F.array(alt)
