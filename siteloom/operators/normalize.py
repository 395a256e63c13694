"""Normalisation: splitting and joining multiallelic sites, duplicates, REF checks, left-alignment, atoms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import alleles as al
from siteloom.operators.setops import concat
from siteloom.schema import VariantSchema, schema_of


def _kept(value: Column, number: str, alt: Column, keep_sum: bool = False) -> Column:
    keep = F.array(alt)
    if number == "A":
        return al.remap_a(value, keep)
    if number == "R":
        out = al.remap_r(value, keep)
        if keep_sum:
            rest = F.aggregate(value, F.lit(0).cast("long"), lambda x, y: x + F.coalesce(y, F.lit(0))) - F.coalesce(F.get(value, F.lit(0)), F.lit(0)) - F.coalesce(F.get(value, alt), F.lit(0))
            return F.array((F.get(value, F.lit(0)) + rest).cast("int"), F.get(value, alt))
        return out
    return al.remap_g(value, keep) if number == "G" else value


def split(df: DataFrame, schema: VariantSchema | None = None, other_missing: bool = False, keep_sum: tuple[str, ...] = ()) -> DataFrame:
    """One row for each ALT. The other ALTs of a genotype become 0, or missing; per-allele fields are cut."""
    schema = schema or schema_of(df)
    rows = df.select("*", F.posexplode_outer("alts").alias("_i", "_alt"))
    k = F.coalesce(F.col("_i") + 1, F.lit(1))
    rows = rows.withColumn("_k", k)
    other = F.lit(None).cast("int") if other_missing else F.lit(0)
    gt = lambda s: F.struct(F.transform(s["GT"]["alleles"], lambda a: F.when(a.isNull() | (a == 0), a).when(a == F.col("_k"), 1).otherwise(other)).alias("alleles"), s["GT"]["phased"].alias("phased"))

    def sample(s: Column) -> Column:
        out = s.withField("GT", gt(s)) if "GT" in schema.format else s
        for t in schema.format.values():
            if t.id != "GT" and t.number in "ARG":
                out = out.withField(t.id, _kept(s[t.id], t.number, F.col("_k"), t.id in keep_sum))
        return out

    rows = rows.withColumn("samples", F.transform("samples", sample)) if schema.format else rows
    for t in schema.info.values():
        if t.number in "ARG":
            rows = rows.withColumn("info", F.col("info").withField(t.id, _kept(F.col("info")[t.id], t.number, F.col("_k"), t.id in keep_sum)))
    return rows.withColumn("alts", F.when(F.col("_alt").isNull(), F.col("alts")).otherwise(F.array("_alt"))).drop("_i", "_alt", "_k")


def join(df: DataFrame, by_class: bool = True) -> DataFrame:
    """Rows of one position and REF (and class) become one multiallelic row; genotypes are overlaid, first call first.

    The rows of a position are few; they are gathered in one aggregate, not one task.
    """
    kinds = al.variant_types(F.col("ref"), F.col("alts"))
    t = df.withColumn("_class", F.when(F.array_contains(kinds, "snp"), "snp").when(F.array_contains(kinds, "indel"), "indel").otherwise("other") if by_class else F.lit(""))
    keep = [c for c in df.columns if c not in ("chrom", "contig_idx", "pos", "ref", "alts", "samples")]
    row = F.struct(F.array_join("alts", ",").alias("o"), "alts", "samples", *keep)
    g = t.groupBy("chrom", "contig_idx", "pos", "ref", "_class").agg(F.array_sort(F.collect_list(F.struct(F.array_join("alts", ",").alias("o"), F.struct("alts", "samples").alias("r")))).alias("_r"), F.min_by(F.struct(*keep), row["o"]).alias("_f"))
    g = g.withColumn("alts", F.array_distinct(F.flatten(F.transform("_r", lambda x: x["r"]["alts"]))))
    number = lambda r, a: F.when(a == 0, 0).otherwise(F.array_position("alts", F.get(r["r"]["alts"], a - 1)).cast("int"))

    def overlay(s: Column, i: Column) -> Column:
        def pick(h: Column) -> Column:
            calls = F.transform("_r", lambda r: F.get(F.get(r["r"]["samples"], i)["GT"]["alleles"], h))
            numbered = F.transform(F.arrays_zip(F.col("_r").alias("r"), calls.alias("c")), lambda z: number(z["r"], z["c"]))
            return F.coalesce(F.get(F.filter(numbered, lambda a: a > 0), F.lit(0)), F.get(F.filter(numbered, lambda a: a == 0), F.lit(0)))

        return s.withField("GT", F.struct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(s["GT"]["alleles"]), F.lit(1)) - 1), pick).alias("alleles"), s["GT"]["phased"].alias("phased")))

    g = g.withColumn("samples", F.transform(F.get("_r", F.lit(0))["r"]["samples"], overlay))
    return g.select(*[F.col("_f")[c].alias(c) if c in keep else F.col(c) for c in df.columns])


def without_duplicates(df: DataFrame, logic: str = "none") -> DataFrame:
    """Of sites with one position (and class, or alleles) the first."""
    return concat([df], logic)


def reference_check(df: DataFrame, bases: DataFrame, how: str = "exclude") -> DataFrame:
    """REF against a table of bases (chrom, pos, base). exclude: wrong sites go; set: REF is corrected, alleles swapped
    if the ALT is the true base; flag: ``ref_ok`` tells."""
    j = df.join(bases.select("chrom", "pos", F.upper("base").alias("_base")), ["chrom", "pos"], "left")
    ok = F.col("_base").isNull() | (F.upper(F.substr("ref", F.lit(1), F.lit(1))) == F.col("_base"))
    if how == "exclude":
        return j.where(ok).drop("_base")
    if how == "flag":
        return j.withColumn("ref_ok", ok).drop("_base")
    swap = ~ok & (F.size("alts") == 1) & (F.upper(F.get("alts", F.lit(0))) == F.col("_base"))
    flip = lambda s: s.withField("GT", F.struct(F.transform(s["GT"]["alleles"], lambda a: F.when(a.isNull(), a).otherwise(1 - a)).alias("alleles"), s["GT"]["phased"].alias("phased")))
    out = j.withColumn("_swap", swap).withColumn("samples", F.when(F.col("_swap"), F.transform("samples", flip)).otherwise(F.col("samples")))
    old = F.col("ref")
    return out.withColumn("alts", F.when(F.col("_swap"), F.array(old)).otherwise(F.col("alts"))).withColumn("ref", F.when(ok, old).otherwise(F.concat("_base", F.substr("ref", F.lit(2), F.length("ref"))))).drop("_base", "_swap")


def left_aligned_alleles(pos: int, ref: str, alts: list[str], base_at) -> tuple[int, str, list[str]]:
    """Alleles trimmed on the right, moved left over repeats of the reference, then trimmed on the left."""
    seqs = [ref.upper(), *[a.upper() for a in alts]]
    if any(not s.isalpha() for s in seqs) or len({len(s) for s in seqs}) == 1 and len(ref) == 1:
        return pos, ref, alts
    while True:
        if all(seqs) and len({s[-1] for s in seqs}) == 1 and (min(map(len, seqs)) > 1 or pos > 1):
            seqs = [s[:-1] for s in seqs]
            if any(not s for s in seqs):
                pos -= 1
                b = base_at(pos)
                if b is None:
                    raise ValueError("no reference base before the site")
                seqs = [b + s for s in seqs]
            continue
        break
    while min(map(len, seqs)) > 1 and len({s[0] for s in seqs}) == 1:
        seqs = [s[1:] for s in seqs]
        pos += 1
    return pos, seqs[0], seqs[1:]


def left_align(df: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """Indels at their leftmost place. ``chunks``: (chrom, chunk, seq), the reference in pieces of ``width`` bases.

    The distinct alleles of indels meet their own chunk and those before it, by an equi-join; whatever reaches the first
    base of those is done again with twice as many, so shifts of any length come to their end. Sites without a reference
    stay. Rows get their new alleles by the old ones, so nothing is numbered.
    """
    keys = ["chrom", "pos", "ref", "alts"]
    plain = F.forall("alts", lambda x: x.rlike("^[A-Za-z]+$")) & F.exists("alts", lambda x: F.length(x) != F.length("ref"))
    todo = df.where(plain).select(*keys).distinct()
    moved, back = None, 2
    while True:
        n = F.floor((F.col("pos") - 1) / width)
        need = todo.withColumn("_n", n).select(*keys, F.explode(F.sequence(F.greatest(F.col("_n") - back, F.lit(0)), F.col("_n") + 1)).alias("chunk")).join(chunks, ["chrom", "chunk"])
        seq = need.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]), "").alias("_seq"), (F.min("chunk") * width).alias("_offset"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                out = []
                for chrom, pos, ref, alts, text, offset in p[[*keys, "_seq", "_offset"]].itertuples(index=False):
                    more = False

                    def base(at: int, text: str = text, offset: int = int(offset)) -> str | None:
                        nonlocal more
                        more = more or (at - 1 - offset <= 0 < offset)
                        return text[at - 1 - offset].upper() if 0 <= at - 1 - offset < len(text) else None

                    try:
                        new = left_aligned_alleles(int(pos), ref, list(alts), base)
                    except ValueError:
                        new = (pos, ref, list(alts))
                    out.append((chrom, pos, ref, list(alts), *new, more))
                yield pd.DataFrame(out, columns=[*keys, "new_pos", "new_ref", "new_alts", "more"])

        found = seq.mapInPandas(run, "chrom string, pos long, ref string, alts array<string>, new_pos long, new_ref string, new_alts array<string>, more boolean")
        done = found.where("not more").drop("more")
        moved = done if moved is None else moved.unionByName(done)
        todo, back = found.where("more").select(*keys), 2 * back
        if not todo.limit(1).count():
            break
    j = df.join(moved, keys, "left")
    return j.withColumn("end", F.when(F.col("new_pos").isNull(), F.col("end")).otherwise(F.col("new_pos") + F.length("new_ref") - 1)).withColumn("pos", F.coalesce("new_pos", "pos")).withColumn("ref", F.coalesce("new_ref", "ref")).withColumn("alts", F.coalesce("new_alts", "alts")).select(*df.columns)


def atomize(df: DataFrame) -> DataFrame:
    """MNPs become a row for each base that differs, with the genotypes of the whole; other sites pass. Native."""
    one = split(df)
    alt = F.get("alts", F.lit(0))
    is_mnp = (F.length("ref") > 1) & (F.length("ref") == F.length(alt)) & alt.rlike("^[A-Za-z]+$")
    at = F.filter(F.sequence(F.lit(1), F.length("ref")), lambda i: F.substr("ref", i, F.lit(1)) != F.substr(alt, i, F.lit(1)))
    atoms = F.when(is_mnp, F.transform(at, lambda i: F.struct((F.col("pos") + i - 1).alias("pos"), F.substr("ref", i, F.lit(1)).alias("ref"), F.substr(alt, i, F.lit(1)).alias("alt")))).otherwise(F.array(F.struct("pos", "ref", alt.alias("alt"))))
    e = one.withColumn("_a", F.explode(atoms))
    return e.withColumn("pos", F.col("_a.pos")).withColumn("ref", F.col("_a.ref")).withColumn("alts", F.array("_a.alt")).withColumn("end", F.col("pos") + F.length("ref") - 1).drop("_a")


def rename_duplicates(df: DataFrame) -> DataFrame:
    """Sites with ``n_same``: how many share the position."""
    return df.withColumn("n_same", F.count(F.lit(1)).over(Window.partitionBy("chrom", "pos")))
