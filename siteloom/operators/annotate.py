"""Annotation: overlap or position join, aggregation per column, and conditional writing.

A column is written by a mode: replace (``TAG``), only if missing (``+TAG``), only if present (``-TAG``), append (``=TAG``),
and aggregated over several matches by a logic: first, append, append-missing, unique, sum, avg, min, max.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.operators.ranges import overlap_join

LOGIC = ("first", "append", "append-missing", "unique", "sum", "avg", "min", "max")


def aggregate(logic: str, value: Column, order: Column) -> Column:
    """One value of the matches of a site. ``order``: what first and append go by."""
    pairs = lambda v: F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), v.alias("v")))), lambda p: p["v"])
    if logic == "first":
        return F.get(pairs(value), F.lit(0))
    if logic == "append":
        return F.array_join(F.filter(pairs(value.cast("string")), lambda x: x.isNotNull()), ",")
    if logic == "append-missing":
        return F.array_join(pairs(F.coalesce(value.cast("string"), F.lit("."))), ",")
    if logic == "unique":
        return F.array_join(F.array_distinct(F.filter(pairs(value.cast("string")), lambda x: x.isNotNull())), ",")
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[logic](value)


def written(mode: str, old: Column, new: Column) -> Column:
    if mode == "+":
        return F.coalesce(old, new)
    if mode == "-":
        return F.when(old.isNotNull(), F.coalesce(new, old))
    if mode == "=":
        return F.when(old.isNull(), new.cast("string")).when(new.isNull(), old.cast("string")).otherwise(F.concat_ws(",", old.cast("string"), new.cast("string")))
    return F.coalesce(new, old)


def annotate(df: DataFrame, intervals: DataFrame, columns: dict[str, tuple[str, str]], keys: list[str] | None = None, min_site: float = 0.0, min_interval: float = 0.0, condition: Column | None = None) -> DataFrame:
    """``df`` with columns from overlapping ``intervals`` (chrom, beg, end, ...).

    ``columns``: target -> (source column, logic), the target with its mode sign. ``keys`` identify a site. ``condition``
    may compare site columns with interval columns (named ``r_...``). The matches are aggregated before they meet the
    table again, so a site under many intervals stays one row.
    """
    keys = keys or ["chrom", "pos", "ref", "alts"]
    met = overlap_join(df.select(*dict.fromkeys([*keys, "chrom", "pos", "end"])) if condition is None else df, intervals, min_left=min_site, min_right=min_interval)
    if condition is not None:
        met = met.where(condition)
    order = F.struct("r_beg", "r_end")
    out = met.groupBy(*keys).agg(*[aggregate(logic, F.col(f"r_{source}"), order).alias(f"_new_{t.lstrip('+-=')}") for t, (source, logic) in columns.items()])
    joined = df.join(out, keys, "left")
    for target in columns:
        name, mode = target.lstrip("+-="), target[0] if target[0] in "+-=" else ""
        old = F.col(name) if name in df.columns else F.lit(None).cast(dict(out.dtypes)[f"_new_{name}"])
        joined = joined.withColumn(name, written(mode, old, F.col(f"_new_{name}")))
    return joined.drop(*[f"_new_{t.lstrip('+-=')}" for t in columns])


def annotate_from_table(df: DataFrame, other: DataFrame, columns: dict[str, str], logic: str = "some") -> DataFrame:
    """Columns of another variant table at the same site: by position and alleles (``none``: equal; ``some``: an ALT shared)."""
    r = other.select(F.col("chrom"), F.col("pos"), *[F.col(c).alias(f"_r_{c}") for c in dict.fromkeys(["ref", "alts", *columns.values()])])
    match = (F.col("ref") == F.col("_r_ref")) & (F.array_sort("alts") == F.array_sort("_r_alts") if logic == "none" else F.arrays_overlap("alts", "_r_alts"))
    keys = ["chrom", "pos", "ref", "alts"]
    met = df.select(*keys).join(r, ["chrom", "pos"]).where(match).groupBy(*keys).agg(*[F.min_by(f"_r_{s}", F.struct("_r_ref", F.array_join("_r_alts", ","))).alias(f"_new_{t.lstrip('+-=')}") for t, s in columns.items()])
    out = df.join(met, keys, "left")
    for target in columns:
        name, mode = target.lstrip("+-="), target[0] if target[0] in "+-=" else ""
        old = F.col(name) if name in df.columns else F.lit(None).cast(dict(met.dtypes)[f"_new_{name}"])
        out = out.withColumn(name, written(mode, old, F.col(f"_new_{name}")))
    return out.drop(*[f"_new_{t.lstrip('+-=')}" for t in columns])


def remove_info(df: DataFrame, tags: list[str], keep: bool = False) -> DataFrame:
    """INFO tags taken out (with ``keep``: all others)."""
    names = df.schema["info"].dataType.fieldNames()
    gone = [n for n in names if (n in tags) != keep]
    return df.withColumn("info", F.col("info").dropFields(*gone)) if gone and len(gone) < len(names) else df.drop("info") if gone else df


def rename_contigs(df: DataFrame, names: dict[str, str]) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn("chrom", F.coalesce(F.try_element_at(m, F.col("chrom")), "chrom"))


def rename_info(df: DataFrame, names: dict[str, str]) -> DataFrame:
    fields = df.schema["info"].dataType.fieldNames()
    return df.withColumn("info", F.struct(*[F.col("info")[f].alias(names.get(f, f)) for f in fields]))


def set_id(df: DataFrame, value: Column, only_missing: bool = False) -> DataFrame:
    return df.withColumn("id", F.coalesce("id", value) if only_missing else value)


def mark_sites(df: DataFrame, intervals: DataFrame, tag: str, absent: bool = False) -> DataFrame:
    """A flag for sites that overlap the intervals (or don't)."""
    keys = ["chrom", "pos", "ref", "alts"]
    hit = overlap_join(df, intervals, how="semi").select(*keys).distinct().withColumn("_hit", F.lit(True))
    flag = F.coalesce("_hit", F.lit(False))
    return df.join(hit, keys, "left").withColumn(tag, ~flag if absent else flag).drop("_hit")
