"""Merging call sets side by side: sites of one key become one, samples are concatenated, fields are reduced."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.functions import alleles as al
from siteloom.functions import genotype as g
from siteloom.schema import schema_of

#: How INFO fields of several tables become one, from the array of their values in the order of tables (none is null).
RULES = {
    "sum": lambda x: F.aggregate(F.slice(x, 2, 1_000_000), F.get(x, F.lit(0)), lambda a, b: a + b),
    "avg": lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x),
    "min": F.array_min, "max": F.array_max, "first": lambda x: F.get(x, F.lit(0)),
}

#: Names of the allele that stands for all that a sample hasn't shown.
UNSEEN = ("<*>", "<NON_REF>", "<X>")


def merged_filters(sets: Column, prefer_pass: bool = False) -> Column:
    """Ordered union of the tables' filters; PASS goes if there is any other (with ``prefer_pass``: PASS wins)."""
    u = F.array_distinct(F.flatten(sets))
    if prefer_pass:
        return F.when(F.array_contains(u, "PASS"), F.array(F.lit("PASS"))).otherwise(u)
    rest = F.array_remove(u, "PASS")
    return F.when(F.size(rest) > 0, rest).otherwise(u)


def reduced(rule: str, values: Column, kind: T.DataType) -> Column:
    """One of several values by a rule; missing ones give way. ``join`` appends lists; other rules go place by place."""
    x = F.filter(values, lambda v: v.isNotNull())
    if not isinstance(kind, T.ArrayType):
        return F.when(F.size(x) > 0, RULES[rule](x).cast(kind.simpleString()))
    if rule == "first":
        return F.get(x, F.lit(0))
    if rule == "join":
        return F.when(F.size(x) > 0, F.flatten(x))
    longest = F.array_max(F.transform(x, F.size))
    place = lambda i: F.filter(F.transform(x, lambda v: F.get(v, i)), lambda e: e.isNotNull())
    each = F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.when(F.size(place(i)) > 0, RULES[rule](place(i)).cast(kind.elementType.simpleString())))
    return F.when(F.size(x) > 0, F.when(longest > 0, each).otherwise(F.get(x, F.lit(0))))


def _class_key(logic: str) -> Column:
    kinds = al.variant_types(F.col("ref"), F.col("alts"))
    exact = F.concat(F.col("ref"), F.lit(">"), F.array_join(F.array_sort("alts"), ","))
    if logic == "none":
        return exact
    if logic == "id":
        return F.coalesce("id", exact)
    snp, indel = F.array_contains(kinds, "snp"), F.array_contains(kinds, "indel")
    if logic == "snps":
        return F.when(snp, "snp").otherwise(exact)
    if logic == "indels":
        return F.when(indel, "indel").otherwise(exact)
    if logic == "both":
        return F.when(snp, "snp").when(indel, "indel").otherwise(exact)
    return F.lit("")


def _remapped(values: Column, number: str, kind: T.DataType, back: Column, unseen: Column, missing: str | float | None = None) -> Column:
    """Per-allele values in the merged order. ``back``: for each merged allele (REF first) its place in this table, or null.

    ``unseen``: the place of the table's allele for whatever it hasn't seen (``<*>``), or null. Where it has one, alleles
    that it doesn't know take that allele's value, and genotypes with one of them the value of that allele twice; else
    they take what ``missing`` says: the largest of the values (``max``), a number, or nothing.
    """
    if number not in ("A", "R", "G") or not isinstance(kind, T.ArrayType):
        return values
    fill = F.array_max(values) if missing == "max" else F.lit(None if missing in (None, ".") else missing).cast(kind.elementType.simpleString())
    one = lambda k, at, instead: F.when(k.isNotNull(), F.get(values, at)).otherwise(F.coalesce(F.get(values, instead), fill))
    if number == "A":
        out = F.transform(F.slice(back, 2, 1_000_000), lambda k: one(k, k - 1, unseen - 1))
    elif number == "R":
        out = F.transform(back, lambda k: one(k, k, unseen))
    else:
        pairs = F.flatten(F.transform(back, lambda b, j: F.transform(F.slice(back, 1, j + 1), lambda a: F.struct(a.alias("a"), b.alias("b")))))
        diploid = F.transform(pairs, lambda p: one(p["a"] + p["b"], al.genotype_index(p["a"], p["b"]), al.genotype_index(unseen, unseen)))
        # a haploid call has one value an allele
        haploid = F.size(values) == F.size(F.filter(back, lambda k: k.isNotNull()))
        out = F.when(haploid & (F.size(values) < 3), F.transform(back, lambda k: one(k, k, unseen))).otherwise(diploid)
    return F.when(values.isNotNull(), out).cast(kind.simpleString())


def _aligned(df: DataFrame, name: str, fields: dict[str, T.DataType]) -> Column:
    """The struct column ``info`` or the array ``samples`` with the same fields in every table."""
    kind = df.schema[name].dataType
    have = {f.name for f in (kind.elementType if isinstance(kind, T.ArrayType) else kind).fields}
    build = lambda s: F.struct(*[(s[f] if f in have else F.lit(None)).cast(t.simpleString()).alias(f) for f, t in fields.items()])
    return F.transform(name, build) if isinstance(kind, T.ArrayType) else build(F.col(name))


def _held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with more columns, each computed once a row: a generator stands between them and the lambdas that use them,
    into which the optimizer would else put the whole expressions, to be evaluated for each element.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def merge_all(tables: list[DataFrame], sizes: list[int], logic: str = "both", rules: dict[str, str] | None = None, missing_to_ref: bool = False, numbers: dict[str, str] | None = None, key: str | None = None, missing: dict[str, str | float] | None = None) -> DataFrame:
    """Any number of tables by position and pair logic: one union, one shuffle by the key.

    Several rows of one table with the same key pair up in order of their alleles. REFs are padded to the longest one,
    ALTs are united in order, genotypes and the per-allele fields (Number A, R or G by the fields' metadata or by
    ``numbers``) of every table are renumbered; values of alleles that a table doesn't know are those of its ``<*>`` or
    ``<NON_REF>``, else those of ``missing`` (by FORMAT field: ``max``, a number, or ``.``). ``key`` names a column of all tables that stands for the pair logic. Absent samples
    get missing genotypes, or reference ones with ``missing_to_ref``. INFO fields are reduced by ``rules`` (sum, avg,
    min, max, first, join; ``first`` where none is given), AC and AN, where present, are counted anew.
    """
    if logic == "some" and key is None:
        from siteloom.operators.setops import by_some_allele

        tables, key = by_some_allele(tables), "_key"
    rules, known = rules or {}, {}
    info: dict[str, T.DataType] = {}
    fmt: dict[str, T.DataType] = {}
    for t in tables:
        info |= {f.name: f.dataType for f in t.schema["info"].dataType.fields if f.name not in info}
        fmt |= {f.name: f.dataType for f in t.schema["samples"].dataType.elementType.fields if f.name not in fmt}
        schema = schema_of(t)
        known |= {k: v.number for k, v in {**schema.info, **schema.format}.items() if v.number in ("A", "R", "G")}
    known |= numbers or {}
    w = Window.partitionBy("chrom", "pos", "_k").orderBy("ref", F.array_join("alts", ","))
    sides = []
    for i, t in enumerate(tables):
        e = F.struct("ref", F.coalesce("alts", F.array().cast("array<string>")).alias("alts"), F.col("end").cast("long").alias("end"), "id", F.col("qual").cast("float").alias("qual"), "filters", _aligned(t, "info", info).alias("info"))
        sides.append(t.withColumn("_k", F.col(key) if key else _class_key(logic)).withColumn("_i", F.row_number().over(w)).select("chrom", "contig_idx", "pos", "_k", "_i", F.lit(i).alias("t"), e.alias("e"), _aligned(t, "samples", fmt).alias("s")))
    n = len(tables)
    own = lambda name, i: F.first(F.when(F.col("t") == i, F.col(name)), ignorenulls=True)
    u = reduce(DataFrame.unionByName, sides).groupBy("chrom", "contig_idx", "pos", "_k", "_i").agg(*[own("e", i).alias(f"e{i}") for i in range(n)], *[own("s", i).alias(f"s{i}") for i in range(n)])
    flat = {f"{c}_{i}": F.col(f"e{i}.{c}") for i in range(n) for c in ("ref", "alts", "end", "id", "qual", "filters")} | {f"info_{k}_{i}": F.col(f"e{i}.info")[k] for i in range(n) for k in info}
    u = u.select("chrom", "contig_idx", "pos", *[c.alias(k) for k, c in flat.items()], *[f"s{i}" for i in range(n)])
    refs = F.array_compact(F.array(*[F.col(f"ref_{i}") for i in range(n)]))
    u = _held(u, {"ref": F.aggregate(refs, F.lit(""), lambda acc, r: F.when(F.length(r) > F.length(acc), r).otherwise(acc))})
    pad = lambda i: F.transform(f"alts_{i}", lambda x: F.when(x.rlike("^[A-Za-z]+$"), F.concat(x, F.substr("ref", F.length(f"ref_{i}") + 1))).otherwise(x))
    u = _held(u, {f"p{i}": pad(i) for i in range(n)})
    u = _held(u, {"alts": F.array_distinct(F.flatten(F.array_compact(F.array(*[F.col(f"p{i}") for i in range(n)]))))})
    # the merged numbers of a table's alleles, and the other way round
    place = lambda of, among: F.concat(F.array(F.lit(0)), F.transform(of, lambda x: F.nullif(F.array_position(among, x), F.lit(0)).cast("int")))
    u = _held(u, {f"to{i}": place(F.col(f"p{i}"), F.col("alts")) for i in range(n)} | {f"back{i}": place(F.col("alts"), F.col(f"p{i}")) for i in range(n)})
    u = _held(u, {f"unseen{i}": F.nullif(F.greatest(*[F.coalesce(F.array_position(f"p{i}", x), F.lit(0)) for x in UNSEEN]), F.lit(0)).cast("int") for i in range(n)})
    absent = F.lit(0) if missing_to_ref else F.lit(None).cast("int")
    blank = F.struct(*[(F.struct(F.array(absent, absent).alias("alleles"), F.lit(False).alias("phased")) if k == "GT" else F.lit(None)).cast(t.simpleString()).alias(k) for k, t in fmt.items()])

    def renumbered(i: int) -> Callable[[Column], Column]:
        def one(s: Column) -> Column:
            gt = F.struct(F.transform(s["GT"]["alleles"], lambda x: F.get(f"to{i}", x)).alias("alleles"), s["GT"]["phased"].alias("phased")) if "GT" in fmt else None
            return F.struct(*[(gt if k == "GT" else _remapped(s[k], known.get(k, ""), t, F.col(f"back{i}"), F.col(f"unseen{i}"), (missing or {}).get(k))).cast(t.simpleString()).alias(k) for k, t in fmt.items()])

        return one

    parts = [F.when(F.col(f"s{i}").isNull(), F.array_repeat(blank, size)).otherwise(F.transform(f"s{i}", renumbered(i))) for i, size in enumerate(sizes)]
    u = _held(u, {"samples": F.concat(*parts)})
    values = lambda k, t: F.array(*[_remapped(F.col(f"info_{k}_{i}"), known.get(k, ""), t, F.col(f"back{i}"), F.col(f"unseen{i}")) for i in range(n)])
    fields = {k: reduced(rules.get(k, "first"), values(k, t), t) for k, t in info.items()}
    if "GT" in fmt:
        fresh = {"AN": g.allele_number(F.col("samples")), "AC": F.coalesce(g.allele_counts(F.col("samples"), F.col("alts")), F.transform("alts", lambda _: F.lit(0)))}
        fields |= {k: c.cast(info[k].simpleString()) for k, c in fresh.items() if k in info}
    every = lambda name: F.array_compact(F.array(*[F.col(f"{name}_{i}") for i in range(n)]))
    ids = F.array_distinct(every("id"))
    return u.select(
        "chrom", "contig_idx", "pos", F.array_max(every("end")).alias("end"), F.when(F.size(ids) > 0, F.array_join(ids, ";")).alias("id"), "ref", "alts",
        F.array_max(every("qual")).alias("qual"), merged_filters(every("filters")).alias("filters"), (F.struct(*[c.alias(n) for n, c in fields.items()])).alias("info"), "samples",
    )


def merge(a: DataFrame, b: DataFrame, n_a: int, n_b: int, logic: str = "both", rules: dict[str, str] | None = None, missing_to_ref: bool = False, numbers: dict[str, str] | None = None) -> DataFrame:
    """:func:`merge_all` of two tables."""
    return merge_all([a, b], [n_a, n_b], logic, rules, missing_to_ref, numbers)


# --- local alleles
def localized(df: DataFrame, most: int, numbers: dict[str, str]) -> DataFrame:
    """Sites with many alleles: each sample keeps REF and its ``most`` likeliest ALTs, listed in ``LAA`` (ascending).

    An ALT is as likely as all genotypes with it together, by FORMAT/PL; of equal ones the first stays. FORMAT fields of
    Number A, R and G (``numbers``; PL is one of G) become LA.., such as LPL and LAD, with the values of the kept alleles.
    A sample without PL, or one of another length than that of diploid genotypes, keeps all ALTs and its values.
    """
    n = F.size("alts") + 1
    every = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    alleles = F.sequence(F.lit(0), n - 1)
    pairs = F.flatten(F.transform(alleles, lambda b: F.transform(F.sequence(F.lit(0), b), lambda a: F.struct(a.alias("a"), b.alias("b")))))
    out = _held(df, {"_every": every, "_pairs": pairs})

    def kept(s: Column) -> Column:
        weighed = F.arrays_zip(F.col("_pairs").alias("p"), s["PL"].alias("v"))
        share = lambda k: F.aggregate(weighed, F.lit(0.0), lambda acc, x: acc + F.when(x["v"].isNotNull(), F.pow(F.lit(10.0), -x["v"] / 10) * ((x["p"]["a"] == k).cast("int") + (x["p"]["b"] == k).cast("int"))).otherwise(0.0))
        ranked = F.array_sort(F.transform("_every", lambda k: F.struct((-share(k)).alias("w"), k.alias("k"))))
        usable = (F.size("_every") > most) & s["PL"].isNotNull() & (F.size(s["PL"]) == F.size("_pairs"))
        return F.when(F.coalesce(usable, F.lit(False)), F.array_sort(F.transform(F.slice(ranked, 1, most), lambda x: x["k"]))).otherwise(F.col("_every"))

    fields = df.schema["samples"].dataType.elementType.fields
    out = _held(out, {"_laa": F.transform("samples", kept)})

    def cut(s: Column, laa: Column) -> Column:
        columns = []
        for f in fields:
            of = {"A": al.remap_a, "R": al.remap_r, "G": al.remap_g}.get(numbers.get(f.name, ""))
            all_kept = F.size(laa) == F.size("_every")
            columns.append((F.when(all_kept | s[f.name].isNull(), s[f.name]).otherwise(of(s[f.name], laa)) if of else s[f.name]).alias(f"L{f.name}" if of else f.name))
        return F.struct(laa.alias("LAA"), *columns)

    return out.withColumn("samples", F.zip_with("samples", "_laa", cut)).drop("_every", "_pairs", "_laa")


def delocalized(df: DataFrame, numbers: dict[str, str], missing: dict[str, str | float] | None = None) -> DataFrame:
    """The reverse of :func:`localized`: values of alleles that a sample left out are filled by ``missing`` (see :func:`merge_all`)."""
    fields = df.schema["samples"].dataType.elementType.fields
    none = F.lit(None).cast("int")

    def whole(s: Column) -> Column:
        back = F.concat(F.array(F.lit(0)), F.transform(F.when(F.size("alts") > 0, F.sequence(F.lit(1), F.size("alts"))).otherwise(F.array().cast("array<int>")), lambda k: F.nullif(F.array_position(s["LAA"], k), F.lit(0)).cast("int")))
        columns = []
        for f in fields:
            name = f.name[1:] if f.name.startswith("L") else ""
            columns.append(_remapped(s[f.name], numbers[name], f.dataType, back, none, (missing or {}).get(name)).alias(name) if name in numbers else s[f.name].alias(f.name))
        return F.struct(*[c for c, f in zip(columns, fields, strict=True) if f.name != "LAA"])

    return df.withColumn("samples", F.transform("samples", whole))
