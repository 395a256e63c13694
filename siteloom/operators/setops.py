"""Sets of call sets: intersections by presence pattern, unions, duplicates, phase ligation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import alleles as al
from siteloom.functions import genotype as g


def pair_key(logic: str) -> list[Column]:
    """What two sites have to have in common besides chrom and pos."""
    kinds = al.variant_types(F.col("ref"), F.col("alts"))
    if logic == "none":
        return [F.col("ref"), F.array_join(F.array_sort("alts"), ",")]
    if logic in ("all", "any"):
        return []
    if logic == "id":
        return [F.col("id")]
    snp, indel = F.array_contains(kinds, "snp"), F.array_contains(kinds, "indel")
    rest = F.concat(F.col("ref"), F.lit(">"), F.array_join(F.array_sort("alts"), ","))
    if logic == "snps":
        return [F.when(snp, "snp").otherwise(rest)]
    if logic == "indels":
        return [F.when(indel, "indel").otherwise(rest)]
    if logic == "both":
        return [F.when(snp, "snp").when(indel, "indel").otherwise(rest)]
    if logic == "some":
        raise ValueError("what is common by some allele depends on all tables: see keyed_all")
    raise ValueError(f"no pair logic {logic!r}")


def by_some_allele(tables: list[DataFrame]) -> list[DataFrame]:
    """The tables with ``_key``, equal for sites of one position that share an ALT, directly or through other sites there.

    ALTs are compared without the bases that REF and ALT both end with, so REFs of any length meet. A position's sites are
    a few short rows; a small loop unites those that share an allele, and the wide rows are joined with what it gives.
    """
    from siteloom.operators.views import minimal_allele

    site = lambda t: F.concat_ws("\x1f", "ref", F.array_join("alts", ","))
    rows = [t.select("chrom", "pos", site(t).alias("site"), F.transform("alts", lambda x: minimal_allele(F.col("ref"), x)).alias("a")) for t in tables]
    places = reduce(DataFrame.unionByName, rows).distinct().groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("site", "a"))).alias("s"))

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chrom, pos, site_, key = [], [], [], []
            for c, p, some in zip(*(b.column(x).to_pylist() for x in ("chrom", "pos", "s")), strict=True):
                groups: list[tuple[set, list]] = []
                for x in some:
                    mine = ({*x["a"]} or {x["site"]}, [x["site"]])
                    apart = []
                    for g_ in groups:
                        if g_[0] & mine[0]:
                            mine = (g_[0] | mine[0], g_[1] + mine[1])
                        else:
                            apart.append(g_)
                    groups = [*apart, mine]
                for _, names in groups:
                    for n in names:
                        chrom.append(c)
                        pos.append(p)
                        site_.append(n)
                        key.append(min(names))
            yield pa.RecordBatch.from_arrays([pa.array(chrom, pa.string()), pa.array(pos, b.column("pos").type), pa.array(site_, pa.string()), pa.array(key, pa.string())], names=["chrom", "pos", "_site", "_key"])

    found = places.mapInArrow(united, f"chrom string, pos {tables[0].schema['pos'].dataType.simpleString()}, _site string, _key string")
    return [t.withColumn("_site", site(t)).join(found, ["chrom", "pos", "_site"]).drop("_site") for t in tables]


def keyed(df: DataFrame, logic: str = "none") -> DataFrame:
    """``df`` with ``_key``, and of several sites of one key the first."""
    parts = pair_key(logic)
    out = df.withColumn("_key", F.concat_ws("\x1f", *[F.coalesce(p, F.lit(".")) for p in parts]) if parts else F.lit(""))
    if logic == "none":
        return out
    w = Window.partitionBy("chrom", "pos", "_key").orderBy("ref", F.array_join("alts", ","))
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keyed_all(tables: list[DataFrame], logic: str = "none") -> list[DataFrame]:
    """Every table with ``_key`` by a pair logic, or by some common allele (``some``)."""
    return by_some_allele(tables) if logic == "some" else [keyed(t, logic) for t in tables]


def presence(tables: list[DataFrame], logic: str = "none") -> DataFrame:
    """chrom, pos, _key, tables: places of the tables that have the site, in order. One shuffle of keys, aggregated before it."""
    return _presence(keyed_all(tables, logic))


def _presence(with_keys: list[DataFrame]) -> DataFrame:
    tagged = [t.select("chrom", "pos", "_key", F.lit(i).alias("t")) for i, t in enumerate(with_keys)]
    return reduce(DataFrame.unionByName, tagged).groupBy("chrom", "pos", "_key").agg(F.array_sort(F.collect_set("t")).alias("tables"))


def pattern_test(pattern: str, n: int) -> Column:
    """``=k``, ``+k``, ``-k`` files, or ``~0101`` exactly these."""
    count = F.size("tables")
    if pattern.startswith("~"):
        return F.col("tables") == F.array(*[F.lit(i) for i, c in enumerate(pattern[1:]) if c == "1"]).cast("array<int>")
    k = int(pattern[1:] if pattern[0] in "=+-" else pattern)
    return count >= k if pattern[0] == "+" else count <= k if pattern[0] == "-" else count == k


def intersect(tables: list[DataFrame], pattern: str = "=2", write: int = 0, logic: str = "none") -> DataFrame:
    """Sites of table ``write`` whose presence over all tables fits the pattern."""
    with_keys = keyed_all(tables, logic)
    fit = _presence(with_keys).where(pattern_test(pattern, len(tables))).select("chrom", "pos", "_key")
    return with_keys[write].join(fit, ["chrom", "pos", "_key"], "left_semi").drop("_key")


def complement(tables: list[DataFrame], logic: str = "none") -> DataFrame:
    """Sites of the first table that no other has."""
    first, *rest = keyed_all(tables, logic)
    others = reduce(DataFrame.unionByName, [t.select("chrom", "pos", "_key") for t in rest])
    return first.join(others, ["chrom", "pos", "_key"], "left_anti").drop("_key")


def venn(a: DataFrame, b: DataFrame, logic: str = "none") -> dict[str, DataFrame]:
    """Only in a, only in b, shared as in a, shared as in b."""
    ka, kb = keyed_all([a, b], logic)
    on = ["chrom", "pos", "_key"]
    return {"only_a": ka.join(kb, on, "left_anti").drop("_key"), "only_b": kb.join(ka, on, "left_anti").drop("_key"), "shared_a": ka.join(kb, on, "left_semi").drop("_key"), "shared_b": kb.join(ka, on, "left_semi").drop("_key")}


def write_venn(a: DataFrame, b: DataFrame, path: str, logic: str = "none") -> None:
    for k, (_, df) in enumerate(venn(a, b, logic).items()):
        df.write.parquet(f"{path}/{k:04d}")


def concat(tables: list[DataFrame], duplicates: str | None = None) -> DataFrame:
    """All rows of tables with the same samples; ``duplicates``: the first table's site wins for a pair key."""
    if duplicates is None:
        return reduce(DataFrame.unionByName, tables)
    tagged = [t.withColumn("_src", F.lit(i)) for i, t in enumerate(tables)]
    parts = pair_key(duplicates)
    u = reduce(DataFrame.unionByName, tagged).withColumn("_key", F.concat_ws("\x1f", *[F.coalesce(p, F.lit(".")) for p in parts]) if parts else F.lit(""))
    w = Window.partitionBy("chrom", "pos", "_key").orderBy("_src", "ref", F.array_join("alts", ","))
    return u.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_key", "_src")


def sort(df: DataFrame) -> DataFrame:
    """By header order of contigs, position, REF and ALTs; ranges are dealt out and sorted in place."""
    keys = ["contig_idx", "pos", "ref", F.array_join("alts", ",")]
    return df.orderBy(*keys)


def without_duplicates(df: DataFrame, logic: str = "none") -> DataFrame:
    """The first site of each pair key."""
    return concat([df], logic)


def ligate_votes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per sample: same and opposite phase over the shared sites' phased heterozygotes, whether to swap, and PQ."""
    on = ["chrom", "pos", "ref"]
    j = a.select(*on, F.col("samples").alias("x")).join(b.select(*on, F.col("samples").alias("y")), on)
    long = j.select(F.posexplode(F.arrays_zip("x", "y")).alias("sample", "p"))
    x, y = F.col("p.x.GT"), F.col("p.y.GT")
    votes = long.where(g.is_het(x) & g.is_het(y) & x["phased"] & y["phased"] & (F.size(x["alleles"]) == 2))
    votes = votes.where(F.array_sort(x["alleles"]) == F.array_sort(y["alleles"]))
    out = votes.groupBy("sample").agg(F.count_if(x["alleles"] == y["alleles"]).alias("n_same"), F.count_if(x["alleles"] != y["alleles"]).alias("n_opposite"))
    f = F.col("n_same") / (F.col("n_same") + F.col("n_opposite"))
    f = F.greatest(f, 1 - f)
    pq = F.when((F.col("n_same") == 0) | (F.col("n_opposite") == 0), 99.0).otherwise(99 * (0.7 + f * F.ln(f) + (1 - f) * F.ln(1 - f)) / 0.7)
    return out.withColumn("swap", F.col("n_opposite") > F.col("n_same")).withColumn("pq", pq)


def ligate(a: DataFrame, b: DataFrame, samples: int, least_pq: float = 30.0) -> DataFrame:
    """``a`` and ``b`` as one phased table: the overlap's first half from a, the second from b, b's samples swapped by vote.

    Samples are swapped where most votes say so; a PQ below ``least_pq`` starts a new phase set, at b's first site.
    """
    votes = ligate_votes(a, b).agg(F.map_from_entries(F.collect_list(F.struct("sample", F.struct("swap", "pq")))).alias("m"))  # a row for each sample
    bounds = a.join(b.select("chrom", "pos"), ["chrom", "pos"], "left_semi").groupBy("chrom").agg(((F.min("pos") + F.max("pos")) / 2).alias("_mid"), F.min("pos").alias("_from"))
    flip = lambda gt: F.struct(F.reverse(gt["alleles"]).alias("alleles"), gt["phased"].alias("phased"))
    swapped = b.crossJoin(F.broadcast(votes)).withColumn("samples", F.transform("samples", lambda s, i: s.withField("GT", F.when(F.coalesce(F.try_element_at("m", i)["swap"], F.lit(False)) & s["GT"]["phased"], flip(s["GT"])).otherwise(s["GT"]))))
    swapped = swapped.withColumn("new_set", F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.coalesce(F.try_element_at("m", i)["pq"] < least_pq, F.lit(True)))).drop("m")
    left = a.join(F.broadcast(bounds), "chrom", "left").where(F.col("_mid").isNull() | (F.col("pos") <= F.col("_mid"))).drop("_mid", "_from").withColumn("new_set", F.transform("samples", lambda _: F.lit(False)))
    right = swapped.join(F.broadcast(bounds), "chrom", "left").where(F.col("_mid").isNull() | (F.col("pos") > F.col("_mid"))).drop("_mid", "_from")
    return left.unionByName(right)
