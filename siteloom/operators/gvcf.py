"""Merging tables of which some rows are blocks: runs of positions that a sample shows to be like the reference.

Blocks of several tables are cut at each other's borders and at sites. The borders of all tables are *points*; between two
points of a contig nothing begins or ends, and such a piece becomes a row if some table has a block there.

The sweep over points needs, at each point, the block that each table has open. Points (narrow rows, one for each distinct
border) are range-partitioned by position. Inside a partition a running maximum of (begin, end) is the block that began
last; what is open at the partition's first point comes from a table with a row for each partition and contig, which is
summed by a window and broadcast. So a contig is many tasks, a block reaches over any number of partitions, and the
result doesn't depend on their number. Wide columns meet the pieces last, by an equi-join on the block's position.

Defined results: of blocks of one table that overlap, the one that began last counts; a table's own site wins over its
block; null ends are the position; repeated blocks count once; a block of one position is a site. Empty tables give what
the others give.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.operators.merge import UNSEEN, _class_key, merge_all
from siteloom.sources.shared import stored


def is_block() -> Column:
    """Whether a row stands for more positions than its REF has, without an allele of its own."""
    alts = F.coalesce("alts", F.array().cast("array<string>"))
    plain = (F.size(alts) == 0) | F.exists(alts, lambda a: a.isin(*UNSEEN))
    length = F.coalesce("end", "pos") - F.col("pos") + 1
    return F.coalesce(plain & (length > 1) & (F.length("ref") != length), F.lit(False))


def pieces(blocks: list[DataFrame], sites: DataFrame) -> DataFrame:
    """chrom, contig_idx, at, until and ``open``, an array of (t, pos, base): the blocks that cover at..until.

    ``blocks``: chrom, contig_idx, pos, end, base of each table; ``sites``: chrom, contig_idx, pos at which blocks are cut.
    """
    n = len(blocks)
    tagged = reduce(DataFrame.unionByName, [b.select("chrom", "contig_idx", "pos", "end", "base", F.lit(i).alias("t")) for i, b in enumerate(blocks)])
    keys = ["contig_idx", "chrom", "at"]
    here = F.struct("pos", "end", "base")
    none = F.lit(None).cast("int")
    begins = tagged.select("contig_idx", "chrom", F.col("pos").alias("at"), "t", here.alias("b"))
    ends = tagged.select("contig_idx", "chrom", (F.col("end") + 1).alias("at"), none.alias("t"), F.lit(None).cast(begins.schema["b"].dataType).alias("b"))
    cuts = sites.select("contig_idx", "chrom", F.explode(F.array("pos", F.col("pos") + 1)).alias("at"), none.alias("t"), F.lit(None).cast(begins.schema["b"].dataType).alias("b"))
    points = begins.unionByName(ends).unionByName(cuts).groupBy(*keys).agg(*[F.max(F.when(F.col("t") == i, F.col("b"))).alias(f"b{i}") for i in range(n)])
    points = stored(points.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "points")

    # a row for each partition and contig: what it leaves open, and where it begins
    border = points.groupBy("contig_idx", "chrom", "_part").agg(F.min("at").alias("_first"), *[F.max(f"b{i}").alias(f"_m{i}") for i in range(n)])
    by_contig = Window.partitionBy("contig_idx", "chrom").orderBy("_part")
    before = by_contig.rowsBetween(Window.unboundedPreceding, -1)
    border = border.select("contig_idx", "chrom", "_part", F.lead("_first").over(by_contig).alias("_next"), *[F.max(f"_m{i}").over(before).alias(f"_c{i}") for i in range(n)])
    within = Window.partitionBy("_part", "contig_idx", "chrom").orderBy("at")
    p = points.withColumn("_lead", F.lead("at").over(within)).withColumns({f"b{i}": F.max(f"b{i}").over(within) for i in range(n)})
    p = p.join(F.broadcast(border), (p["_part"] == border["_part"]) & p["chrom"].eqNullSafe(border["chrom"]) & p["contig_idx"].eqNullSafe(border["contig_idx"])).select(
        p["chrom"], p["contig_idx"], "at", (F.coalesce("_lead", "_next") - 1).alias("until"), *[F.greatest(f"b{i}", f"_c{i}").alias(f"b{i}") for i in range(n)])
    one = lambda i: F.when(F.col(f"b{i}.end") >= F.col("at"), F.struct(F.lit(i).alias("t"), F.col(f"b{i}.pos").alias("pos"), F.col(f"b{i}.base").alias("base")))
    return p.select("chrom", "contig_idx", "at", "until", F.array_compact(F.array(*[one(i) for i in range(n)])).alias("open")).where(F.size("open") > 0)


def merge_blocks(tables: list[DataFrame], sizes: list[int], logic: str = "both", rules: dict[str, str] | None = None, numbers: dict[str, str] | None = None, bases: DataFrame | None = None, missing: dict[str, str | float] | None = None) -> DataFrame:
    """Tables of sites and blocks side by side (:func:`siteloom.operators.merge.merge_all` tells how rows become one).

    At a site of any table the blocks of the others take part with their values. REF of a piece is the base of a block
    that begins there, else that of ``bases`` (chrom, pos, base), else N. ``missing``: by default PL is filled by its
    largest value and AD by 0 for alleles that a table neither knows nor has an unseen allele for.
    """
    marked = [t.withColumn("end", F.coalesce("end", "pos").cast("long")).withColumn("_block", is_block()) for t in tables]
    blocks = [t.where("_block").dropDuplicates(["chrom", "pos"]) for t in marked]
    sites = [t.where("not _block").withColumn("_k", _class_key(logic)) for t in marked]
    first = F.upper(F.substr("ref", F.lit(1), F.lit(1)))
    places = reduce(DataFrame.unionByName, [s.select("chrom", "contig_idx", F.col("pos").alias("at"), "_k", first.alias("_site_base"), F.lit(i).alias("t")) for i, s in enumerate(sites)])
    places = places.groupBy("chrom", "contig_idx", "at").agg(F.collect_set("_k").alias("_keys"), F.min("_site_base").alias("_site_base"), F.collect_set("t").alias("_own"))
    cut = pieces([b.withColumn("base", first) for b in blocks], places.select("chrom", "contig_idx", F.col("at").alias("pos")))
    met = cut.join(places, ["chrom", "contig_idx", "at"], "left")
    began = F.get(F.filter("open", lambda o: o["pos"] == F.col("at")), F.lit(0))["base"]
    if bases is not None:
        met = met.join(bases.select("chrom", F.col("pos").alias("at"), F.upper("base").alias("_base")), ["chrom", "at"], "left")
    base = F.coalesce("_site_base", began, *(["_base"] if bases is not None else []), F.lit("N"))
    met = met.withColumn("base", base).withColumn("_o", F.explode("open")).where(F.col("_own").isNull() | ~F.array_contains("_own", F.col("_o.t")))
    met = stored(met.select("chrom", "at", "until", "base", F.col("_o.t").alias("t"), F.col("_o.pos").alias("pos"), F.explode(F.coalesce("_keys", F.array(F.lit("")))).alias("_k")), "pieces")
    sides = []
    for i, (b, s) in enumerate(zip(blocks, sites, strict=True)):
        mine = met.where(F.col("t") == i).drop("t")
        c = b.drop("_block", "end", "ref").join(mine, ["chrom", "pos"]).drop("pos").withColumnsRenamed({"at": "pos", "until": "end", "base": "ref"})
        sides.append(s.drop("_block").unionByName(c.select(*[x for x in s.columns if x != "_block"])))
    return merge_all(sides, sizes, logic, rules, numbers=numbers, key="_k", missing={"PL": "max", "AD": 0} if missing is None else missing)
