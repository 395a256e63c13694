"""Position-indexed tables, lists of files, and text reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.operators.ranges import overlap_join

#: A partition of the finest level holds 2**BIN bases of a contig, one of the next level eight times as many.
BIN, LEVELS, STEP = 20, 6, 3


def _last() -> Column:
    return F.greatest("pos", F.coalesce("end", "pos"))


def write_indexed(df: DataFrame, path: str) -> None:
    """A table partitioned by contig, level and bin of positions, sorted inside, so that region scans read few files and row groups.

    A site is written once: to the finest level at which it lies in one bin, so long sites are in few wide bins.
    """
    level = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        level = F.when(F.shiftright(F.col("pos"), BIN + STEP * k) == F.shiftright(_last(), BIN + STEP * k), k).otherwise(level)
    # names such as 1 would come back as numbers
    bins = df.withColumn("contig", F.concat(F.lit("contig-"), "chrom")).withColumn("level", level)
    bins = bins.withColumn("bin", F.floor(F.col("pos") / F.element_at(F.array(*[F.lit(1 << (BIN + STEP * k)) for k in range(LEVELS)]), F.col("level") + 1)).cast("int"))
    keys = ["contig", "level", "bin"]
    bins.repartition(*keys).sortWithinPartitions(*keys, "pos").write.partitionBy(*keys).parquet(path)


def read_regions(spark: SparkSession, path: str, regions: list[tuple[str, int, int]]) -> DataFrame:
    """Sites of an indexed table that overlap any of a few regions (contig, begin, end), each site once.

    The regions become predicates on the partitions and on ``pos``, which the scan prunes by.
    """
    df = spark.read.parquet(path)
    if not regions:
        return df.where("false").drop("contig", "level", "bin")

    def bins(b: int, e: int) -> Column:
        # the last level also has sites that reach over its bins
        each = [(F.col("level") == k) & F.col("bin").between(0 if k == LEVELS - 1 else max(0, b) >> (BIN + STEP * k), max(0, e) >> (BIN + STEP * k)) for k in range(LEVELS)]
        return reduce(lambda x, y: x | y, each)

    one = [(F.col("contig") == f"contig-{c}") & bins(b, e) & (F.col("pos") <= e) & (_last() >= b) for c, b, e in regions]
    # the bound of positions apart, as the scan's filter
    return df.where(F.col("pos") <= max(e for _, _, e in regions)).where(reduce(lambda x, y: x | y, one)).drop("contig", "level", "bin")


def read_region_table(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """The same for any number of regions (chrom, beg, end): partitions are pruned by a join on (contig, level, bin) while it runs."""

    def bins(k: int) -> Column:
        beg, end = (F.shiftright(F.greatest(F.col(c), F.lit(0)).cast("long"), BIN + STEP * k) for c in ("beg", "end"))
        # the last level also has sites that reach over its bins
        return F.transform(F.sequence(F.lit(0).cast("long") if k == LEVELS - 1 else beg, end), lambda x: F.struct(F.lit(k).alias("level"), x.cast("int").alias("bin")))

    each = [bins(k) for k in range(LEVELS)]
    touched = regions.select(F.concat(F.lit("contig-"), "chrom").alias("contig"), F.explode(F.flatten(F.array(*each))).alias("t")).select("contig", "t.*").distinct()
    df = spark.read.parquet(path).join(touched, ["contig", "level", "bin"], "left_semi").drop("contig", "level", "bin")
    return overlap_join(df.withColumn("_last", _last()), regions, ("chrom", "pos", "_last"), how="semi").drop("_last")


def read_listed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all Parquet tables that a text file names, one a line (``#`` starts a comment)."""
    names = [r[0].strip() for r in spark.read.text(path).collect()]
    return spark.read.option("mergeSchema", "true").parquet(*[n for n in names if n and not n.startswith("#")])


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Small tables as one folder of text: a header line and tab-separated rows that start with the section's name.

    Rows are in the order of their columns, numbers as numbers.
    """
    lines = []
    for i, (name, df) in enumerate(sections.items()):
        text = F.concat_ws("\t", F.lit(name), *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in df.columns])
        head = df.sparkSession.range(1).select(F.lit(i).alias("section"), F.lit(0).alias("kind"), F.lit(0).alias("at"), F.lit("# " + "\t".join([name, *df.columns])).alias("line"))
        lines.append(head.unionByName(df.select(F.lit(i).alias("section"), F.lit(1).alias("kind"), F.row_number().over(Window.orderBy(*[F.col(f"`{c}`") for c in df.columns])).alias("at"), text.alias("line"))))
    reduce(DataFrame.unionByName, lines).orderBy("section", "kind", "at").select("line").write.text(path)


def haplotype_files(df: DataFrame) -> dict[str, DataFrame]:
    """``legend`` (id, position, a0, a1) and ``hap`` (the haplotypes as text) of sites with two alleles, in one order."""
    two = df.where(F.size("alts") == 1)
    of = lambda a, phased: F.when(a.isNull(), "?").otherwise(F.concat(a.cast("string"), F.when(phased, "").otherwise("*")))
    one = lambda s: F.array_join(F.transform(s["GT"]["alleles"], lambda a: of(a, s["GT"]["phased"])), " ")
    name = F.concat_ws("_", F.concat("chrom", F.lit(":"), F.col("pos").cast("string")), "ref", F.get("alts", F.lit(0)))
    keys = ["contig_idx", "pos", "ref"]
    return {
        "legend": two.orderBy(*keys).select(name.alias("id"), F.col("pos").alias("position"), F.col("ref").alias("a0"), F.get("alts", F.lit(0)).alias("a1")),
        "hap": two.orderBy(*keys).select(name.alias("id"), F.array_join(F.transform("samples", one), " ").alias("haplotypes")),
    }
