"""Side tables: intervals, named-column text, sequences, gene models, pedigrees; and sinks by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, beg, end), 1-based and inclusive. A ``.bed`` file is 0-based and half-open; two columns are positions."""
    f = F.split("value", "\t")
    t = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    bed = path.rstrip("/").removesuffix(".gz").endswith(".bed")
    beg = F.get(f, F.lit(1)).cast("long") + (1 if bed else 0)
    return t.select(F.get(f, F.lit(0)).alias("chrom"), beg.alias("beg"), F.coalesce(F.get(f, F.lit(2)).try_cast("long"), beg).alias("end"))


def parse_regions(spark: SparkSession, text: str) -> DataFrame:
    """``chr``, ``chr:pos``, ``chr:beg-`` and ``chr:beg-end``, by commas."""
    rows = []
    for part in text.split(","):
        chrom, _, where = part.rpartition(":") if ":" in part else (part, "", "")
        lo, dash, hi = where.partition("-")
        rows.append((chrom, int(lo or 1), int(hi) if hi else (1 << 40) if dash or not where else int(lo)))
    return spark.createDataFrame(rows, "chrom string, beg long, end long")


def read_named(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text with named columns; ``-`` skips one, ``.`` is missing."""
    f = F.split("value", "\t")
    t = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    out = t.select(*[F.nullif(F.get(f, F.lit(i)), F.lit(".")).alias(c) for i, c in enumerate(columns) if c != "-"])
    for c in out.columns:
        if c in ("POS", "BEG", "END"):
            out = out.withColumn(c, F.col(c).cast("long"))
    return out


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq). Files are split at the record mark, so records are read side by side."""
    t = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    return t.select(F.regexp_extract("value", r"^(\S+)", 1).alias("chrom"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")).alias("seq"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    t = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(f) >= 9))
    g = lambda i: F.get(f, F.lit(i))
    attr = lambda k: F.nullif(F.regexp_extract(g(8), rf"(?:^|;){k}=([^;]*)", 1), F.lit(""))
    return t.select(g(0).alias("chrom"), g(1).alias("source"), g(2).alias("type"), g(3).cast("long").alias("beg"), g(4).cast("long").alias("end"), g(6).alias("strand"), g(7).try_cast("int").alias("phase"), attr("ID").alias("id"), attr("Parent").alias("parent"), attr("biotype").alias("biotype"), attr("Name").alias("name"))


def coding_sequences(gff: DataFrame, fasta: DataFrame) -> DataFrame:
    """The table that consequences need: coding parts with their offset and the transcript's coding sequence."""
    parts = gff.where("type = 'CDS'").select("chrom", "beg", "end", "strand", F.col("parent").alias("transcript"))
    w = Window.partitionBy("transcript").orderBy(F.when(F.col("strand") == "-", -F.col("beg")).otherwise(F.col("beg")))
    parts = parts.withColumn("offset", F.coalesce(F.sum(F.col("end") - F.col("beg") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seq = parts.join(fasta.withColumnRenamed("seq", "_c"), "chrom").withColumn("_s", F.substr("_c", F.col("beg").cast("int"), (F.col("end") - F.col("beg") + 1).cast("int")))
    seq = seq.withColumn("_s", F.when(F.col("strand") == "-", F.reverse(F.translate("_s", "ACGT", "TGCA"))).otherwise(F.col("_s")))
    whole = seq.groupBy("transcript").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "_s"))), lambda x: x["_s"]), "").alias("seq"))
    return parts.join(whole, "transcript")


def read_pedigree(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where(F.trim("value") != "")
    names = ("family", "child", "father", "mother", "sex", "phenotype", "population")
    return t.select(*[F.nullif(F.get(f, F.lit(i)), F.lit("0")).alias(n) for i, n in enumerate(names)])


def from_chip(df: DataFrame, bases: DataFrame) -> DataFrame:
    """Sites from rows (ID, CHROM, POS, AA) and reference bases (chrom, pos, base): ALTs are the alleles that differ."""
    j = df.join(bases, (F.col("CHROM") == F.col("chrom")) & (F.col("POS") == F.col("pos"))).withColumn("_a", F.split(F.upper("AA"), ""))
    j = j.withColumn("_a", F.filter("_a", lambda x: x.isin("A", "C", "G", "T"))).where(F.size("_a") > 0)
    alts = F.array_sort(F.array_distinct(F.filter("_a", lambda x: x != F.upper("base"))))
    j = j.withColumn("alts", alts)
    number = lambda x: F.when(x == F.upper("base"), 0).otherwise(F.array_position("alts", x).cast("int"))
    return j.select("chrom", "pos", F.col("ID").alias("id"), F.upper("base").alias("ref"), "alts", F.array(F.struct(F.struct(F.transform("_a", number).alias("alleles"), F.lit(False).alias("phased")).alias("GT"))).alias("samples"))


def to_probabilities(df: DataFrame) -> DataFrame:
    """chrom, pos, id, ref, alt and three probabilities a sample from its genotype."""
    from siteloom.functions.genotype import dosage

    one = lambda s: F.when(dosage(s["GT"]).isNull(), F.array(*[F.lit(1 / 3)] * 3)).otherwise(F.transform(F.array(*[F.lit(k) for k in range(3)]), lambda k: (dosage(s["GT"]) == k).cast("double")))
    return df.select("chrom", "pos", F.coalesce("id", F.concat("chrom", F.lit(":"), F.col("pos").cast("string"))).alias("id"), "ref", F.get("alts", F.lit(0)).alias("alt"), F.flatten(F.transform("samples", one)).alias("probabilities"))


def to_haplotypes(df: DataFrame) -> DataFrame:
    """chrom, pos, id, ref, alt and the haplotypes as text: ``0 1``, ``*`` after alleles that aren't phased, ``?`` if missing."""
    one = lambda s: F.array_join(F.transform(s["GT"]["alleles"], lambda a: F.when(a.isNull(), "?").otherwise(F.concat(a.cast("string"), F.when(s["GT"]["phased"], "").otherwise("*")))), " ")
    return df.select("chrom", "pos", F.coalesce("id", F.concat("chrom", F.lit(":"), F.col("pos").cast("string"))).alias("id"), "ref", F.get("alts", F.lit(0)).alias("alt"), F.array_join(F.transform("samples", one), " ").alias("haplotypes"))


def write_by_samples(df: DataFrame, groups: dict[str, list[int]], path: str) -> None:
    """A folder for each group of samples, in one pass over the table."""
    g = F.array(*[F.struct(F.lit(k).alias("name"), F.array(*[F.lit(i) for i in v]).alias("at")) for k, v in groups.items()])
    out = df.withColumn("_g", F.explode(g)).withColumn("samples", F.transform("_g.at", lambda i: F.get("samples", i))).withColumn("subset", F.col("_g.name")).drop("_g")
    out.write.partitionBy("subset").parquet(path)


def write_scattered(df: DataFrame, n: int, path: str) -> None:
    """Chunks of ``n`` sites in the order of the table, a folder each; numbered within the contig."""
    from siteloom.operators.carried import RANGE, carried, ranged

    t = carried(ranged(df, ["chrom"], ["pos", "ref"]), ["chrom"], ["pos", "ref"], sums={"_n": F.lit(1)})
    t.withColumn("chunk", F.floor((F.col("_n") - 1) / n)).drop("_n", RANGE).write.partitionBy("chrom", "chunk").parquet(path)
