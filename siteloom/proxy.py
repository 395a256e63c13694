"""Variant tables made of star-schema tables, so that every operator runs on tables without genomic files.

A site is an order: contig = order status, position = order key, quality from the total price. The order's line numbers
1..7 are the samples; lines of one number are summed. The genotype is the quantity modulo 3 (missing where the quantity
is divisible by 7), phased where the extended price is even.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_SAMPLES = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (order, line number): quantity (whole), price, dosage (null: missing), flag of the call set."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("l_quantity").cast("long").alias("qty"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("price"), (F.max("l_suppkey") % 2).cast("int").alias("half")
    )
    return lines.withColumn("dosage", F.when(F.col("qty") % 7 != 0, (F.col("qty") % 3).cast("int")))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant table. The aggregation to one array a site is the only shuffle besides the join with orders."""
    calls = calls_long(spark, sf_dir).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", F.struct("qty", "price", "dosage")))).alias("m"))
    genotype = lambda c: F.struct(
        F.when(c.isNull(), F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))).when(c["dosage"].isNull(), F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))).when(c["dosage"] == 0, F.array(F.lit(0), F.lit(0))).when(c["dosage"] == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(1))).alias("alleles"),
        F.coalesce(c["price"] % 2 == 0, F.lit(False)).alias("phased"),
    )
    samples = F.transform(F.sequence(F.lit(1), F.lit(N_SAMPLES)), lambda i: F.struct(
        genotype(F.try_element_at(F.col("m"), i)).alias("GT"), F.try_element_at(F.col("m"), i)["qty"].cast("int").alias("DP"), F.array(F.try_element_at(F.col("m"), i)["qty"].cast("int"), F.pmod(F.try_element_at(F.col("m"), i)["price"], F.lit(97)).cast("int")).alias("AD")))
    orders = table(spark, sf_dir, "orders")
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    key = F.col("o_orderkey")
    ref = F.get(bases, (key % 4).cast("int"))
    alt = F.when(key % 11 == 0, F.concat(ref, F.get(bases, (key % 3).cast("int")))).when(key % 13 == 0, F.lit("<DEL>")).otherwise(F.get(bases, ((key + 1 + F.floor(key / 4) % 3) % 4).cast("int")))
    return (
        orders.join(calls, key == F.col("l_orderkey"))
        .select(
            F.col("o_orderstatus").alias("chrom"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("contig_idx"), key.alias("pos"), (key + F.length(ref) - 1).alias("end"),
            F.when(key % 5 == 0, F.concat(F.lit("rs"), key)).alias("id"), ref.alias("ref"), F.array(alt).alias("alts"), (F.col("o_totalprice") / 1000).cast("float").alias("qual"),
            F.when(key % 3 == 0, F.array(F.lit("PASS"))).when(key % 3 == 1, F.array(F.lit("q10"), F.lit("s50"))).otherwise(F.array().cast("array<string>")).alias("filters"),
            F.struct(F.col("o_custkey").cast("int").alias("DP"), F.array((F.col("o_totalprice") / 100000).cast("float")).alias("MQ"), F.col("o_orderpriority").alias("PRIO")).alias("info"), samples.alias("samples"),
        )
    )


#: The same tables for the SQL oracles: ``s`` (a row a site) and ``c`` (a row a site and sample).
SQL = """
WITH l AS (SELECT l_orderkey, l_linenumber, sum(l_quantity)::BIGINT AS qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS price, (max(l_suppkey) % 2)::INT AS half FROM lineitem GROUP BY 1, 2),
s0 AS (SELECT o_orderstatus AS chrom, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS contig_idx, o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 0 THEN 'rs' || o_orderkey END AS id, ['A', 'C', 'G', 'T'][o_orderkey % 4 + 1] AS ref,
  (o_totalprice / 1000)::FLOAT AS qual, o_custkey::INT AS dp, o_orderpriority AS prio, o_totalprice, o_orderdate, CASE o_orderkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'q10;s50' ELSE '.' END AS filter
  FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM l)),
s AS (SELECT *, CASE WHEN pos % 11 = 0 THEN ref || ['A', 'C', 'G', 'T'][pos % 3 + 1] WHEN pos % 13 = 0 THEN '<DEL>' ELSE ['A', 'C', 'G', 'T'][(pos + 1 + (pos // 4) % 3) % 4 + 1] END AS alt FROM s0),
c AS (SELECT s.*, i::INT AS sample, qty, price, CASE WHEN qty % 7 <> 0 THEN (qty % 3)::INT END AS dosage, coalesce(price % 2 = 0, false) AS phased FROM s CROSS JOIN range(1, 8) AS t(i) LEFT JOIN l ON l_orderkey = pos AND l_linenumber = i)
"""
