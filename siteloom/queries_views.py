"""Registered queries of the ordered view, of pairing by alleles, of strands, rank tests and frequencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom import proxy
from siteloom.functions import genotype as g
from siteloom.operators import select, views
from siteloom.queries import TYPE, by_contig, query
from siteloom.sources import indexed
from siteloom.sources.shared import shared_path

_SUB = "(SELECT pos, count(dosage) * 2 AS an3, coalesce(sum(dosage), 0) AS ac3 FROM c WHERE sample <= 3 GROUP BY pos)"


@query(f"SELECT pos, ac3::INT AS ac, an3::INT AS an FROM s JOIN {_SUB} USING (pos) WHERE {TYPE} = 'snp' AND qual > 50 AND ac3 >= 2")
def view_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site tests, then samples, then counts of what is left."""
    out = views.view(proxy.sites(spark, sf_dir), types=["snp"], where="QUAL>50", samples=[0, 1, 2], least_ac=2)
    return out.select("pos", F.get("info.AC", F.lit(0)).alias("ac"), F.col("info.AN").alias("an"))


@query(
    ", t AS (SELECT pos, ref, alt, list({'d': CASE WHEN dosage = 2 AND pos % 2 = 0 THEN 3 ELSE dosage END, 'q': qty, 'p': price % 97} ORDER BY sample) AS x FROM c WHERE sample <= 3 GROUP BY ALL), "
    "u AS (SELECT pos, ref, alt, x, len(list_filter(x, lambda y: y.d IN (1, 2))) > 0 AS a1, len(list_filter(x, lambda y: y.d = 3)) > 0 AS a2 FROM t) "
    "SELECT pos, CASE WHEN a1 THEN alt ELSE '' END || CASE WHEN a1 AND a2 THEN ',' ELSE '' END || CASE WHEN a2 THEN 'TTT' ELSE '' END AS alts, "
    "array_to_string(list_transform(x, lambda y: coalesce(y.q::VARCHAR, '.') || CASE WHEN a1 THEN ',' || coalesce(y.p::VARCHAR, '.') ELSE '' END || CASE WHEN a2 THEN ',' || coalesce((y.q + 1)::VARCHAR, '.') ELSE '' END), ' ') AS ad, "
    "array_to_string(list_transform(x, lambda y: CASE y.d WHEN 0 THEN '0/0' WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' WHEN 3 THEN CASE WHEN a1 THEN '2/2' ELSE '1/1' END ELSE './.' END), ' ') AS gt FROM u"
)
def view_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ALTs, of which homozygotes at even positions have the second; what three samples carry stays, with its depths."""
    second = lambda s: F.when((F.col("pos") % 2 == 0) & (g.dosage(s["GT"]) == 2), F.transform(s["GT"]["alleles"], lambda _: F.lit(2))).otherwise(s["GT"]["alleles"])
    depths = lambda s: F.concat(s["AD"], F.array(s["DP"] + 1))
    s = proxy.sites(spark, sf_dir)
    s = s.withColumn("alts", F.concat("alts", F.array(F.lit("TTT")))).withColumn("samples", F.transform("samples", lambda x: x.withField("AD", depths(x)).withField("GT", F.struct(second(x).alias("alleles"), x["GT"]["phased"].alias("phased")))))
    out = views.view(s, samples=[0, 1, 2], trim_alts=True, numbers={"AD": "R"})
    text = lambda x, sep: F.array_join(F.transform(x, lambda v: F.coalesce(v.cast("string"), F.lit("."))), sep)
    return out.select("pos", F.array_join("alts", ",").alias("alts"), F.array_join(F.transform("samples", lambda x: text(x["AD"], ",")), " ").alias("ad"), F.array_join(F.transform("samples", lambda x: text(x["GT"]["alleles"], "/")), " ").alias("gt"))


@query(f"SELECT chrom, count(*) AS n_sites, sum(pos)::BIGINT AS sum_pos FROM s WHERE {TYPE} = 'snp' AND EXISTS (SELECT 1 FROM s x WHERE x.chrom = s.chrom AND (x.alt = '<DEL>' OR len(x.alt) = 2) AND x.pos <= s.pos + 3 AND s.pos <= (CASE WHEN x.alt = '<DEL>' THEN x.pos + 9 ELSE x.pos END) + 3) GROUP BY chrom")
def snp_gap_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbolic deletions reach nine bases further, by their END."""
    s = proxy.sites(spark, sf_dir).withColumn("end", F.when(F.get("alts", F.lit(0)) == "<DEL>", F.col("pos") + 9).otherwise(F.col("end")))
    return by_contig(select.snp_gap(s, 3).where(F.array_contains("filters", "SnpGap")))


_LONG = "CASE WHEN pos % 50 = 0 THEN pos * 700 + 5000000 ELSE pos * 700 + pos % 3 END"


@query(f"SELECT chrom, r, count(*) AS n_sites, sum(pos)::BIGINT AS sum_pos FROM s JOIN (VALUES ('O', 2999990, 3000010, 1), ('F', 1048570, 1048580, 2), ('O', 5000000, 9000000, 3)) v(c, b, e, r) ON chrom = c AND pos * 700 <= e AND {_LONG} >= b GROUP BY ALL")
def indexed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table is written by bins of positions; region scans find sites of five million bases too."""
    s = proxy.sites(spark, sf_dir).select("chrom", "pos", F.expr(_LONG).alias("end")).withColumn("at", F.col("pos")).withColumn("pos", F.col("pos") * 700)
    path = shared_path(spark, "index")
    indexed.write_indexed(s, path)
    regions = [("O", 2_999_990, 3_000_010), ("F", 1_048_570, 1_048_580), ("O", 5_000_000, 9_000_000)]
    found = [indexed.read_regions(spark, path, [r]).select("chrom", F.lit(i + 1).alias("r"), "at") for i, r in enumerate(regions)]
    return reduce(DataFrame.unionByName, found).groupBy("chrom", "r").agg(F.count(F.lit(1)).alias("n_sites"), F.sum("at").alias("sum_pos"))


@query("SELECT chrom, pos, ref FROM s ORDER BY contig_idx, pos LIMIT 100")
def head_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.head(proxy.sites(spark, sf_dir), 100).select("chrom", "pos", "ref")


@query(f"SELECT chrom, kind, count(*) AS n, (CASE WHEN grouping(chrom) = 1 THEN 2 ELSE 0 END + CASE WHEN grouping(kind) = 1 THEN 1 ELSE 0 END)::BIGINT AS level FROM (SELECT chrom, {TYPE} AS kind FROM s) GROUP BY CUBE (chrom, kind)")
def count_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.functions import alleles as al

    return views.counted_cube(proxy.sites(spark, sf_dir), {"chrom": F.col("chrom"), "kind": F.get(al.variant_types(F.col("ref"), F.col("alts")), F.lit(0))})


@query("SELECT chrom, count(*) AS n_sites, sum(pos)::BIGINT AS sum_pos FROM s WHERE alt <> '<DEL>' AND pos % 3 <> 0 AND pos % 4 <> 1 GROUP BY chrom")
def pair_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other table has two more bases after REF and ALT, and another ALT before; at one site in four only that one."""
    s = proxy.sites(spark, sf_dir).where('alts[0] <> "<DEL>"')
    first = F.get("alts", F.lit(0))
    b = s.where("pos % 3 <> 0").withColumn("alts", F.when(F.col("pos") % 4 == 1, F.array(F.lit("<CNV>"))).otherwise(F.array(F.lit("<CNV>"), F.concat(first, F.lit("CA"))))).withColumn("ref", F.concat("ref", F.lit("CA")))
    return by_contig(views.share_some_allele(s, b))


@query(
    ", r AS (SELECT *, CASE pos % 5 WHEN 0 THEN alt WHEN 1 THEN translate(ref, 'ACGT', 'TGCA') WHEN 2 THEN translate(alt, 'ACGT', 'TGCA') WHEN 3 THEN 'N' ELSE ref END AS base FROM c WHERE len(alt) = 1), "
    "f AS (SELECT *, CASE WHEN ref = base THEN 'ok' WHEN translate(ref, 'ACGT', 'TGCA') = alt THEN 'ambiguous' WHEN alt = base THEN 'swap' WHEN translate(ref, 'ACGT', 'TGCA') = base THEN 'flip' WHEN translate(alt, 'ACGT', 'TGCA') = base THEN 'flip_swap' ELSE 'none' END AS fixed FROM r) "
    "SELECT fixed, CASE fixed WHEN 'swap' THEN alt WHEN 'flip' THEN translate(ref, 'ACGT', 'TGCA') WHEN 'flip_swap' THEN translate(alt, 'ACGT', 'TGCA') ELSE ref END AS ref, count(*) AS n, coalesce(sum(CASE WHEN fixed IN ('swap', 'flip_swap') THEN 2 - dosage ELSE dosage END), 0)::BIGINT AS ac FROM f GROUP BY ALL"
)
def fix_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxy.sites(spark, sf_dir).where("length(alts[0]) = 1")
    alt, flip = F.get("alts", F.lit(0)), lambda c: F.translate(c, "ACGT", "TGCA")
    k = F.col("pos") % 5
    bases = s.select("chrom", "pos", F.when(k == 0, alt).when(k == 1, flip("ref")).when(k == 2, flip(alt)).when(k == 3, "N").otherwise(F.col("ref")).alias("base"))
    out = views.fix_reference(s, bases).select("fixed", "ref", F.explode("samples").alias("s"))
    return out.groupBy("fixed", "ref").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(g.dosage(F.col("s.GT"))), F.lit(0)).alias("ac"))


@query("SELECT sample - 1 AS sample, count(*) FILTER (WHERE dosage = 1) AS n_ins_het, count(*) FILTER (WHERE dosage = 2) AS n_ins_hom, 0::BIGINT AS n_del_het, 0::BIGINT AS n_del_hom FROM c WHERE len(alt) = 2 AND dosage > 0 GROUP BY sample")
def stats_sample_indels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.per_sample_indels(proxy.sites(spark, sf_dir))


@query(
    ", h AS (SELECT pos, q, count(*) FILTER (WHERE dosage = 0)::DOUBLE AS a, count(*) FILTER (WHERE dosage > 0)::DOUBLE AS b FROM (SELECT pos, qty // 10 AS q, dosage FROM c WHERE dosage IS NOT NULL) GROUP BY ALL), "
    "u AS (SELECT pos, sum(a) AS na, sum(b) AS nb, sum(b * (before + a / 2)) AS u, sum((a + b) ** 3 - (a + b)) AS t FROM (SELECT *, coalesce(sum(a) OVER (PARTITION BY pos ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h) GROUP BY pos), "
    "v AS (SELECT *, na * nb / 12 * (na + nb + 1 - t / nullif((na + nb) * (na + nb - 1), 0)) AS var FROM u) SELECT pos, round(CASE WHEN var > 1e-12 THEN (u - na * nb / 2) / sqrt(var) ELSE 0 END, 6) AS z FROM v WHERE na > 0 AND nb > 0"
)
def rank_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether carriers' depths differ from those of the others, over histograms of depth."""
    calls = F.transform("samples", lambda s: F.struct(F.floor(s["DP"] / 10).alias("place"), (g.dosage(s["GT"]) > 0).alias("which")))
    # a generator, as Spark would move a filter on the score below it and compute both
    z = F.explode(F.array_compact(F.array(F.round(views.rank_z_of(calls), 6))))
    return proxy.sites(spark, sf_dir).select("pos", z.alias("z"))


@query()
def em_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: iterated to a fixed point; tests hold it against the likelihood on a grid."""
    pl = lambda x: F.when(g.dosage(x["GT"]).isNotNull(), F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (F.abs(k - g.dosage(x["GT"])) * 20).cast("int")))
    s = proxy.sites(spark, sf_dir)
    return views.em_frequencies(s.withColumn("samples", F.transform("samples", lambda x: F.struct(pl(x).alias("PL"))))).select("chrom", "pos", F.round("af", 4).alias("af"), "n")
