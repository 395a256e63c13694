"""More registered queries: projection, merging, normalisation, genotypes, trios, models, reads and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom import proxy
from siteloom.functions import genotype as g
from siteloom.operators import calling, genotypes, hmm, merge, normalize, plugins, select, sequence, setops, windows
from siteloom.plans.project import project
from siteloom.proxy import table
from siteloom.queries import GENO, TYPE, by_contig, query
from siteloom.streaming import events as stream

_GT = "CASE WHEN dosage IS NULL THEN './.' WHEN dosage = 0 THEN '0/0' WHEN dosage = 1 THEN '0/1' ELSE '1/1' END"


def _counts(df: DataFrame, by: str = "pos") -> DataFrame:
    """Called alleles, and those that are ALT, by a column."""
    e = df.select(by, F.explode("samples").alias("s")).select(by, F.explode("s.GT.alleles").alias("a"))
    return e.groupBy(by).agg(F.count("a").alias("an"), F.count_if(F.col("a") > 0).alias("ac"))


# --- projection
@query(f"SELECT chrom, pos, chrom || ':' || pos || ' ' || ref || '>' || alt || ' ' || filter || ' ' || coalesce(id, '.') || ' ' || upper({TYPE}) || string_agg(' ' || replace({_GT}, '/', CASE WHEN phased THEN '|' ELSE '/' END) || ':' || coalesce(qty::VARCHAR, '.'), '' ORDER BY sample) || chr(10) AS line FROM c GROUP BY chrom, pos, ref, alt, filter, id")
def project_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(proxy.sites(spark, sf_dir), r"%CHROM:%POS %REF>%ALT %FILTER %ID %TYPE[ %GT:%DP]")


@query(f"SELECT chrom, pos, pos || chr(9) || string_agg(CASE WHEN dosage IS NULL THEN CASE WHEN phased THEN '.|.' ELSE './.' END ELSE replace(CASE dosage WHEN 0 THEN ref || '/' || ref WHEN 1 THEN ref || '/' || alt ELSE alt || '/' || alt END, '/', CASE WHEN phased THEN '|' ELSE '/' END) END, '' ORDER BY sample) || chr(10) AS line FROM c WHERE qual > 300 AND {TYPE} = 'snp' GROUP BY chrom, pos, ref, alt")
def project_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(proxy.sites(spark, sf_dir), r"%POS\t[%TGT]", where='QUAL>300 & TYPE="snp"')


# --- merge
def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two call sets with different samples, each without a third of the sites."""
    s = proxy.sites(spark, sf_dir)
    return select.subset_samples(s.where("pos % 3 <> 0"), [0, 1, 2]), select.subset_samples(s.where("pos % 3 <> 1"), [3, 4, 5, 6])


_MERGED = "(SELECT *, CASE WHEN (sample <= 3 AND pos % 3 = 0) OR (sample > 3 AND pos % 3 = 1) THEN NULL ELSE dosage END AS d FROM c)"


@query(f"SELECT pos, 2 * count(d) AS an, coalesce(sum(d), 0)::BIGINT AS ac FROM {_MERGED} GROUP BY pos")
def merge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return _counts(merge.merge(a, b, 3, 4, "none"))


@query("SELECT pos, CASE WHEN pos % 3 = 2 THEN 2 * dp ELSE dp END AS dp, CASE pos % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'q10;s50' ELSE '' END AS f FROM s")
def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return merge.merge(a, b, 3, 4, "both", {"DP": "sum"}).select("pos", F.col("info.DP").alias("dp"), F.array_join("filters", ";").alias("f"))


@query("SELECT pos, 14::BIGINT - 2 * count(*) FILTER (WHERE d IS NULL AND NOT ((sample <= 3 AND pos % 3 = 0) OR (sample > 3 AND pos % 3 = 1))) AS an, coalesce(sum(d), 0)::BIGINT AS ac FROM " + _MERGED + " GROUP BY pos")
def merge_missing_to_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return _counts(merge.merge(a, b, 3, 4, "none", missing_to_ref=True))


def _recoded(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Three call sets of SNPs with different samples; the second has another ALT, the third both, in the other order."""
    other = F.translate(F.get("alts", F.lit(0)), "ACGT", "GTCA")
    s = proxy.sites(spark, sf_dir).where('alts[0] <> "<DEL>" and length(alts[0]) = 1').where(other != F.col("ref"))
    two = s.withColumn("alts", F.array(other))
    three = s.withColumn("alts", F.array(other, F.get("alts", F.lit(0)))).withColumn("samples", F.transform("samples", lambda x: x.withField("AD", F.array(F.get(x["AD"], F.lit(0)), F.lit(-1), F.get(x["AD"], F.lit(1))))))
    return [select.subset_samples(t, p) for t, p in ((s, [0, 1]), (two, [2, 3]), (three, [4]))]


@query(
    ", n AS (SELECT pos, sample, qty, price % 97 AS b FROM c WHERE sample <= 5 AND alt <> '<DEL>' AND len(alt) = 1 AND translate(alt, 'ACGT', 'GTCA') <> ref) SELECT pos, sample - 1 AS sample, qty::INT AS of_ref, (CASE WHEN sample <= 2 OR sample = 5 THEN b END)::INT AS of_first, (CASE WHEN sample IN (3, 4) THEN b WHEN sample = 5 AND qty IS NOT NULL THEN -1 WHEN sample = 5 THEN -1 END)::INT AS of_second FROM n"
)
def merge_allele_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-allele depths of three call sets with different ALTs, in the order of the united ALTs."""
    m = merge.merge_all(_recoded(spark, sf_dir), [2, 2, 1], "snps", numbers={"AD": "R"})
    return m.select("pos", F.posexplode("samples").alias("sample", "s")).select("pos", "sample", F.get("s.AD", F.lit(0)).alias("of_ref"), F.get("s.AD", F.lit(1)).alias("of_first"), F.get("s.AD", F.lit(2)).alias("of_second"))


_BINOM = "CASE WHEN dosage IS NULL OR qty IS NULL THEN NULL WHEN dosage = 1 AND qty + price % 97 = 0 THEN NULL WHEN dosage <> 1 OR qty = price % 97 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(qty, price % 97) + 1), lambda k: exp(lgamma(qty + price % 97 + 1) - lgamma(k + 1) - lgamma(qty + price % 97 - k + 1) - (qty + price % 97) * ln(2))))) END"


@query(f"SELECT chrom, count(*) AS n_sites, sum(pos)::BIGINT AS sum_pos FROM (SELECT chrom, pos FROM c GROUP BY ALL HAVING count(*) FILTER (WHERE {_BINOM} < 0.01) >= 2) GROUP BY chrom")
def filter_allele_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites where the two alleles' depths are out of balance in at least two samples."""
    return by_contig(select.where(proxy.sites(spark, sf_dir), "N_PASS(BINOM(FMT/AD)<0.01)>=2"))


@query("SELECT chrom, pos, pos || ' ' || printf('%g', qual::DOUBLE) || ' DP=' || dp || ';MQ=' || printf('%g', (o_totalprice / 100000)::FLOAT::DOUBLE) || ';PRIO=' || prio || chr(10) AS line FROM s")
def project_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(proxy.sites(spark, sf_dir), r"%POS %QUAL %INFO")


@query()
def prune_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: what stays depends on all choices before. Tests hold the rule against a window-by-window check."""
    return by_contig(windows.pruned(proxy.sites(spark, sf_dir), 2, 100, F.col("qual")))


# --- normalisation
def multiallelic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites with a second ALT, which samples of even depth carry instead of the first."""
    s = proxy.sites(spark, sf_dir)
    second = lambda x: x.withField("GT", F.struct(F.transform(x["GT"]["alleles"], lambda a: F.when((a == 1) & (x["DP"] % 2 == 0), 2).otherwise(a)).alias("alleles"), x["GT"]["phased"].alias("phased")))
    return s.withColumn("alts", F.array(F.get("alts", F.lit(0)), F.concat("ref", F.lit("TT")))).withColumn("samples", F.transform("samples", second))


@query("SELECT pos, k AS alt, sum(CASE WHEN (qty % 2 = 0) = (k = 2) THEN dosage ELSE 0 END)::BIGINT AS ac FROM c CROSS JOIN (VALUES (1), (2)) v(k) WHERE dosage IS NOT NULL GROUP BY ALL")
def norm_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = multiallelic(spark, sf_dir)
    out = normalize.split(m).withColumn("alt", F.when(F.get("alts", F.lit(0)).endswith("TT") & (F.length(F.get("alts", F.lit(0))) == 3), 2).otherwise(1))
    e = out.select("pos", "alt", F.explode("samples").alias("s")).select("pos", "alt", F.explode("s.GT.alleles").alias("a"))
    return e.where("a is not null").groupBy("pos", "alt").agg(F.sum("a").alias("ac"))


@query("SELECT pos, 2 AS n_alts, 2 * count(dosage) AS an, coalesce(sum(dosage), 0)::BIGINT AS ac FROM c GROUP BY pos")
def norm_split_and_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = normalize.join(normalize.split(multiallelic(spark, sf_dir)), by_class=False)
    return _counts(back).join(back.select("pos", F.size("alts").alias("n_alts")), "pos").select("pos", "n_alts", "an", "ac")


@query("SELECT chrom, count(*) AS n_sites, sum(pos)::BIGINT AS sum_pos FROM s GROUP BY chrom")
def norm_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxy.sites(spark, sf_dir)
    return by_contig(normalize.without_duplicates(s.unionByName(s), "both"))


@query("SELECT chrom, count(*) * 2 AS n_sites, sum(2 * pos + 1)::BIGINT AS sum_pos FROM s GROUP BY chrom")
def norm_atomize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxy.sites(spark, sf_dir).withColumn("ref", F.lit("AC")).withColumn("alts", F.array(F.lit("GT")))
    return by_contig(normalize.atomize(s))


@query("SELECT chrom, count(*) AS n_sites, sum(pos)::BIGINT AS sum_pos FROM s WHERE pos % 5 <> 0 GROUP BY chrom")
def norm_reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxy.sites(spark, sf_dir)
    bases = s.select("chrom", "pos", F.when(F.col("pos") % 5 == 0, "N").otherwise(F.col("ref")).alias("base"))
    return by_contig(normalize.reference_check(s, bases))


# --- genotypes
@query("SELECT chrom, count(dosage) * 2 AS an, coalesce(sum(CASE WHEN qty > 20 THEN 0 ELSE dosage END), 0)::BIGINT AS ac FROM c GROUP BY chrom")
def set_gt_by_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxy.sites(spark, sf_dir)
    return _counts(genotypes.set_gt(s, "q", "0", 'FMT/DP>20 & GT!="mis"'), "chrom")


@query("SELECT chrom, count(*) * 2 AS an, coalesce(sum(dosage), 0)::BIGINT AS ac FROM c GROUP BY chrom")
def missing_to_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(genotypes.missing_to_ref(proxy.sites(spark, sf_dir)), "chrom")


@query("SELECT chrom, pos, sample - 1 AS sample, coalesce(dosage, -1)::DOUBLE AS dosage FROM c")
def dosages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes.dosages(proxy.sites(spark, sf_dir))


@query("SELECT chrom, pos, (2 * count(CASE WHEN sample <= 3 THEN dosage END) - coalesce(sum(CASE WHEN sample <= 3 THEN dosage END), 0))::INT AS case_ref, coalesce(sum(CASE WHEN sample <= 3 THEN dosage END), 0)::INT AS case_alt, (2 * count(CASE WHEN sample > 3 THEN dosage END) - coalesce(sum(CASE WHEN sample > 3 THEN dosage END), 0))::INT AS control_ref, coalesce(sum(CASE WHEN sample > 3 THEN dosage END), 0)::INT AS control_alt FROM c GROUP BY ALL")
def contrast_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes.allele_contrast(proxy.sites(spark, sf_dir), [0, 1, 2], [3, 4, 5, 6]).select("chrom", "pos", "case_ref", "case_alt", "control_ref", "control_alt")


@query()
def contrast_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes.allele_contrast(proxy.sites(spark, sf_dir), [0, 1, 2], [3, 4, 5, 6]).select("chrom", "pos", F.round("p", 6).alias("p"), "novel_allele")


_TRIO = "(SELECT pos, chrom, ref, alt, max(CASE WHEN sample = 1 THEN dosage END) AS c, max(CASE WHEN sample = 2 THEN dosage END) AS f, max(CASE WHEN sample = 3 THEN dosage END) AS m FROM c GROUP BY ALL)"
_GOOD = "CASE WHEN c = 0 THEN f < 2 AND m < 2 WHEN c = 2 THEN f > 0 AND m > 0 ELSE (f < 2 AND m > 0) OR (f > 0 AND m < 2) END"


@query(f"SELECT 0 AS trio, count(*) FILTER (WHERE c + f + m IS NOT NULL AND {_GOOD}) AS n_good, count(*) FILTER (WHERE c + f + m IS NOT NULL AND NOT {_GOOD}) AS n_error, count(*) FILTER (WHERE c + f + m IS NULL) AS n_missing FROM {_TRIO}")
def mendelian_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes.mendelian_counts(proxy.sites(spark, sf_dir), [(0, 1, 2)])


@query(f"SELECT 0 AS trio, count(*) AS n_complete, count_if(c + f + m > 0) AS n_nonref, count_if(NOT {_GOOD}) AS n_error, count_if(c + f + m = 1 AND c = 1) AS n_new, count_if(c + f + m = 1 AND c = 0) AS n_singleton FROM {_TRIO} WHERE c + f + m IS NOT NULL")
def trio_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes.trio_stats(proxy.sites(spark, sf_dir), [(0, 1, 2)]).drop("n_ts", "n_tv")


@query(
    ", t AS (SELECT trio, c.chrom, c.pos, CASE WHEN f.dosage IN (0, 1) AND m.dosage IN (1, 2) THEN 1 ELSE 0 END AS straight, CASE WHEN f.dosage IN (1, 2) AND m.dosage IN (0, 1) THEN 1 ELSE 0 END AS crossed FROM c "
    "JOIN (VALUES (0, 1, 2, 3), (1, 4, 5, 6)) v(trio, cs, fs, ms) ON c.sample = cs JOIN c f ON f.pos = c.pos AND f.sample = fs JOIN c m ON m.pos = c.pos AND m.sample = ms WHERE c.dosage = 1 AND c.phased), "
    "p AS (SELECT trio, crossed AS phase, lag(crossed) OVER (PARTITION BY trio, chrom ORDER BY pos) AS last FROM t WHERE straight <> crossed) "
    "SELECT trio::INT AS trio, count(*) AS n_tested, coalesce(sum(CASE WHEN last <> phase THEN 1 ELSE 0 END), 0)::BIGINT AS n_switches FROM p GROUP BY trio"
)
def trio_switch_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return genotypes.switch_rate(proxy.sites(spark, sf_dir), [(0, 1, 2), (3, 4, 5)])


@query("SELECT pos, 2 * count(CASE WHEN pos % 4 = 0 AND dosage IS NOT NULL AND dosage <> 1 THEN NULL ELSE dosage END) AS an FROM c GROUP BY pos")
def isec_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.queries import _other_calls

    s = proxy.sites(spark, sf_dir)
    return _counts(genotypes.isec_genotypes(s, _other_calls(s))).select("pos", "an")


@query("SELECT sample - 1 AS sample, count_if(dosage = 1 AND phased) AS n_same, 0::BIGINT AS n_opposite, false AS swap, 99.0::DOUBLE AS pq FROM c WHERE pos % 3 = 2 GROUP BY sample")
def ligate_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxy.sites(spark, sf_dir)
    return setops.ligate_votes(s.where("pos % 3 <> 0"), s.where("pos % 3 <> 1"))


# --- models
@query()
def roh_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.regions(hmm.runs_of_homozygosity(proxy.sites(spark, sf_dir), to_az=1e-2, to_hw=1e-2))


@query()
def copy_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxy.sites(spark, sf_dir)
    vaf = lambda x: F.try_divide(F.get(x["AD"], F.lit(1)).cast("double"), F.get(x["AD"], F.lit(0)) + F.get(x["AD"], F.lit(1)))
    signal = s.withColumn("samples", F.transform("samples", lambda x: F.struct(vaf(x).alias("BAF"), (F.log2(x["DP"] / 30.0)).alias("LRR"))))
    return hmm.copy_number(signal).groupBy("sample", "chrom", "copies").agg(F.count(F.lit(1)).alias("n"))


@query()
def multiallelic_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxy.sites(spark, sf_dir)
    pl = lambda x: F.when(g.dosage(x["GT"]).isNotNull(), F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (F.abs(k - g.dosage(x["GT"])) * (20 + x["DP"] % 20)).cast("int")))
    out = calling.multiallelic_calls(s.withColumn("samples", F.transform("samples", lambda x: F.struct(pl(x).alias("PL")))))
    return out.select("chrom", "pos", F.array_join("gts", " ").alias("gts"), F.round("qual", 4).alias("qual"))


@query("WITH l AS (SELECT l_returnflag AS chrom, l_orderkey AS pos, l_linenumber AS sample FROM lineitem), b AS (SELECT chrom, sample, pos + o AS pos, x FROM l CROSS JOIN (VALUES (0, 'A'), (1, 'C'), (3, 'G'), (4, 'T'), (5, 'A')) v(o, x)) SELECT chrom, pos, sample, count_if(x = 'A') AS n_a, count_if(x = 'C') AS n_c, count_if(x = 'G') AS n_g, count_if(x = 'T') AS n_t, count(*) AS depth FROM b GROUP BY ALL", prefix=False)
def pileup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    reads = line.select(F.col("l_returnflag").alias("chrom"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("sample"), F.lit("1S2M1D1M1I2M").alias("cigar"), F.lit("TACGCTA").alias("seq"), F.lit(60).alias("mapq"))
    return calling.pileup(reads)


# --- sequences
_TERMS = ["missense_variant&splice_region_variant", "inframe_deletion", "protein_altering_variant", "stop_gained", "frameshift_variant", "5_prime_UTR_variant", "3_prime_UTR_variant", "mature_miRNA_variant"]


@query(
    f"WITH e AS (SELECT *, {_TERMS}[event_id % 8 + 1] AS a, {_TERMS}[event_id // 8 % 8 + 1] AS b FROM events), r AS (SELECT *, [13, 13, 13, 17, 17, 8, 8, 9] AS ranks FROM e), w AS (SELECT event_id, a, b, ranks[event_id % 8 + 1] AS ra, ranks[event_id // 8 % 8 + 1] AS rb FROM r) "
    "SELECT event_id, CASE WHEN rb > ra THEN b ELSE a END AS consequence, CASE WHEN rb > ra THEN 'y' ELSE 'x' END AS gene, greatest(ra, rb)::INT AS severity FROM w", prefix=False,
)
def worst_consequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of equal and of different severity: of equal ones the first counts."""
    terms = F.array(*[F.lit(t) for t in _TERMS])
    e = table(spark, sf_dir, "events").withColumn("chrom", F.lit("1")).withColumn("pos", F.col("event_id"))
    csq = F.concat(F.lit("G|"), F.get(terms, (F.col("event_id") % 8).cast("int")), F.lit("|x,G|"), F.get(terms, (F.floor(F.col("event_id") / 8) % 8).cast("int")), F.lit("|y"))
    out = sequence.split_consequences(e, csq, ["Allele", "Consequence", "gene"], "worst")
    return out.select("event_id", F.col("Consequence").alias("consequence"), "gene", "severity")


# --- streams
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.read_stream(spark, f"{sf_dir}/events*.parquet", table(spark, sf_dir, "events"))


def _run(df: DataFrame) -> DataFrame:
    return stream.run_to_memory(df, f"m{uuid.uuid4().hex}", "complete")


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL", prefix=False)
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(stream.tumbling(_stream(spark, sf_dir), "1 day"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY ALL", prefix=False)
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(stream.sliding(_stream(spark, sf_dir), "12 hours", "6 hours")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query(
    "WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, max(value) AS top FROM r GROUP BY user_id, k",
    prefix=False,
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(stream.sessions(_stream(spark, sf_dir), "1 day")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "top")


# --- named operators
@query(f", d AS (SELECT abs(0.3 - ac / an) AS d FROM {GENO} WHERE an > 0) SELECT least(floor(d * 10), 9)::INT AS bin, count(*) AS n FROM d GROUP BY bin")
def plugin_frequency_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.run("af-dist", proxy.sites(spark, sf_dir), F.lit(0.3))


@query(f"SELECT count(*) FILTER (WHERE a = f) AS n_father, count(*) FILTER (WHERE a = m) AS n_mother FROM (SELECT c AS a, f, m FROM {_TRIO} WHERE c IN (0, 2) AND f IN (0, 2) AND m IN (0, 2) AND f <> m)")
def plugin_parental_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.run("parental-origin", proxy.sites(spark, sf_dir), 0, 1, 2).drop("p")


@query("SELECT 'ok' AS state, count(*) FILTER (WHERE pos % 5 <> 0) AS n FROM s WHERE alt <> '<DEL>' OR true UNION ALL SELECT 'swapped', count(*) FILTER (WHERE pos % 5 = 0 AND len(alt) = 1) FROM s UNION ALL SELECT 'none', count(*) FILTER (WHERE pos % 5 = 0 AND len(alt) <> 1) FROM s")
def plugin_strand_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxy.sites(spark, sf_dir)
    alt = F.get("alts", F.lit(0))
    bases = s.select("chrom", "pos", F.when(F.col("pos") % 5 != 0, F.col("ref")).when(F.length(alt) == 1, alt).otherwise("N").alias("base"))
    return plugins.strand_report(s, bases).select("state", "n")


@query()
def plugin_guess_ploidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.run("guess-ploidy", proxy.sites(spark, sf_dir)).select("sample", "n_sites", "ploidy")


@query()
def plugin_ad_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.run("ad-bias", proxy.sites(spark, sf_dir), [(0, 1), (2, 3)], 0.05)


@query()
def plugin_site_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.run("vrfs", pileup_counts(spark, sf_dir)).select("chrom", "pos", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("SELECT (len(alt) - len(ref))::INT AS change, count(*) AS n_genotypes, round(avg(CASE WHEN qty + price % 97 > 0 THEN (price % 97) / (qty + price % 97) END), 6) AS mean_vaf, true AS frameshift FROM c WHERE len(alt) = 2 AND dosage > 0 GROUP BY change")
def plugin_indel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plugins.run("indel-stats", proxy.sites(spark, sf_dir)).withColumn("mean_vaf", F.round("mean_vaf", 6))


@query()
def best_non_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxy.sites(spark, sf_dir)
    return windows.best_non_overlapping(s.withColumn("ref", F.when(F.col("pos") % 3 == 0, F.concat("ref", F.lit("AA"))).otherwise(F.col("ref"))))


def queries() -> dict:
    """All registered queries, those of the other modules too."""
    from siteloom import queries as first
    from siteloom import queries_models, queries_views  # noqa: F401  (registers their queries)

    return first.queries()


def oracle_sql() -> dict[str, str]:
    from siteloom import queries as first
    from siteloom import queries_models, queries_views  # noqa: F401  (registers their queries)

    return first.oracle_sql()
