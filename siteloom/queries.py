"""Registered queries of the variant-table operators over the star-schema tables, with the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom import proxy
from siteloom.expr.compiler import compile_filter, compile_value
from siteloom.operators import annotate as an
from siteloom.operators import fill_tags, ranges, select, setops, summaries, windows
from siteloom.proxy import table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}
TYPE = "CASE WHEN alt = '<DEL>' OR len(alt) = 2 THEN 'indel' ELSE 'snp' END"
GENO = "(SELECT pos, list(dosage ORDER BY sample) AS ds, list(qty ORDER BY sample) AS dps, count(dosage) * 2 AS an, sum(dosage) AS ac, count_if(dosage = 1) AS n_het, count_if(dosage IS NULL) AS n_mis, count_if(dosage = 2) AS n_hom FROM c GROUP BY pos)"


def query(sql: str | None = None, prefix: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            # counts as 64-bit numbers
            _sql[f.__name__] = ((proxy.SQL if prefix else "") + sql).replace("count_if(", "count(*) FILTER (WHERE ")
        return f

    return add


def by_contig(df: DataFrame) -> DataFrame:
    return df.groupBy("chrom").agg(F.count(F.lit(1)).alias("n_sites"), F.sum("pos").alias("sum_pos"))


def _filter_query(name: str, expr: str, where: str, exclude: bool = False) -> None:
    """A query of the sites that an expression keeps, by contig."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return by_contig(select.where(proxy.sites(spark, sf_dir), expr, exclude))

    run.__name__ = name
    query(f"SELECT chrom, count(*) AS n_sites, sum(pos)::BIGINT AS sum_pos FROM s JOIN {GENO} g USING (pos) WHERE {where} GROUP BY chrom")(run)


# --- the filter language
_filter_query("filter_flagship", 'QUAL>30 & N_PASS(GT="het")>=1', "qual > 30 AND n_het >= 1")
_filter_query("filter_exclude", 'QUAL>30', "NOT (qual > 30)", exclude=True)
_filter_query("filter_type", 'TYPE="snp" && QUAL<=100', f"{TYPE} = 'snp' AND qual <= 100")
_filter_query("filter_type_regex", 'TYPE~"indel" || ALT="<DEL>"', f"{TYPE} = 'indel'")
_filter_query("filter_set_equal", 'FILTER="s50;q10"', "filter = 'q10;s50'")
_filter_query("filter_set_contains", 'FILTER~"q10" | FILTER="PASS"', "filter IN ('q10;s50', 'PASS')")
_filter_query("filter_missing_equal", 'FMT/DP="." & ID="."', "id IS NULL AND list_count(dps) < 7")
_filter_query("filter_id", 'ID="rs5" || ID="rs10"', "id IN ('rs5', 'rs10')")
_filter_query("filter_any_element", "FMT/DP>45", "len(list_filter(dps, lambda x: x > 45)) > 0")
_filter_query("filter_same_sample", 'FMT/DP>20 & GT="het"', "len(list_filter(list_zip(dps, ds), lambda x: x[1] > 20 AND x[2] = 1)) > 0")
_filter_query("filter_other_sample", 'FMT/DP>20 && GT="het"', "len(list_filter(dps, lambda x: x > 20)) > 0 AND n_het > 0")
_filter_query("filter_allele_count", "AC[0]>3 & AN>=8", "ac > 3 AND an >= 8")
_filter_query("filter_frequency", "AF>0.5 || MAF[0]<0.1", "an > 0 AND ((ac / an)::FLOAT > 0.5::FLOAT OR least(ac / an, 1 - ac / an)::FLOAT < 0.1::FLOAT)")
_filter_query("filter_missingness", "F_MISSING>0.3 & N_MISSING<6", "n_mis / 7 > 0.3 AND n_mis < 6")
_filter_query("filter_right_associative", "POS-100-50=7", "pos - (100 - 50) = 7")
_filter_query("filter_modulo", "POS%7=3", "pos % 7 = 3")
_filter_query("filter_regex", 'PRIO~"^[12]-"', "regexp_matches(prio, '^[12]-')")
_filter_query("filter_not_regex_ci", 'PRIO!~"URGENT"/i', "NOT regexp_matches(prio, '(?i)URGENT')")
_filter_query("filter_strlen", "STRLEN(REF)=1 & ILEN>0", "len(alt) = 2")
_filter_query("filter_summary", "AVG(FMT/DP)>25 && MEDIAN(FMT/DP)<40", "list_avg(dps) > 25 AND list_median(dps) < 40")
_filter_query("filter_count", 'COUNT(GT="alt")>2', "n_het + n_hom > 2")
_filter_query("filter_f_pass", 'F_PASS(GT="hom" & FMT/DP>10)>0.2', "len(list_filter(list_zip(dps, ds), lambda x: x[1] > 10 AND x[2] IN (0, 2))) / 7 > 0.2")
_filter_query("filter_gt_text", 'GT="0/1" || GT="1|1"', "pos IN (SELECT pos FROM c WHERE (dosage = 1 AND NOT phased) OR (dosage = 2 AND phased))")
_filter_query("filter_subscript", "FMT/DP[0]>20 | FMT/DP[2-4]<5", "dps[1] > 20 OR dps[3] < 5 OR dps[4] < 5 OR dps[5] < 5")
_filter_query("filter_position", 'CHROM="O" && POS>=100 && POS<5000', "chrom = 'O' AND pos >= 100 AND pos < 5000")


@query(f"SELECT pos, round(list_max(dps), 6)::DOUBLE AS mx, round(list_min(dps), 6)::DOUBLE AS mn, round(list_avg(dps), 6) AS av, round(list_median(dps), 6) AS md, round(list_stddev_pop(dps), 6) AS sd, list_sum(dps)::DOUBLE AS sm FROM s JOIN {GENO} g USING (pos)")
def functions_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = proxy.sites(spark, sf_dir)
    v = {n: compile_value(f"{f}(FMT/DP)", df).col for n, f in (("mx", "MAX"), ("mn", "MIN"), ("av", "AVG"), ("md", "MEDIAN"), ("sd", "STDEV"), ("sm", "SUM"))}
    return df.select("pos", *[F.round(c, 6).alias(n) for n, c in v.items()])


@query("SELECT pos, sample - 1 AS sample, greatest(qty, price % 97)::DOUBLE AS mx, round((qty + price % 97) / 2, 6) AS av FROM c WHERE qty IS NOT NULL")
def functions_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = proxy.sites(spark, sf_dir)
    mx, av = compile_value("sMAX(FMT/AD)", df).col, compile_value("SMPL_AVG(FMT/AD)", df).col
    return df.select("pos", F.posexplode(F.arrays_zip(mx.alias("mx"), av.alias("av"))).alias("sample", "v")).select("pos", "sample", "v.mx", F.round("v.av", 6).alias("av")).where("mx is not null")


@query("SELECT chrom, sum(n)::BIGINT AS n_pass FROM (SELECT chrom, count_if(qty > 20 AND dosage = 1) AS n FROM c GROUP BY chrom, pos HAVING n > 0) GROUP BY chrom")
def filter_sample_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = proxy.sites(spark, sf_dir)
    c = compile_filter('FMT/DP>20 & GT="het"', df)
    return df.where(c.site).groupBy("chrom").agg(F.sum(F.size(F.filter(c.samples, lambda x: x))).alias("n_pass"))


# --- selectors
def _select_query(name: str, f: Callable[[DataFrame], DataFrame], where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return by_contig(f(proxy.sites(spark, sf_dir)))

    run.__name__ = name
    query(f"SELECT chrom, count(*) AS n_sites, sum(pos)::BIGINT AS sum_pos FROM s JOIN {GENO} g USING (pos) WHERE {where} GROUP BY chrom")(run)


_select_query("view_types", lambda d: select.of_types(d, ["indel"]), f"{TYPE} = 'indel'")
_select_query("view_types_excluded", lambda d: select.of_types(d, ["indel"], exclude=True), f"{TYPE} <> 'indel'")
_select_query("view_allele_bounds", lambda d: select.allele_bounds(d, 2, 2), "true")
_select_query("view_known", lambda d: select.known(d), "id IS NOT NULL")
_select_query("view_novel", lambda d: select.known(d, novel=True), "id IS NULL")
_select_query("view_apply_filters", lambda d: select.apply_filters(d, ["PASS", "."]), "filter IN ('PASS', '.')")
_select_query("view_genotype_het", lambda d: select.genotype(d, "het"), "n_het > 0")
_select_query("view_genotype_no_missing", lambda d: select.genotype(d, "^miss"), "n_mis = 0")
_select_query("view_min_ac", lambda d: select.counts(d, least=3), "coalesce(ac, 0) >= 3")
_select_query("view_minor_ac", lambda d: select.counts(d, least=1, most=2, kind="minor"), "least(coalesce(ac, 0), an - coalesce(ac, 0)) BETWEEN 1 AND 2")
_select_query("view_frequency", lambda d: select.counts(d, frequency=True, low=0.25, high=0.75), "an > 0 AND ac / an BETWEEN 0.25 AND 0.75")
_select_query("view_private", lambda d: select.private(d, [0, 1]), "list_sum(ds[1:2]) > 0 AND list_sum(ds[1:2]) = ac")
_select_query("view_uncalled", lambda d: select.uncalled(d), "an = 0")
_select_query("view_phased", lambda d: select.phased(d), "pos NOT IN (SELECT pos FROM c WHERE NOT phased)")
_select_query("view_genotype_subset", lambda d: select.genotype_subset(d, [0, 1]), "ds[1] IS NOT NULL AND ds[2] = ds[1] AND len(list_filter(ds[3:7], lambda x: x = ds[1])) = 0")


@query(f"SELECT chrom, f, count(*) AS n FROM (SELECT chrom, CASE WHEN NOT (qual > 100 AND {TYPE} = 'snp') THEN CASE filter WHEN 'q10;s50' THEN 'q10;s50;low' ELSE 'low' END WHEN filter = '.' THEN 'PASS' ELSE filter END AS f FROM s) GROUP BY ALL")
def soft_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = select.soft_filter(proxy.sites(spark, sf_dir), 'QUAL>100 & TYPE="snp"', "low", append=True)
    return out.groupBy("chrom", F.array_join("filters", ";").alias("f")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT chrom, count(CASE WHEN qty > 15 THEN dosage END) AS n_called, coalesce(sum(CASE WHEN qty > 15 THEN dosage END), 0)::BIGINT AS n_alt FROM c GROUP BY chrom")
def set_failed_genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siteloom.functions.genotype import dosage

    out = select.set_failed_genotypes(proxy.sites(spark, sf_dir), "FMT/DP>15").select("chrom", F.explode("samples").alias("s"))
    return out.groupBy("chrom").agg(F.count(dosage(F.col("s.GT"))).alias("n_called"), F.coalesce(F.sum(dosage(F.col("s.GT"))), F.lit(0)).alias("n_alt"))


@query(f"SELECT chrom, count(*) AS n_sites, sum(pos)::BIGINT AS sum_pos FROM s WHERE {TYPE} = 'snp' AND EXISTS (SELECT 1 FROM s x WHERE x.chrom = s.chrom AND (x.alt = '<DEL>' OR len(x.alt) = 2) AND abs(x.pos - s.pos) <= 3) GROUP BY chrom")
def snp_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_contig(select.snp_gap(proxy.sites(spark, sf_dir), 3).where(F.array_contains("filters", "SnpGap")))


@query(
    f", i AS (SELECT chrom, pos, ref, qual, coalesce(ac, 0) AS n FROM s JOIN {GENO} g USING (pos) WHERE {TYPE} = 'indel'), k AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos) AS cl FROM (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) <= 20 THEN 0 ELSE 1 END AS new FROM i)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY chrom, cl ORDER BY qual DESC, n DESC, pos) AS rn FROM k) SELECT chrom, count(*) AS n_sites, sum(pos)::BIGINT AS sum_pos FROM r WHERE rn > 1 GROUP BY chrom"
)
def indel_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_contig(select.indel_gap(proxy.sites(spark, sf_dir), 20).where(F.array_contains("filters", "IndelGap")))


@query("SELECT chrom, sample - 1 AS sample, count(dosage) AS n_called FROM c GROUP BY ALL HAVING n_called < 1000000")
def sparse_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.sparse_samples(proxy.sites(spark, sf_dir), 1_000_000)


# --- regions and interval joins; parts are the intervals
INTERVALS = "SELECT CASE p_partkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS chrom, p_partkey * 7 AS beg, p_partkey * 7 + p_size AS \"end\", p_size, p_retailprice, p_brand FROM part"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(F.when(k % 3 == 0, "F").when(k % 3 == 1, "O").otherwise("P").alias("chrom"), (k * 7).alias("beg"), (k * 7 + F.col("p_size")).alias("end"), "p_size", "p_retailprice", "p_brand")


_OVER = f"(SELECT s.chrom, s.pos, s.ref, i.* EXCLUDE (chrom) FROM s JOIN ({INTERVALS}) i ON i.chrom = s.chrom AND i.beg <= s.pos AND s.pos <= i.\"end\")"


@query(f"SELECT chrom, count(*) AS n, sum(pos)::BIGINT AS sum_pos, sum(beg)::BIGINT AS sum_beg FROM {_OVER} GROUP BY chrom")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = ranges.overlap_join(proxy.sites(spark, sf_dir).select("chrom", "pos", "end"), intervals(spark, sf_dir))
    return j.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("sum_pos"), F.sum("r_beg").alias("sum_beg"))


@query(f"SELECT chrom, count(*) AS n_sites, sum(pos)::BIGINT AS sum_pos FROM s WHERE NOT EXISTS (SELECT 1 FROM ({INTERVALS}) i WHERE i.chrom = s.chrom AND i.beg <= s.pos AND s.pos <= i.\"end\") GROUP BY chrom")
def targets_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_contig(select.regions(proxy.sites(spark, sf_dir), intervals(spark, sf_dir), targets=True, complement=True))


@query(f"SELECT chrom, count(*) AS n_sites, sum(pos)::BIGINT AS sum_pos FROM {_OVER} GROUP BY chrom")
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_contig(select.regions(proxy.sites(spark, sf_dir), intervals(spark, sf_dir)))


@query(f"SELECT chrom, pos, sum(p_size)::BIGINT AS size_sum, round(avg(p_retailprice), 6) AS price_avg, min(p_retailprice) AS price_min, max(p_retailprice) AS price_max, string_agg(p_brand, ',' ORDER BY beg, \"end\", p_brand) AS brands, arg_min(p_brand, (beg, \"end\", p_brand)) AS brand FROM {_OVER} GROUP BY chrom, pos")
def annotate_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"size_sum": ("p_size", "sum"), "price_avg": ("p_retailprice", "avg"), "price_min": ("p_retailprice", "min"), "price_max": ("p_retailprice", "max"), "brands": ("p_brand", "append"), "brand": ("p_brand", "first")}
    out = an.annotate(proxy.sites(spark, sf_dir), intervals(spark, sf_dir), cols).where("size_sum is not null")
    return out.select("chrom", "pos", "size_sum", F.round("price_avg", 6).alias("price_avg"), "price_min", "price_max", "brands", "brand")


@query(f"SELECT chrom, id, count(*) AS n FROM (SELECT s.chrom, coalesce(s.id, b) AS id FROM s LEFT JOIN (SELECT pos, arg_min(p_brand, (beg, \"end\", p_brand)) AS b FROM {_OVER} GROUP BY pos) o USING (pos)) GROUP BY ALL")
def annotate_only_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = an.annotate(proxy.sites(spark, sf_dir), intervals(spark, sf_dir), {"+id": ("p_brand", "first")})
    return out.groupBy("chrom", "id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT chrom, flag, count(*) AS n FROM (SELECT chrom, pos IN (SELECT pos FROM {_OVER}) AS flag FROM s) GROUP BY ALL")
def mark_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.mark_sites(proxy.sites(spark, sf_dir), intervals(spark, sf_dir), "flag").groupBy("chrom", "flag").agg(F.count(F.lit(1)).alias("n"))


@query(", d AS (SELECT chrom, pos, pos - lag(pos) OVER w AS p, lead(pos) OVER w - pos AS n FROM s WINDOW w AS (PARTITION BY chrom ORDER BY pos)) SELECT chrom, pos, p AS dist_prev, n AS dist_next, CASE WHEN p IS NULL THEN n WHEN n IS NULL THEN p ELSE least(p, n) END AS dist FROM d")
def variant_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.nearest(proxy.sites(spark, sf_dir)).select("chrom", "pos", "dist_prev", "dist_next", "dist")


# --- sets of call sets: two halves of the sites, with some in both
def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = proxy.sites(spark, sf_dir)
    return s.where("pos % 3 <> 0"), s.where("pos % 3 <> 1")


_select_query("isec_shared", lambda d: setops.intersect([d.where("pos % 3 <> 0"), d.where("pos % 3 <> 1")], "=2"), "pos % 3 = 2")
_select_query("isec_at_most", lambda d: setops.intersect([d.where("pos % 3 <> 0"), d.where("pos % 3 <> 1")], "-1"), "pos % 3 = 1")
_select_query("isec_pattern", lambda d: setops.intersect([d.where("pos % 3 <> 0"), d.where("pos % 3 <> 1"), d.where("pos % 2 = 0")], "~110"), "pos % 3 = 2 AND pos % 2 = 1")
_select_query("isec_complement", lambda d: setops.complement([d.where("pos % 3 <> 0"), d.where("pos % 3 <> 1")]), "pos % 3 = 1")
_select_query("concat_unique", lambda d: setops.concat([d.where("pos % 3 <> 0"), d.where("pos % 3 <> 1")], "none"), "true")


@query("SELECT chrom, count(*) AS n_sites, sum(pos)::BIGINT AS sum_pos FROM (SELECT * FROM s WHERE pos % 3 <> 0 UNION ALL SELECT * FROM s WHERE pos % 3 <> 1) GROUP BY chrom")
def concat_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_contig(setops.concat(list(halves(spark, sf_dir))))


@query("SELECT chrom, pos, ref, alt FROM s ORDER BY contig_idx, pos")
def sort_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setops.sort(proxy.sites(spark, sf_dir)).select("chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"))


@query("SELECT CASE WHEN pos % 3 = 1 THEN 'only_a' WHEN pos % 3 = 0 THEN 'only_b' ELSE 'shared' END AS side, count(*) AS n FROM s GROUP BY side")
def isec_venn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = setops.presence(list(halves(spark, sf_dir)))
    only = lambda i: F.col("tables") == F.array(F.lit(i))
    return p.groupBy(F.when(only(0), "only_a").when(only(1), "only_b").otherwise("shared").alias("side")).agg(F.count(F.lit(1)).alias("n"))


# --- summaries
@query(f"SELECT count(*) AS n_records, 0::BIGINT AS n_no_alt, count_if({TYPE} = 'snp') AS n_snps, 0::BIGINT AS n_mnps, count_if({TYPE} = 'indel') AS n_indels, 0::BIGINT AS n_others, 0::BIGINT AS n_multi, 0::BIGINT AS n_multi_snps FROM s")
def stats_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.totals(proxy.sites(spark, sf_dir))


_TS = "ref || alt IN ('AG', 'GA', 'CT', 'TC')"


@query(f"SELECT id IS NULL AS novel, count_if({_TS}) AS ts, count_if(NOT {_TS}) AS tv, count_if({_TS}) AS ts_1st, count_if(NOT {_TS}) AS tv_1st, round(count_if({_TS}) / count_if(NOT {_TS}), 6) AS ts_tv FROM s WHERE {TYPE} = 'snp' GROUP BY novel")
def stats_ts_tv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.ts_tv(proxy.sites(spark, sf_dir), [F.col("id").isNull().alias("novel")]).withColumn("ts_tv", F.round("ts_tv", 6)).drop("ts_tv_1st")


@query(f"SELECT ref, alt, count(*) AS n FROM s WHERE {TYPE} = 'snp' GROUP BY ALL")
def stats_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.substitutions(proxy.sites(spark, sf_dir))


@query(f"SELECT CASE WHEN an = 0 OR ac = 1 THEN 0 ELSE 1 + least(floor(ac / an * 10), 9) END::INT AS bin, count_if({TYPE} = 'snp') AS n_snps, count_if({TYPE} = 'indel') AS n_indels, count(*) AS n_sites FROM s JOIN {GENO} g USING (pos) GROUP BY bin")
def stats_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.allele_frequencies(proxy.sites(spark, sf_dir))


@query(f"SELECT floor(qual::DOUBLE * 10)::BIGINT AS qual10, count_if({TYPE} = 'snp') AS n_snps, count_if({TYPE} = 'indel') AS n_indels FROM s GROUP BY qual10")
def stats_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.qualities(proxy.sites(spark, sf_dir))


@query("SELECT (len(alt) - len(ref))::INT AS length, count(*) AS n FROM s WHERE len(alt) = 2 GROUP BY length")
def stats_indel_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.indel_lengths(proxy.sites(spark, sf_dir))


@query(f"SELECT least(greatest(floor(dp / 150), 0), 9)::INT AS bin, count_if({_TS}) AS ts, count_if(NOT {_TS}) AS tv FROM s WHERE {TYPE} = 'snp' GROUP BY bin")
def stats_user_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.binned(proxy.sites(spark, sf_dir), F.col("info.DP"), 0, 1500, 10).select("bin", "ts", "tv")


@query("SELECT qty::INT AS dp, count(*) AS n_genotypes FROM c WHERE qty IS NOT NULL GROUP BY qty")
def stats_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.depths(proxy.sites(spark, sf_dir))


@query(
    f", nr AS (SELECT pos, count_if(dosage > 0) AS k FROM c GROUP BY pos) SELECT sample - 1 AS sample, count_if(dosage IS NULL) AS n_missing, count_if(dosage = 0) AS n_hom_ref, count_if(dosage = 2 AND {TYPE} = 'snp') AS n_hom_alt, count_if(dosage = 1 AND {TYPE} = 'snp') AS n_het, "
    f"count_if(dosage > 0 AND {TYPE} = 'snp' AND {_TS}) AS n_ts, count_if(dosage > 0 AND {TYPE} = 'snp' AND NOT {_TS}) AS n_tv, count_if(dosage > 0 AND {TYPE} = 'indel') AS n_indels, count_if(dosage > 0 AND k = 1) AS n_singletons, round(avg(CASE WHEN dosage IS NOT NULL THEN qty END), 6) AS avg_depth FROM c JOIN nr USING (pos) GROUP BY sample"
)
def stats_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.per_sample(proxy.sites(spark, sf_dir)).withColumn("avg_depth", F.round("avg_depth", 6)).drop("n_hap_ref", "n_hap_alt")


@query(f", h AS (SELECT least(floor(ac / an * 10), 9)::INT AS bin, n_het / (an / 2) AS share FROM {GENO} WHERE an > 0) SELECT bin, round(quantile_cont(share, 0.25), 6) AS p25, round(quantile_cont(share, 0.5), 6) AS p50, round(quantile_cont(share, 0.75), 6) AS p75, count(*) AS n FROM h GROUP BY bin")
def stats_het_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = summaries.het_share_by_frequency(proxy.sites(spark, sf_dir))
    return out.select("bin", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")], "n")


@query("SELECT sample - 1 AS sample, least(floor((price % 97) / (qty + price % 97) * 20), 19)::INT AS bin, count(*) AS n FROM c WHERE qty + price % 97 > 0 GROUP BY ALL")
def stats_vaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.vaf_histogram(proxy.sites(spark, sf_dir))


def _other_calls(df: DataFrame) -> DataFrame:
    """A second call set: dosages of sites divisible by 4 turned round."""
    flip = lambda a: F.when(a.isNull(), a).otherwise(1 - a)
    return df.withColumn("samples", F.when(F.col("pos") % 4 == 0, F.transform("samples", lambda s: s.withField("GT", F.struct(F.array_sort(F.transform(s["GT"]["alleles"], flip)).alias("alleles"), s["GT"]["phased"].alias("phased"))))).otherwise(F.col("samples")))


_D2 = "CASE WHEN pos % 4 = 0 THEN 2 - dosage ELSE dosage END"


@query(
    f", d AS (SELECT sample - 1 AS sample, dosage AS a, {_D2} AS b FROM c WHERE dosage IS NOT NULL) SELECT sample, " + ", ".join(f"count_if(a = {i} AND b = {j}) AS m{i}{j}" for i in range(3) for j in range(3))
    + ", round(100 * count_if(a <> b) / (count_if(a <> b) + count_if(a = b AND a > 0)), 6) AS nrd, round(corr(a, b) * corr(a, b), 6) AS r2 FROM d GROUP BY sample"
)
def stats_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxy.sites(spark, sf_dir)
    return summaries.concordance(s, _other_calls(s)).withColumn("nrd", F.round("nrd", 6)).withColumn("r2", F.round("r2", 6))


@query(f"SELECT chrom, pos, count(dosage)::INT AS n_compared, count_if(dosage <> {_D2})::INT AS n_discordant FROM c GROUP BY chrom, pos")
def stats_site_discordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = proxy.sites(spark, sf_dir)
    return summaries.site_discordance(s, _other_calls(s))


_PAIRS = "(SELECT x.sample - 1 AS sample_a, y.sample - 1 AS sample_b, count(*) AS n_sites, count_if(x.dosage = y.dosage) AS n_matches, (count(*) - count_if(x.dosage = y.dosage))::DOUBLE AS discordance FROM c x JOIN c y ON x.pos = y.pos AND y.sample < x.sample WHERE x.dosage IS NOT NULL AND y.dosage IS NOT NULL GROUP BY ALL)"


@query(f"SELECT * FROM {_PAIRS}")
def gtcheck_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.sample_pairs(proxy.sites(spark, sf_dir))


@query(f", p AS (SELECT * FROM {_PAIRS}), b AS (SELECT * FROM p UNION ALL SELECT sample_b, sample_a, n_sites, n_matches, discordance FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY sample_a ORDER BY discordance / n_sites, sample_b)::INT AS rank FROM b) SELECT * FROM r WHERE rank <= 2")
def gtcheck_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.best_matches(summaries.sample_pairs(proxy.sites(spark, sf_dir)), 2)


@query("SELECT chrom, count(*) AS n FROM s GROUP BY chrom")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.contig_counts(proxy.sites(spark, sf_dir))


@query("SELECT len(ref)::INT AS ref_len, len(alt)::INT AS alt_len, count(*) AS n FROM s WHERE alt <> '<DEL>' GROUP BY ALL")
def allele_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.allele_lengths(proxy.sites(spark, sf_dir))


@query("SELECT sample - 1 AS sample, t AS threshold, count_if(qty >= t AND dosage IS NOT NULL) AS n_pass, count_if(qty >= t AND dosage = 1) AS n_het, count_if(qty >= t AND dosage = 2) AS n_hom_alt FROM c CROSS JOIN (VALUES (10.0::DOUBLE), (20.0::DOUBLE), (30.0::DOUBLE)) AS v(t) GROUP BY ALL")
def sample_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.thresholds(proxy.sites(spark, sf_dir), F.col("s.DP").cast("double"), [10.0, 20.0, 30.0])


@query(", m AS (SELECT pos, dosage, string_agg((sample - 1)::VARCHAR, ',' ORDER BY sample) AS samples FROM c WHERE dosage IS NOT NULL GROUP BY pos, dosage) SELECT samples, count(*) AS n FROM m GROUP BY samples")
def genotype_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.genotype_intersections(proxy.sites(spark, sf_dir)).select(F.array_join("samples", ",").alias("samples"), "n")


@query(
    f"SELECT pos, an::INT AS AN, coalesce(ac, 0)::INT AS AC, (2 * n_hom)::INT AS AC_Hom, n_het::INT AS AC_Het, round(CASE WHEN an > 0 THEN ac / an ELSE 0 END, 6) AS AF, round(CASE WHEN an > 0 THEN least(ac / an, 1 - ac / an) ELSE 0 END, 6) AS MAF, (an / 2)::INT AS NS, round(n_mis / 7, 6) AS F_MISSING FROM {GENO}"
)
def fill_tags_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_tags.filled(proxy.sites(spark, sf_dir))
    first = lambda c: F.get(c, F.lit(0))
    return out.select("pos", "AN", first("AC").alias("AC"), first("AC_Hom").alias("AC_Hom"), first("AC_Het").alias("AC_Het"), F.round(first("AF"), 6).alias("AF"), F.round("MAF", 6).alias("MAF"), "NS", F.round("F_MISSING", 6).alias("F_MISSING"))


@query()
def fill_tags_hwe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_tags.filled(proxy.sites(spark, sf_dir)).select("chrom", "pos", F.round("HWE", 6).alias("HWE"), F.round("ExcHet", 6).alias("ExcHet"))


@query("SELECT pos, 2 * count(CASE WHEN sample <= 3 THEN dosage END)::INT AS AN_A, coalesce(sum(CASE WHEN sample <= 3 THEN dosage END), 0)::INT AS AC_A, 2 * count(CASE WHEN sample > 3 THEN dosage END)::INT AS AN_B, coalesce(sum(CASE WHEN sample > 3 THEN dosage END), 0)::INT AS AC_B FROM c GROUP BY pos")
def fill_tags_populations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_tags.filled_by_population(proxy.sites(spark, sf_dir), {"A": [0, 1, 2], "B": [3, 4, 5, 6]})
    return out.select("pos", "AN_A", F.get("AC_A", F.lit(0)).alias("AC_A"), "AN_B", F.get("AC_B", F.lit(0)).alias("AC_B"))


# --- windows
@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 7) AS mean FROM events", prefix=False)
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("_o", F.struct("ts", "event_id"))
    return windows.moving_average(e, "value", 10, "user_id", "_o").select("event_id", F.round("mean", 7).alias("mean"))


@query(
    "WITH m AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m) SELECT user_id, any_value(event_type) AS label, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, run",
    prefix=False,
)
def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.runs_by(table(spark, sf_dir, "events"), F.col("event_type"), "user_id", ["ts", "event_id"])


@query(", w AS (SELECT chrom, pos, count(*) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS n FROM s) SELECT chrom, pos, max(n) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) AS n_in_window FROM w")
def cluster_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_counts(proxy.sites(spark, sf_dir), 50).select("chrom", "pos", "n_in_window")


@query(
    ", d AS (SELECT chrom, pos, qty AS dp, CASE WHEN dosage = 0 THEN CASE WHEN qty >= 30 THEN 2 WHEN qty >= 20 THEN 1 WHEN qty >= 0 THEN 0 ELSE -1 END ELSE -2 END AS band FROM c WHERE sample = 1), m AS (SELECT *, CASE WHEN band = lag(band) OVER w AND pos <= lag(pos) OVER w + 1 AND band >= 0 THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY chrom ORDER BY pos)), "
    "r AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY pos) AS run FROM m) SELECT chrom, min(pos) AS beg, max(pos) AS \"end\", min(dp)::INT AS min_dp, count(*) AS n, any_value(band)::INT AS band FROM r WHERE band >= 0 GROUP BY chrom, run"
)
def reference_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.reference_blocks(proxy.sites(spark, sf_dir), [0, 20, 30])


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos // 100 ORDER BY qual DESC NULLS LAST, pos) AS rn FROM s) SELECT chrom, count(*) AS n_sites, sum(pos)::BIGINT AS sum_pos FROM r WHERE rn <= 2 GROUP BY chrom")
def thin_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_contig(windows.thinned(proxy.sites(spark, sf_dir), 2, 100, F.col("qual")))


@query()
def ld_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.ld_annotated(proxy.sites(spark, sf_dir), 5).withColumn("r2", F.round("r2", 6))


@query()
def ld_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.ld_pruned(proxy.sites(spark, sf_dir), 0.5, 10)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


__all__ = ["oracle_sql", "queries"]
