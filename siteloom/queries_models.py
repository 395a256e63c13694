"""Registered queries of haplotype consequences, gVCF blocks, read likelihoods and other models, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom import proxy
from siteloom.functions import genotype as g
from siteloom.operators import calling, denovo, distinctive, gvcf, haplotypes, indels, likelihoods, merge
from siteloom.operators.sequence import AMINO_ACIDS
from siteloom.queries import query

#: Every 60 bases of a contig a transcript of ten codons begins; the reference has A, C, G, T in turn.
SPAN, CODING = 60, 30


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of the transcripts of all contigs, from their reference in chunks."""
    ends = proxy.table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("chrom")).agg(F.max("o_orderkey").alias("n"))
    chunks = ends.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / SPAN) + 1)).alias("chunk")).withColumn("seq", F.lit("CGTA" * (SPAN // 4)))
    at = F.col("chunk") * SPAN
    name = F.concat("chrom", F.lit("-"), F.col("chunk").cast("string"))
    cds = chunks.select(name.alias("transcript"), name.alias("gene"), F.lit("protein_coding").alias("biotype"), "chrom", (at + 1).alias("beg"), (at + CODING).alias("end"), F.lit("+").alias("strand"), F.lit(0).alias("phase"))
    return haplotypes.coding_models(cds, chunks, SPAN)


_AA = f"substring('{AMINO_ACIDS}', 16 * (strpos('TCAG', {{0}}[1]) - 1) + 4 * (strpos('TCAG', {{0}}[2]) - 1) + strpos('TCAG', {{0}}[3]), 1)"


@query(
    ", v AS (SELECT chrom, pos, alt, sample, copy FROM c CROSS JOIN (VALUES (0), (1)) k(copy) WHERE len(alt) = 1 AND dosage >= 2 - copy AND pos % 60 BETWEEN 1 AND 30), "
    "x AS (SELECT DISTINCT chrom, sample, copy, pos // 60 AS t, (pos % 60 - 1) // 3 AS codon FROM v), "
    "b AS (SELECT x.*, i, 60 * t + 3 * codon + 1 + i AS p FROM x CROSS JOIN range(3) r(i)), "
    "s3 AS (SELECT b.chrom, b.sample, b.copy, t, codon, string_agg(['A', 'C', 'G', 'T'][p % 4 + 1], '' ORDER BY i) AS was, string_agg(coalesce(v.alt, ['A', 'C', 'G', 'T'][p % 4 + 1]), '' ORDER BY i) AS now FROM b LEFT JOIN v ON v.chrom = b.chrom AND v.sample = b.sample AND v.copy = b.copy AND v.pos = p GROUP BY ALL), "
    f"a AS (SELECT *, {_AA.format('was')} AS w, {_AA.format('now')} AS n FROM s3), "
    "m AS (SELECT *, CASE WHEN w = n THEN 'synonymous' WHEN n = '*' AND codon = 9 THEN 'stop_retained' WHEN n = '*' THEN 'stop_gained' ELSE 'missense' END AS kind, coalesce(max(CASE WHEN n = '*' THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, sample, copy, t ORDER BY codon ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late FROM a) "
    "SELECT chrom, CASE WHEN late = 1 THEN '*' ELSE '' END || kind AS consequence, (codon + 1) || w || CASE WHEN w = n THEN '' ELSE '>' || (codon + 1) || n END AS amino, count(*) AS n FROM m GROUP BY ALL"
)
def haplotype_codons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consequences of the SNPs of each copy, those of one codon together, after stops marked."""
    s = proxy.sites(spark, sf_dir).where("length(alts[0]) = 1").select("chrom", "pos", "ref", "alts", "samples")
    told = haplotypes.haplotype_consequences(s, _transcripts(spark, sf_dir)).where("told_at is null")
    return told.groupBy(F.substring_index("transcript", "-", 1).alias("chrom"), F.substring_index("consequence", "|", 1).alias("consequence"), "amino").agg(F.count(F.lit(1)).alias("n"))


# --- blocks of three tables
def _block_table(spark: SparkSession, sf_dir: str, t: int) -> DataFrame:
    """Orders as blocks of two to eight bases, every fifth of them a site."""
    key = F.col("o_orderkey")
    pos = key * 10 + 3 * t
    a_site = key % 5 == t
    orders = proxy.table(spark, sf_dir, "orders").where(key % 3 != t)
    gt = F.struct(F.when(a_site, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(0))).alias("alleles"), F.lit(False).alias("phased"))
    return orders.select(
        F.col("o_orderstatus").alias("chrom"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("contig_idx"), pos.alias("pos"), (pos + F.when(a_site, 0).otherwise(1 + key % 7)).alias("end"), F.lit(None).cast("string").alias("id"),
        F.lit("A").alias("ref"), F.when(a_site, F.array(F.lit("C"))).otherwise(F.array(F.lit("<*>"))).alias("alts"), F.lit(None).cast("float").alias("qual"), F.array().cast("array<string>").alias("filters"),
        F.struct((key % 50).cast("int").alias("MinDP")).alias("info"), F.array(F.struct(gt.alias("GT"), (key % 40).cast("int").alias("DP"))).alias("samples"),
    )


@query(
    "WITH k AS (SELECT o_orderstatus AS chrom, o_orderkey AS key, t, o_orderkey * 10 + 3 * t AS pos, o_orderkey % 5 = t AS site, CASE WHEN o_orderkey % 5 = t THEN o_orderkey * 10 + 3 * t ELSE o_orderkey * 10 + 3 * t + 1 + o_orderkey % 7 END AS e FROM orders CROSS JOIN range(3) r(t) WHERE o_orderkey % 3 <> t), "
    "p AS (SELECT DISTINCT chrom, pos AS lo FROM k UNION SELECT DISTINCT chrom, e + 1 FROM k), s AS (SELECT chrom, lo, lead(lo) OVER (PARTITION BY chrom ORDER BY lo) - 1 AS until FROM p), "
    "m AS (SELECT s.chrom, lo, until, t, key, site FROM s JOIN k ON k.chrom = s.chrom AND k.pos <= s.lo AND k.e >= s.lo AND k.pos > s.lo - 12) "
    "SELECT chrom, lo AS pos, until AS \"end\", min(key % 50)::INT AS min_dp, string_agg((key % 40)::VARCHAR, ',' ORDER BY t) AS dp, string_agg(t::VARCHAR, ',' ORDER BY t) AS tables, count(*) FILTER (WHERE site) AS ac, "
    "max(CASE WHEN site THEN 1 ELSE 0 END) = 1 AS is_site FROM m GROUP BY chrom, lo, until",
    prefix=False,
)
def merge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables of blocks and sites side by side."""
    out = gvcf.merge_blocks([_block_table(spark, sf_dir, t) for t in range(3)], [1, 1, 1], "both", {"MinDP": "min"})
    called = F.filter(F.transform("samples", lambda s, i: F.struct(i.alias("t"), s["DP"].alias("dp"), s["GT"]["alleles"].alias("a"))), lambda x: x["dp"].isNotNull())
    text = lambda f: F.array_join(F.transform(called, lambda x: x[f].cast("string")), ",")
    ac = F.size(F.filter(called, lambda x: F.exists(x["a"], lambda y: y > 0))).cast("long")
    return out.select("chrom", "pos", "end", F.col("info.MinDP").alias("min_dp"), text("dp").alias("dp"), text("t").alias("tables"), ac.alias("ac"), F.array_contains("alts", "C").alias("is_site"))


# --- likelihoods of reads
_OFF = "CASE l_linenumber % 3 WHEN 0 THEN i WHEN 1 THEN CASE WHEN i < 5 THEN i ELSE i + 1 END ELSE CASE WHEN i < 4 THEN i WHEN i < 6 THEN NULL ELSE i - 2 END END"


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reads of twelve bases, with a deletion, an insertion or neither; the reference has A, C, G, T in turn."""
    t = proxy.table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_orderkey") * 4 + F.col("l_linenumber")).withColumn("q", F.col("l_quantity").cast("int"))
    seq = f"array_join(transform(sequence(0, 11), i -> coalesce(substring('ACGT', cast((p + ({_OFF}) + if((q + i) % 9 = 0, 1, 0)) % 4 as int) + 1, 1), 'A')), '')"
    qual = "array_join(transform(sequence(0, 11), i -> char(33 + 10 + (q * (i + 1)) % 30)), '')"
    return t.select(
        F.concat(F.lit("L"), (F.col("l_suppkey") % 3).cast("string")).alias("chrom"), F.col("p").alias("pos"), (F.col("l_partkey") % 2).cast("string").alias("sample"),
        F.expr("CASE l_linenumber % 3 WHEN 0 THEN '12M' WHEN 1 THEN '5M1D7M' ELSE '4M2I6M' END").alias("cigar"), F.expr(seq).alias("seq"), F.expr(qual).alias("qual"), F.lit(60).alias("mapq"), (F.col("l_suppkey") % 2 == 1).alias("reverse"),
    )


_TAIL = "list_sum(list_transform(range({k}, (n + 1)::BIGINT), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(e) + (n - x) * ln(1 - e))))"


@query(
    f"WITH b AS (SELECT 'L' || l_suppkey % 3 AS chrom, l_orderkey * 4 + l_linenumber + ({_OFF}) AS pos, (l_partkey % 2)::VARCHAR AS sample, (l_orderkey * 4 + l_linenumber + ({_OFF}) + CASE WHEN (l_quantity::INT + i) % 9 = 0 THEN 1 ELSE 0 END) % 4 AS base, "
    f"10 + (l_quantity::INT * (i + 1)) % 30 AS q, l_suppkey % 2 AS strand, row_number() OVER () AS k, i FROM lineitem CROSS JOIN range(12) r(i) WHERE ({_OFF}) IS NOT NULL), "
    "w AS (SELECT *, count(*) OVER (PARTITION BY chrom, pos, sample) AS n, row_number() OVER (PARTITION BY chrom, pos, sample, base ORDER BY q DESC, strand DESC, k, i) - 1 AS c, row_number() OVER (PARTITION BY chrom, pos, sample, base, strand ORDER BY q DESC, k, i) - 1 AS w, power(10, -q / 10) AS e FROM b), "
    f"v AS (SELECT *, (0.97 * power(1 - 0.83, w) + 0.03) * -10 / ln(10) * (ln({_TAIL.format(k='c + 1')}) - ln({_TAIL.format(k='c')})) AS said FROM w), "
    "g AS (SELECT chrom, pos, sample, sum(said) AS total, " + ", ".join(f"coalesce(sum(said) FILTER (WHERE base = {k}), 0) AS a{k}, count(*) FILTER (WHERE base = {k}) AS n{k}" for k in range(4)) + " FROM v GROUP BY ALL), "
    "h AS (SELECT *, [" + ", ".join(f"greatest(total - a{a} - a{b} - 4.343 * (lgamma(n{a} + n{b} + 1) - lgamma(n{a} + 1) - lgamma(n{b} + 1) - ln(2) * (n{a} + n{b})), 0)" if a < b else f"greatest(total - a{a}, 0)" for b in range(4) for a in range(b + 1)) + "] AS l FROM g) "
    "SELECT chrom, pos, sample, n0 || ',' || n1 || ',' || n2 || ',' || n3 AS depth, array_to_string(list_transform(l, lambda x: floor(x - list_min(l) + 0.499)::BIGINT), ',') AS pl FROM h",
    prefix=False,
)
def read_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phred likelihoods of the ten pairs of bases at each position and sample."""
    found = likelihoods.sample_likelihoods(likelihoods.base_codes(_reads(spark, sf_dir)))
    pairs = F.array(*[F.lit(a * 5 + b) for b in range(4) for a in range(b + 1)])
    values = F.transform(pairs, lambda i: F.get("likelihoods", i))
    # an array of one element, so that the values and their least are computed once
    least = F.transform(F.array(values), lambda v: F.struct(v.alias("v"), F.array_min(v).alias("least")))
    text = F.get(F.transform(least, lambda x: F.array_join(F.transform(x["v"], lambda v: F.floor(v - x["least"] + 0.499).cast("string")), ",")), F.lit(0))
    return found.select("chrom", "pos", "sample", F.array_join(F.transform("depth", lambda x: x.cast("string")), ",").alias("depth"), text.alias("pl"))


@query()
def read_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: genotypes called from the reads, base qualities lowered by alignment quality; the parts are held against enumerations."""
    reads = _reads(spark, sf_dir)
    ends = reads.groupBy("chrom").agg(F.max("pos").alias("n"))
    chunks = ends.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") + 40) / 1000))).alias("chunk")).withColumn("seq", F.lit("CGTA" * 250))
    found = likelihoods.sample_likelihoods(likelihoods.base_codes(reads, chunks, 1000, baq=True))
    bases = chunks.select("chrom", "chunk", F.posexplode(F.split("seq", ""))).select("chrom", (F.col("chunk") * 1000 + F.col("pos") + 1).alias("pos"), F.col("col").alias("base"))
    sites = likelihoods.likelihood_sites(found, ["0", "1"], bases)
    return calling.multiallelic_calls(sites).select("chrom", "pos", "alleles", "gts", F.round("qual", 3).alias("qual"))


# --- indels of reads
@query(
    "WITH r AS (SELECT 'L' || l_suppkey % 3 AS chrom, l_orderkey * 4 + l_linenumber AS b, l_orderkey * 4 + l_linenumber + CASE l_linenumber % 3 WHEN 0 THEN 11 WHEN 1 THEN 12 ELSE 9 END AS e, (l_partkey % 2)::VARCHAR AS sample, l_linenumber % 3 AS kind FROM lineitem), "
    "i AS (SELECT chrom, CASE kind WHEN 1 THEN b + 4 ELSE b + 3 END AS pos, sample, kind, count(*) AS n FROM r WHERE kind > 0 GROUP BY ALL), s AS (SELECT chrom, pos, sample, sum(n) AS n FROM i GROUP BY ALL), "
    "p AS (SELECT chrom, pos FROM s GROUP BY ALL HAVING max(n) >= 2), d AS (SELECT p.chrom, p.pos, r.sample, count(*) AS depth FROM p JOIN r ON r.chrom = p.chrom AND r.b <= p.pos AND r.e >= p.pos AND r.b > p.pos - 13 GROUP BY ALL), "
    "f AS (SELECT d.chrom, d.pos, depth, coalesce(n, 0) AS n FROM d LEFT JOIN s USING (chrom, pos, sample)) "
    "SELECT chrom, pos, max(n)::BIGINT AS idv, round(max(n / depth), 6) AS imf, sum(depth)::BIGINT AS depth, (SELECT count(DISTINCT kind) FROM i WHERE i.chrom = f.chrom AND i.pos = f.pos) AS n_types FROM f GROUP BY chrom, pos HAVING max(CASE WHEN n >= 2 AND n / depth >= 0.05 THEN 1 ELSE 0 END) = 1",
    prefix=False,
)
def indel_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions at which reads show indels: the most reads of a sample, their share, the depth."""
    found = indels.candidates(indels.spans(_reads(spark, sf_dir)))
    return found.select("chrom", F.col("at").alias("pos"), "idv", F.round("imf", 6).alias("imf"), "depth", F.size("types").cast("long").alias("n_types"))


@query()
def indel_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: reads realigned to the haplotypes of each candidate; distances and likelihoods are held against plain versions."""
    reads = _reads(spark, sf_dir)
    chunks = reads.groupBy("chrom").agg(F.max("pos").alias("n")).select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") + 200) / 1000))).alias("chunk")).withColumn("seq", F.lit("CGTA" * 250))
    out = indels.indel_sites(reads, chunks, 1000, ["0", "1"])
    return out.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alts"), "info.IDV", F.round("info.IMF", 6).alias("IMF"), F.to_json("samples").alias("samples"))


@query()
def consensus_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: the spectrum of allele counts is a recursion over samples; it is held against enumeration."""
    pl = lambda x: F.when(g.dosage(x["GT"]).isNotNull(), F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (F.abs(k - g.dosage(x["GT"])) * x["DP"]).cast("int")))
    s = proxy.sites(spark, sf_dir)
    out = calling.consensus_calls(s.withColumn("samples", F.transform("samples", lambda x: F.struct(pl(x).alias("PL")))), first_group=[0, 1, 2])
    return out.select("chrom", "pos", F.round("qual", 3).alias("qual"), F.round("af", 6).alias("af"), F.array_join("gts", " ").alias("gts"), F.round("chi2", 4).alias("chi2"))


_TRIO = "SELECT pos, max(CASE WHEN sample = 1 THEN dosage END) AS c, max(CASE WHEN sample = 2 THEN dosage END) AS f, max(CASE WHEN sample = 3 THEN dosage END) AS m, max(CASE WHEN sample = 1 THEN qty END) AS cq, max(CASE WHEN sample = 2 THEN qty END) AS fq, max(CASE WHEN sample = 3 THEN qty END) AS mq FROM c GROUP BY pos"
_PRIOR = "CASE WHEN f + m = 0 THEN 0.998 ELSE (0.002 - 0.002 * 0.002) / 3 * CASE f + m WHEN 1 THEN 4.0 / 15 WHEN 2 THEN CASE WHEN m <> 1 THEN 2.0 / 15 ELSE 4.0 / 15 END WHEN 3 THEN 4.0 / 15 ELSE 1.0 / 15 END END"


@query(
    f", t AS ({_TRIO}), g AS (SELECT f.g AS f, m.g AS m, k.g AS k FROM (VALUES (0), (1), (2)) f(g) CROSS JOIN (VALUES (0), (1), (2)) m(g) CROSS JOIN (VALUES (0), (1), (2)) k(g)), "
    "u AS (SELECT *, f IN (0, 1) AS f0, f IN (1, 2) AS f1, m IN (0, 1) AS m0, m IN (1, 2) AS m1 FROM g), "
    "v AS (SELECT *, CASE k WHEN 0 THEN f0 AND m0 WHEN 2 THEN f1 AND m1 ELSE (f0 AND m1) OR (f1 AND m0) END AS passed, CASE k WHEN 0 THEN f0 OR m0 WHEN 2 THEN f1 OR m1 ELSE true END AS one FROM u), "
    f"w AS (SELECT f, m, k, passed, ({_PRIOR}) * CASE WHEN passed THEN (1 - 1e-8) * power(0.5, CASE WHEN f = 1 THEN 1 ELSE 0 END + CASE WHEN m = 1 THEN 1 ELSE 0 END) WHEN one THEN 1e-8 ELSE 1e-16 END AS w FROM v), "
    "j AS (SELECT t.pos, passed, w * power(10, -(abs(w.f - t.f) * t.fq + abs(w.m - t.m) * t.mq + abs(w.k - t.c) * t.cq) / 10) AS p FROM t CROSS JOIN w WHERE t.c IS NOT NULL AND t.f IS NOT NULL AND t.m IS NOT NULL) "
    "SELECT pos, round(ln(max(CASE WHEN NOT passed THEN p END) / sum(p)), 4) AS dnm FROM j GROUP BY pos"
)
def trio_de_novo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely the first sample has an allele that the second and the third can't have given."""
    pl = lambda x: F.when(g.dosage(x["GT"]).isNotNull(), F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (F.abs(k - g.dosage(x["GT"])) * x["DP"]).cast("int")))
    s = proxy.sites(spark, sf_dir).withColumn("samples", F.transform("samples", lambda x: F.struct(pl(x).alias("PL"))))
    return denovo.de_novo(s, [(0, 1, 2, "f")]).select("pos", F.round("dnm", 4).alias("dnm"))


@query(
    ", p AS (SELECT pos, sample, qty, list_transform(range(10), lambda k: (qty * (7 * k + 3) + price % 1009 + k * k) % 61) AS pl FROM c WHERE sample <= 3 AND qty IS NOT NULL), "
    "x AS (SELECT *, list_transform([1, 2, 3], lambda a: list_sum(list_transform(range(10), lambda k: power(10, -pl[k + 1] / 10) * (CASE WHEN [0, 1, 1, 2, 2, 2, 3, 3, 3, 3][k + 1] = a THEN 1 ELSE 0 END + CASE WHEN [0, 0, 1, 0, 1, 2, 0, 1, 2, 3][k + 1] = a THEN 1 ELSE 0 END)))) AS w FROM p), "
    "y AS (SELECT *, CASE WHEN w[1] >= w[2] AND w[1] >= w[3] THEN 1 WHEN w[2] >= w[3] THEN 2 ELSE 3 END AS a FROM x) "
    "SELECT pos, sample - 1 AS sample, a AS laa, pl[1] || ',' || pl[a * (a + 1) // 2 + 1] || ',' || pl[a * (a + 3) // 2 + 1] AS lpl FROM y"
)
def local_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ALTs, of which each sample keeps its likeliest."""
    values = lambda x, price: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: ((x["DP"] * (7 * k + 3) + price + k * k) % 61).cast("int"))
    calls = proxy.calls_long(spark, sf_dir).where("l_linenumber <= 3").groupBy(F.col("l_orderkey").alias("pos")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("i"), F.col("qty").cast("int").alias("DP"), (F.col("price") % 1009).alias("price"))).alias("x"))
    orders = proxy.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"))
    df = orders.join(calls, "pos").select("pos", F.array(*[F.lit(a) for a in ("C", "G", "T")]).alias("alts"), F.transform("x", lambda x: F.struct(x["i"].alias("i"), values(x, x["price"]).alias("PL"))).alias("samples"))
    out = merge.localized(df, 1, {"PL": "G"}).select("pos", F.explode("samples").alias("s"))
    return out.select("pos", (F.col("s.i") - 1).alias("sample"), F.get("s.LAA", F.lit(0)).alias("laa"), F.array_join(F.transform("s.LPL", lambda v: v.cast("string")), ",").alias("lpl"))


@query()
def distinctive_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: a greedy choice, site after site; it is held against a plain one."""
    found = distinctive.distinctive_sites(proxy.sites(spark, sf_dir), blocks=2)
    return spark.createDataFrame(found, "chrom string, pos long, ref string, alts string, n_pairs long, block int")
