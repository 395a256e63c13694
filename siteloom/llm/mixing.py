"""Mixing sources to target weights by Pareto order sampling.

Sources share a budget of words by weight; a source's target stops at ``most`` times its size, and what is over is
shared again by weight among the others. A target of m times a source's size gives each of its documents floor(m)
*certain* whole copies; the rest of the target is sampled: each document has the inclusion odds p / (1 - p), p being the
fraction of m, times its own ``preference`` if there is one. Documents are ranked by random odds u / (1 - u) divided by
their inclusion odds, and the first ones are taken until their words reach the rest, so the sample has a fixed size in
words: the last document is taken if that comes nearer. A source misses its target by half a document at most.

No source is sorted in one task. A rank r lies in a cell of r / (1 + r); words are summed by (source, cell) before they
are shuffled, and only the rows of the cell in which the rest is reached are ordered (about the square root of the
source's rows, as there are as many cells). Rows of equal rank there, which are copies in doc_id, text and source, are
told apart by a salt and summed first, so that a third of all rows may be such copies.

Everything is DataFrame functions. The random number is the MD5 of seed, doc_id and text, so reruns agree however the
rows are dealt.

Defined results: null and empty texts have size 0 and are never taken; null sources are one source, the last; a null
doc_id counts as empty text in the random number; copies in all of doc_id, text and source take the places of their
group in any order, which the result doesn't show; a source without words has the target 0, and so has an empty table no
rows. Other columns are ignored, whatever their names. A null or non-positive preference counts as the smallest double.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteloom.llm.common import small, stored, table

#: Weights of the sources in order, again and again.
WEIGHTS = (5, 2, 1)
SHARE, MOST, SEED = 1.5, 2, 1
WORD = r"[^\x20\x09-\x0D]+"
LEAST = 5e-324


def _totals_before(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``df`` with, for each of ``sums``, the ``<name>_before`` of all rows before in ``order``, and ``_number`` from 0.

    The rows are range-partitioned; a partition's rows are summed by itself, and the sums of the partitions before come
    from a table with one row a partition, so no task sees all rows.
    """
    wanted = [*sums, "_one"]
    placed = df.withColumn("_one", F.lit(1).cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("_part", F.spark_partition_id()), "ranged")
    heads = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_all_{c}") for c in wanted])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_part", *[F.coalesce(F.sum(f"_all_{c}").over(ahead), F.lit(0)).alias(f"_head_{c}") for c in wanted])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(F.broadcast(heads), "_part")
    out = out.withColumns({f"{c}_before": F.col(f"_head_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in wanted})
    return out.withColumn("_number", F.col("_one_before")).drop("_part", "_one", "_one_before", *[f"_head_{c}" for c in wanted])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target of each row of ``sources`` (source, source_size).

    A source that reaches its bound does so in the order of bound by weight: those before it have reached theirs. So one
    running sum of bounds and weights says which sources do, and the others share what is left by weight.
    """
    placed = _totals_before(sources.select("source", "source_size"), [F.col("source").asc_nulls_last()], [])
    weighed = placed.withColumn("_weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_number") % len(weights) + 1).cast("int"))).withColumn("_bound", most * F.col("source_size")).drop("_number")
    order = [(F.col("_bound") / F.col("_weight")).asc(), F.col("source").asc_nulls_last()]
    ranked = stored(_totals_before(weighed, order, ["_bound", "_weight"]), "sources")
    words, shares = (x or 0 for x in ranked.agg(F.sum("source_size"), F.sum("_weight")).first())
    budget = share * words
    # bound / weight against what is left / weights left, without a division
    over = F.col("_bound").cast("double") * (shares - F.col("_weight_before")) <= (budget - F.col("_bound_before")) * F.col("_weight")
    ranked = ranked.withColumn("_full", over)
    bounds, full = (x or 0 for x in ranked.where("_full").agg(F.sum("_bound"), F.sum("_weight")).first())
    part = F.lit(budget - bounds) * F.col("_weight") / max(shares - full, 1)
    return ranked.select("source", "source_size", F.when(F.col("_full"), F.col("_bound").cast("double")).otherwise(part).alias("target"))


def _cell(rank: Column, cells: int) -> Column:
    return F.least(F.floor(rank * cells), F.lit(cells - 1)).cast("long")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, preference: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of ``docs`` (doc_id, text, source).

    ``preference`` names a column of positive numbers by which a document's inclusion odds are multiplied.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    liked = F.lit(1.0) if preference is None else F.greatest(F.coalesce(F.col(preference).cast("double"), F.lit(LEAST)), F.lit(LEAST))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), digest.alias("digest"), liked.alias("liked")), "sizes")
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    plan = targets(sized, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = stored(plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "plan")

    # the order of each row: random odds by inclusion odds, q, as q / (1 + q)
    p = F.col("rest") / F.col("source_size")
    u = (F.conv(F.substring("digest", 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    q = u / (1 - u) / (p / F.greatest(1 - p, F.lit(2.0**-53)) * F.col("liked"))
    same = rows["source"].eqNullSafe(plan["source"])
    ranked = rows.join(small(plan), same).select(rows["doc_id"], rows["source"], "size", "digest", "source_size", "target", "whole", "rest", F.when(F.col("rest") > 0, q / (1 + q)).alias("rank"))

    largest = sized.agg(F.max("_rows")).first()[0] or 1
    cells = max(16, math.isqrt(largest))
    ranked = ranked.withColumn("cell", _cell(F.col("rank"), cells))
    sums = ranked.where("rank is not null").groupBy("source", "cell").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    up_to = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
    cut = sums.withColumn("up_to", up_to).where("up_to >= rest").groupBy("source").agg(F.min(F.struct("cell", (F.col("up_to") - F.col("words")).alias("before"))).alias("c"))
    cut = stored(cut.select(F.col("source").alias("_source"), F.col("c.cell").alias("cut"), F.col("c.before").alias("before")), "cuts")
    placed = ranked.join(small(cut), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    sure = placed.where("cut is null or cell is null or cell <> cut").withColumn("extra", F.coalesce((F.col("cell") < F.col("cut")).cast("long"), F.lit(0)))

    # the cell in which the rest is reached: its rows in order, copies summed by a salt before
    border = stored(placed.where("cell = cut").withColumn("id", F.monotonically_increasing_id()).withColumn("salt", F.xxhash64("id") % cells), "border")
    keys = ["source", "rank", "digest", "salt"]
    groups = border.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.first("size").alias("size"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    ahead = F.coalesce(F.sum(F.col("rows") * F.col("size")).over(Window.partitionBy("source").orderBy("rank", "digest", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = F.floor((F.col("rest") - F.col("before") - ahead) / F.col("size") + 0.5)
    groups = groups.withColumn("some", F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(some, "rows"))).otherwise(0))
    groups = groups.select(F.col("source").alias("_source"), *[F.col(k).alias(f"_{k}") for k in keys[1:]], "some")
    met = border.join(groups.hint("merge"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("rank") == F.col("_rank")) & (F.col("digest") == F.col("_digest")) & (F.col("salt") == F.col("_salt")))
    number = F.row_number().over(Window.partitionBy("source", "digest", "salt").orderBy("id"))
    met = met.withColumn("extra", (number <= F.col("some")).cast("long"))

    columns = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies")]
    return sure.select(*columns).unionByName(met.select(*columns)).withColumn("taken", F.col("copies") * F.col("size"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed by source to half as many words again."""
    return mixed(table(spark, sf_dir, "documents")).drop("source", "copies")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS digest FROM documents),
     n AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
     b AS (SELECT *, 2 * source_size AS bound, coalesce(sum(2 * source_size) OVER o, 0) AS bounds_before, coalesce(sum(w) OVER o, 0) AS w_before, sum(source_size) OVER () AS total, sum(w) OVER () AS ws
           FROM n WINDOW o AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     f AS (SELECT *, bound * (ws - w_before) <= (1.5::DOUBLE * total - bounds_before) * w AS is_full FROM b),
     t AS (SELECT source, source_size, CASE WHEN is_full THEN bound::DOUBLE ELSE (1.5::DOUBLE * total - coalesce(sum(bound) FILTER (WHERE is_full) OVER (), 0)::BIGINT) * w / (ws - coalesce(sum(w) FILTER (WHERE is_full) OVER (), 0)) END AS target FROM f),
     p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole, target - whole * source_size AS rest, rest / source_size AS p FROM t),
     q AS (SELECT d.*, source_size, target, whole, rest, (('0x' || digest[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u, u / (1 - u) / (p / (1 - p)) AS odds, odds / (1 + odds) AS rank FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
     c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN rest > 0 AND size > 0 AND before + size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
