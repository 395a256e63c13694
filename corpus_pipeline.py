"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of ``documents``, of which any name may be among those that the stages use. The
deduplicating stages number the rows and write them once, so that repeated doc_ids are told apart.

Defined results: null and empty texts are rejected by the first stage (alone, a later stage keeps one of them: of equal
texts the row with the largest doc_id, null ids before all others, and rows without shingles are nobody's copies); of
rows with equal text and doc_id one stays; an empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm import decontamination, exact_dedup, ngram_join, packing, quality_crf
from siteloom.llm.common import small, stored, table, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_crf.good(docs, table(spark, sf_dir, "labels"))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row number, written, and the number's column."""
    rid = unused(docs, "_rid")
    return stored(docs.withColumn(rid, F.monotonically_increasing_id()), "rows"), rid


def _without(rows: DataFrame, rid: str, gone: DataFrame) -> DataFrame:
    """The numbered ``rows`` without those of ``gone`` (rid); their other columns."""
    key = unused(rows, "_gone")
    gone = stored(gone.select(F.col("rid").alias(key)), "gone")
    return rows.join(small(gone), rows[rid] == gone[key], "left_anti").drop(rid)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    rows, rid = _numbered(docs)
    found = exact_dedup.exact_duplicates(rows.select(rid, "doc_id", "text"), rid=rid)
    return _without(rows, rid, found.where(~F.col("kept")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the shingle join stays: the one with the smallest doc_id."""
    rows, rid = _numbered(docs)
    # the operator sees row numbers as ids, in the order of doc_id within a component only if it is told so: the
    # component's row with the smallest (doc_id, row number) is looked up here
    found = stored(ngram_join.components_of(rows.select(F.col(rid).alias("doc_id"), "text")).select(F.col("doc_id").alias("rid"), "n_shingles", "component_id"), "near")
    grouped = found.join(found.where("rid <> component_id").select("component_id").distinct().hint("merge"), "component_id")
    ids = rows.select(F.col(rid).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"))
    grouped = stored(grouped.join(ids.hint("merge"), "rid").select("rid", "doc_id", "component_id"), "grouped")
    stays = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("s")).select(F.col("s.rid").alias("rid"))
    return _without(rows, rid, grouped.join(stays.hint("merge"), "rid", "left_anti"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("exact_dedup", exact), ("ngram_join", near), ("decontamination", clean), ("packing", packed),
]
#: SQL can't express the classifier; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
