"""A bounded sample of labelled documents for the classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import stored


def fold(folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def held_out(doc_ids: list, folds: int, left_out: int) -> list[bool | None]:
    import zlib

    return [None if d is None else zlib.crc32(str(d).encode()) % folds == left_out for d in doc_ids]


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, left_out: int, most: dict[int, int], max_bytes: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``most[class]`` documents of each class, outside the fold ``left_out``.

    They are taken in the order of a hash of the id, whatever their length. Of a text of more than ``max_bytes`` bytes so
    many characters are taken as make ``max_bytes`` at the text's bytes a character, from a place that a hash of the id
    gives; a text just over the bound gives nearly all. Null labels and ids are left out; an id with several labels counts with the largest.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).where(fold(folds) != left_out)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    known = stored(known.join(texts.select("doc_id").hint("merge"), "doc_id", "left_semi"), "labelled")
    # bytes times characters pass 2**31 in long texts
    size = F.floor(F.lit(max_bytes).cast("long") * F.length("text") / F.greatest(F.octet_length("text"), F.lit(1))).cast("int")
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - size, F.lit(0)) + 1).cast("int") + 1
    part = F.when(F.octet_length("text") <= max_bytes, F.col("text")).otherwise(F.substr("text", start, size))
    out_texts, out_labels = [], []
    for y, n in most.items():
        ids = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        # at most n rows are broadcast, and at most n texts of about max_bytes come back
        rows = texts.join(F.broadcast(ids), "doc_id").withColumn("text", part).dropDuplicates(["doc_id"]).select("doc_id", "text").collect()
        for r in sorted(rows, key=lambda r: r["doc_id"]):
            out_texts.append(r["text"])
            out_labels.append(y)
    return out_texts, out_labels
