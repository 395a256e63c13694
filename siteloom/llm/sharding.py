"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in the order of (doc_id, size, checksum). A Feistel network permutes the row numbers; numbers
that leave 0..n-1 are permuted again until they are back (cycle walking), which keeps it a bijection. Permuted number p
goes to shard ``p % shards``, slot ``p // shards``. So shard and slot of any row number can be computed without the
table (:func:`locate`), and :func:`row_at` goes back. Counts of shards differ by one at most (law ``rows``).

Defined results: null texts have size 1 and the checksum of the empty text; null doc_ids come first; equal rows take
neighbouring row numbers, and which of them takes which doesn't matter; other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import by_batches, small, stored, table

ROUNDS = 4
#: Of the round function: values < 2**31, so that products stay below 2**63 for up to 2**32 half-values.
MULTIPLIERS = (1_103_515_245, 1_664_525_017, 1_140_671_485, 1_597_334_677)
ADDENDS = (12_345, 1_013_904_223, 12_820_163, 907_633_385)
SEED = 42


def half_bits(n: int) -> int:
    """Bits of each half: the least with 4**bits >= n."""
    bits = 1
    while 1 << 2 * bits < n:
        bits += 1
    return bits


def _round(half: np.ndarray, k: int, seed: int, mask: int) -> np.ndarray:
    x = half * MULTIPLIERS[k] + (ADDENDS[k] + seed)
    return (x ^ (x >> 15) ^ (x >> 7)) & mask


def permuted(numbers: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1, or its inverse, for an array of numbers."""
    bits = half_bits(n)
    mask = (1 << bits) - 1
    out = np.array(numbers, np.int64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> bits, x & mask
        for k in range(ROUNDS):
            if inverse:
                left, right = right ^ _round(left, ROUNDS - 1 - k, seed, mask), left
            else:
                left, right = right, left ^ _round(right, k, seed, mask)
        x = left << bits | right
        out[todo] = x
        todo = todo[x >= n]
    return out


def locate(row_number: int, n: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a global row number."""
    p = int(permuted(np.array([row_number]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = SEED) -> int:
    """The global row number at a shard's slot."""
    return int(permuted(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` (a stored table) with their ``row_number`` (from 0) in the order of ``order``, and how many they are.

    Range partitions are numbered from the sum of the partitions before. A salt splits runs of equal rows.
    """
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    keys = [*order, "_salt"]
    placed = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()).drop("_salt")
    placed = stored(placed, "ranged").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # a row for each partition of the table: the driver already keeps as much for each task
    before, total = [], 0
    for part, count in sorted((r["_part"], r["_rows"]) for r in counts.collect()):
        before.append((part, total))
        total += count
    starts = rows.sparkSession.createDataFrame(before or [(0, 0)], "_part long, _before long")
    return placed.join(small(starts), "_part").withColumn("row_number", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at"), total


def sharded(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")), "sizes")
    rows, n = numbered(narrow, ["doc_id", "size", "text_crc32"])

    def place(b):
        p = permuted(b.column("row_number").to_numpy(), n, seed)
        return {c: b.column(c) for c in ("doc_id", "size", "text_crc32", "row_number")} | {"shard": p % shards, "slot": p // shards}

    placed = by_batches(rows, place, "doc_id long, size long, text_crc32 long, row_number long, shard int, slot long")
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 15 whose counts differ by one at most."""
    return sharded(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "row_number")
