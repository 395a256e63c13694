"""Exact deduplication through a cuckoo-filter index.

Digests are routed to index shards by hash. A shard holds a cuckoo filter of the live digests and, beside it, content
buckets with the full digest (SHA-256 and byte length). A filter miss proves that a text is new. A hit is verified in
the bucket, so a false positive of the filter never drops a text. When a later copy with a larger id takes over, the
digest of the old row is deleted from the index and the new one is inserted. When an insertion finds no room, the
filter is rebuilt twice as large from the keys that the buckets hold.

The index runs twice: once inside each input task (so a text with millions of copies leaves a task as one row), and
once per shard over those summaries. A join then brings the result back to the rows.

Defined results: null text counts as empty; repeated rows (same id, same text) form one group, of which one row stays;
null doc_ids lose against any other id, and a group of null ids keeps one of them with keep_id null; other columns of
the input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import LOWER, UPPER, shuffle_partitions, stored, table


class CuckooFilter:
    """Partial-key cuckoo hashing over 64-bit keys: 16-bit fingerprints, four to a bucket, two buckets a key."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int = 1024) -> None:
        self.bits = max(4, (max(1, capacity) // self.SLOTS).bit_length())
        self.mask = (1 << self.bits) - 1
        self.buckets: list[list[int]] = [[] for _ in range(self.mask + 1)]
        self.count, self.turn = 0, 0

    def places(self, key: int) -> tuple[int, int, int]:
        fp = (key >> 48 & 0xFFFF) or 1
        i = key & self.mask
        return fp, i, self.other(i, fp)

    def other(self, bucket: int, fp: int) -> int:
        """A fingerprint's other bucket; never the same one."""
        return bucket ^ (fp * 0x5BD1E995 & self.mask | 1)

    def contains(self, key: int) -> bool:
        fp, i, j = self.places(key)
        return fp in self.buckets[i] or fp in self.buckets[j]

    def insert(self, key: int) -> bool:
        """False if there was no room; the filter then has to be rebuilt, as some fingerprint is homeless."""
        fp, i, j = self.places(key)
        for b in (i, j):
            if len(self.buckets[b]) < self.SLOTS:
                self.buckets[b].append(fp)
                self.count += 1
                return True
        b = j
        for _ in range(self.KICKS):
            self.turn = self.turn + 1 & 3
            bucket = self.buckets[b]
            fp, bucket[self.turn] = bucket[self.turn], fp
            b = self.other(b, fp)
            if len(self.buckets[b]) < self.SLOTS:
                self.buckets[b].append(fp)
                self.count += 1
                return True
        return False

    def delete(self, key: int) -> bool:
        fp, i, j = self.places(key)
        for b in (i, j):
            if fp in self.buckets[b]:
                self.buckets[b].remove(fp)
                self.count -= 1
                return True
        return False


class DigestIndex:
    """A cuckoo filter of live digests with content buckets that verify its hits."""

    def __init__(self, capacity: int = 1024) -> None:
        self.filter = CuckooFilter(capacity)
        self.buckets: dict[int, list[list]] = {}  # key -> [digest, length, best id, its row, rows]
        self.live = 0

    def find(self, key: int, digest: bytes, length: int) -> list | None:
        if not self.filter.contains(key):
            return None
        for entry in self.buckets.get(key, ()):
            if entry[0] == digest and entry[1] == length:
                return entry
        return None

    def insert(self, key: int, digest: bytes, length: int, best: int | None, rid: int, rows: int) -> None:
        entries = self.buckets.setdefault(key, [])
        entries.append([digest, length, best, rid, rows])
        self.live += 1
        # contents of equal keys share one fingerprint
        if len(entries) == 1 and not self.filter.insert(key):
            self.resize()

    def delete(self, key: int, digest: bytes, length: int) -> bool:
        entries = self.buckets.get(key, [])
        for n, entry in enumerate(entries):
            if entry[0] == digest and entry[1] == length:
                del entries[n]
                self.live -= 1
                if not entries:
                    del self.buckets[key]
                    self.filter.delete(key)
                return True
        return False

    def resize(self) -> None:
        """A larger filter from the stored keys."""
        size = 2 * self.filter.SLOTS * (self.filter.mask + 1)
        while True:
            new = CuckooFilter(size)
            if all(new.insert(key) for key in self.buckets):
                self.filter = new
                return
            size *= 2

    def add(self, key: int, digest: bytes, length: int, best: int | None, rid: int, rows: int) -> None:
        """One more group of ``rows`` equal rows; the largest id stays live, of equal ids the smallest row number."""
        if (entry := self.find(key, digest, length)) is None:
            self.insert(key, digest, length, best, rid, rows)
        elif best == entry[2] and rid < entry[3] or best is not None and (entry[2] is None or best > entry[2]):
            rows += entry[4]
            self.delete(key, digest, length)
            self.insert(key, digest, length, best, rid, rows)
        else:
            entry[4] += rows

    def entries(self) -> Iterator[tuple]:
        for key, found in self.buckets.items():
            for e in found:
                yield (key, *e)


GROUPS = "key long, digest binary, length int, keep_id long, keep_rid long, group_size long"
#: Entries of a task's own index before it is handed on; the shard merges what one task gives in several parts.
TASK_ENTRIES = 200_000


def _indexer(early: bool):
    """Feeds rows of GROUPS to an index and gives its entries. ``early``: hand the index on whenever it is full."""
    names = ["key", "digest", "length", "keep_id", "keep_rid", "group_size"]
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def out(index: DigestIndex) -> Iterator[pa.RecordBatch]:
        rows = list(index.entries())
        for at in range(0, len(rows), 10_000):
            part = zip(*rows[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(part, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = DigestIndex()
        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in names), strict=True):
                index.add(*row)
            if early and index.live > TASK_ENTRIES:
                yield from out(index)
                index = DigestIndex()
        yield from out(index)

    return run


def digests(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """rid, doc_id, key, digest, length of each row; written once, so that rid is stable and texts are read once.

    ``rid``: a column of distinct row numbers, if ``docs`` has one.
    """
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    narrow = (
        docs.select(F.col(rid) if rid else F.lit(None).alias("_none"), F.col("doc_id").cast("long").alias("doc_id"), low.alias("low"))
        .select((F.col(rid) if rid else F.monotonically_increasing_id()).alias("rid"), "doc_id", F.unhex(F.sha2("low", 256)).alias("digest"), F.octet_length("low").cast("int").alias("length"))
        .withColumn("key", F.xxhash64("digest"))
    )
    return stored(narrow, "digests")


def groups(rows: DataFrame, rows_a_shard: int = 1_000_000) -> DataFrame:
    """One row for each distinct content of :func:`digests`: :data:`GROUPS`."""
    spark = rows.sparkSession
    shards = max(shuffle_partitions(spark), rows.count() // rows_a_shard + 1)
    once = rows.select("key", "digest", "length", F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"), F.lit(1).cast("long").alias("group_size"))
    local = once.mapInArrow(_indexer(True), GROUPS)
    return local.repartition(shards, "key").mapInArrow(_indexer(False), GROUPS)


def exact_duplicates(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """rid, doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs`` (doc_id, text)."""
    rows = digests(docs, rid)
    found = stored(groups(rows), "groups")
    joined = rows.join(found.hint("merge"), ["key", "digest", "length"])
    return joined.select("rid", "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays of its equal texts (A-Z lower-cased, null as empty)."""
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("rid")


OP3_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
     g AS (SELECT low, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY low)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.low) AS text_sha256
FROM d JOIN g USING (low)
"""
