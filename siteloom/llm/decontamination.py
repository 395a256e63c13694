"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents may be long, so Jaccard similarity says little and containment is searched:
|item's shingles found in the document| / |item's shingles| >= threshold. Items are partitioned by the size of their
shingle set. Each size class has its own number of MinHash values (the smallest hashes of the item's shingles) and its
own number of them that a document has to hold, set so that a document at the threshold is missed with a probability
below ``miss``; the smallest classes keep all shingles and miss nothing. Documents are partitioned by size too: long
ones are read in overlapping segments, so that a probe works on bounded arrays.

One pass over the documents probes the signature values, then verifies candidates by exact shingle containment on the
words themselves. Items are taken in blocks of bounded size, each of which is broadcast; a larger benchmark means more
passes, not a larger broadcast. No text is shuffled.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a shingle is five words, and an item with fewer words is one
shingle of all its words, looked up among the document's runs of that length.

Defined results: null and empty items and documents match nothing; repeated rows (documents or items) are reported as
often as they come; other columns are ignored, whatever their names; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import ASCII_LOWER, Words, arrow_type, ngram_hashes, table, tidied, unused

SHINGLE, THRESHOLD, MISS = 5, 0.75, 1e-9
#: Shingles of the items of one block, which bounds the broadcast (about 100 bytes each).
BLOCK_SHINGLES = 500_000
#: Words of a document's segment.
SEGMENT = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(ASCII_LOWER).split()


def shingles_of(words: list[bytes], n: int = SHINGLE) -> set[tuple[bytes, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def signature_size(size: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(signature values, values that a document must hold) for a class of items with at least ``size`` shingles.

    A document that holds ``threshold`` of the shingles holds each value with at least that probability.
    """
    if size <= 16:
        return size, max(1, -(-int(threshold * 1000) * size // 1000))
    values = 24 if size < 64 else 32
    need = 1
    while sum(comb(values, j) * threshold**j * (1 - threshold) ** (values - j) for j in range(need + 1)) < miss:
        need += 1
    return values, need


class Block:
    """Items with their signatures, as it is sent to the executors."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float) -> None:
        self.threshold = threshold
        self.ids, self.sets, self.need = [], [], []
        values: dict[int, list[tuple[int, int]]] = {}  # words of a shingle -> (hash, item)
        for item, text in items:
            words = words_of(text)
            n = min(SHINGLE, len(words))
            if not n:
                continue
            found = shingles_of(words)
            h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
            hashes = np.unique(ngram_hashes(h, n))
            low = 1 << (len(hashes).bit_length() - 1)  # the size class: low .. 2 * low - 1
            count, need = signature_size(len(hashes) if len(hashes) <= 16 else low, threshold)
            k = len(self.ids)
            self.ids.append(item)
            self.sets.append((n, found))
            self.need.append(need)
            values.setdefault(n, []).extend((int(x), k) for x in hashes[:count])
        self.probe = {}
        for n, pairs in values.items():
            pairs.sort()
            self.probe[n] = (np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64))
        self.filters = {}
        for n, (h, _) in self.probe.items():
            bits = max(16, (16 * len(h)).bit_length())
            f = np.zeros(1 << bits, bool)
            f[h >> np.uint64(64 - bits)] = True
            self.filters[n] = (np.uint64(64 - bits), f)

    def candidates(self, words: np.ndarray) -> list[int]:
        """Items of whose signatures the words (as hashes) hold enough values."""
        out = []
        for n, (h, owner) in self.probe.items():
            shift, bitmap = self.filters[n]
            met: list[np.ndarray] = []
            for at in range(0, max(1, len(words)), SEGMENT):
                grams = ngram_hashes(words[at : at + SEGMENT + n - 1], n)
                grams = grams[bitmap[grams >> shift]]
                if len(grams):
                    met.append(grams)
            if not met:
                continue
            grams = np.unique(np.concatenate(met))
            lo, hi = np.searchsorted(h, grams, "left"), np.searchsorted(h, grams, "right")
            hits = [owner[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a]
            if hits:
                ids, counts = np.unique(np.concatenate(hits), return_counts=True)
                out += [k for k, c in zip(ids.tolist(), counts.tolist(), strict=True) if c >= self.need[k]]
        return out

    def verified(self, text: str, candidates: list[int]) -> list[tuple[int, int, int]]:
        """(item, shingles, of them in the text) of the candidates that are contained."""
        words, sets, out = words_of(text), {}, []
        for k in candidates:
            n, wanted = self.sets[k]
            if n not in sets:
                sets[n] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
            common = len(wanted & sets[n])
            if common >= self.threshold * len(wanted):
                out.append((self.ids[k], len(wanted), common))
        return out


def blocks(items: DataFrame, threshold: float = THRESHOLD, limit: int = BLOCK_SHINGLES) -> Iterator[Block]:
    """Blocks of bounded size; the driver holds one at a time."""
    part, size = [], 0
    for r in items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        part.append((r[0], r[1]))
        size += len((r[1] or "").split())
        if size >= limit:
            yield Block(part, threshold)
            part, size = [], 0
    yield Block(part, threshold)


MATCHES = "array<struct<item_id:bigint,n_shingles:int,n_found:int>>"


def matched(docs: DataFrame, block: Block, name: str = "matches") -> DataFrame:
    """``docs`` with a column of the block's items that each text contains."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(block)
    kind = T._parse_datatype_string(MATCHES)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])
    arrow = arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                column = b.column("text")
                words = Words(column, lower=True)
                hashes, found = words.hashes(), []
                for i in range(b.num_rows):
                    k = block.candidates(hashes[words.starts[i] : words.starts[i + 1]])
                    hits = block.verified(column[i].as_py() or "", k) if k else []
                    found.append([{"item_id": a, "n_shingles": n, "n_found": c} for a, n, c in hits])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, type=arrow)], names=[*b.schema.names, name])

    return docs.mapInArrow(tidied(run), schema)


def contaminations(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment for each item that a document of ``docs`` contains."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in blocks(items, threshold):
        part = matched(narrow, block).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.n_shingles", "m.n_found", (F.col("m.n_found") / F.col("m.n_shingles")).alias("containment"))
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns pass."""
    names, kept, found = docs.columns, docs, unused(docs, "_llm_matches")
    for block in blocks(items, threshold):
        kept = matched(kept, block, found).where(F.size(found) == 0).select(*[F.col(f"`{c}`") for c in names])
    return kept


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item of which it contains 75 % of the five-word shingles or more."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = """
WITH w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
     v AS (SELECT item_id AS id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
     vn AS (SELECT id, ws, least(5, len(ws))::BIGINT AS n FROM v WHERE len(ws) > 0),
     vs AS (SELECT DISTINCT id, n, array_to_string(ws[i : i + n - 1], ' ') AS s FROM vn, unnest(range(1, len(ws) - n + 2)) AS t(i)),
     ns AS (SELECT DISTINCT n FROM vs),
     ds AS (SELECT DISTINCT w.id, ns.n, array_to_string(ws[i : i + ns.n - 1], ' ') AS s FROM w, ns, unnest(range(1, len(ws) - ns.n + 2)) AS t(i)),
     size AS (SELECT id, count(*) AS n_shingles FROM vs GROUP BY id),
     hit AS (SELECT ds.id AS doc_id, vs.id AS item_id, count(*) AS n_found FROM ds JOIN vs USING (n, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles::INTEGER AS n_shingles, n_found::INTEGER AS n_found, n_found / n_shingles AS containment
FROM hit JOIN size ON size.id = hit.item_id WHERE n_found >= 0.75 * n_shingles
"""
