"""Substring deduplication by De Bruijn compaction: every word of a long repeated passage is found and removed.

Edges of the graph are the windows of ``width`` consecutive words; a window that starts anywhere else too is a repeated
edge, and the words under repeated edges go. Single windows are never shuffled:

1. Each document's windows fall into *pieces*: runs of windows whose least ``seed``-word hash is the same. Equal windows
   have equal least hashes, so a window repeats only among pieces of the same least hash. A piece is a stretch of the
   graph's path (its edges follow each other), known by the hash of all its words.
2. Pieces whose least hash stands anywhere else are kept. Equal pieces meet in a pre-aggregated join: how often the
   piece occurs, and its neighbours, if all occurrences have the same piece before or after them (no branch there).
3. Where a least hash has several different pieces, copies end or differ: one occurrence of each such piece is read
   again, and its windows are compared one by one. A bit mask per piece says which windows repeat.
4. Repeated pieces that follow each other without a branch compact to a path, by joins: each names the piece before it,
   and pointer jumping finds the path's first piece and the distance to it. Where the first piece stands, the whole path
   follows, so only its occurrences become spans.
5. The words under one occurrence of each path, at its source coordinates, are digested; every other occurrence is
   verified against that digest on the document's own words, and the covered words go.

Texts are written once, dealt out by row, so that steps 3 to 5 join them without another shuffle of texts.

Defined results: null texts have no words; texts shorter than a window stay whole; repeated rows are copies of each
other, so their windows repeat; a repeated passage loses every occurrence, the first too; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import Words, mixed, ngram_hashes, shared_path, shuffle_partitions, stored, table, tidied

WIDTH, SEED = 35, 8
PIECES = "rid long, at int, n int, least long, piece long, before long, after long, twice boolean"


def _i64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` numbers, by doubling."""
    out, have = x, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        k = width - have
        out = np.minimum(out[: len(out) - k], out[k:])
    return out


def pieces_of(words: np.ndarray, starts: np.ndarray, width: int, seed: int) -> dict[str, np.ndarray] | None:
    """The pieces of a batch of texts: text, first window, windows, least hash, hash of the words, neighbours.

    ``words``: word hashes of all texts; ``starts``: the first word of each text, and the end.
    """
    lengths = np.diff(starts)
    owner = np.repeat(np.arange(len(lengths)), np.maximum(0, lengths - width + 1))
    if not len(owner):
        return None
    first = np.concatenate([np.arange(a, b - width + 1) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True) if b - a >= width])
    least = window_minima(ngram_hashes(words, seed), width - seed + 1)[first]
    new = np.ones(len(first), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    # pieces of 31 windows at most (longer ones only where a passage repeats itself), so that a mask fits an int
    size = np.diff(np.append(begin, len(first)))
    if size.max() > 31:
        begin = np.concatenate([np.arange(b, b + s, 31) for b, s in zip(begin.tolist(), size.tolist(), strict=True)])
        size = np.diff(np.append(begin, len(first)))
    windows = ngram_hashes(words, width)[first]
    # the hash of a piece: of its windows in order, which fix its words
    rank = np.arange(len(first)) - np.repeat(begin, size)
    piece = np.add.reduceat(mixed(windows ^ mixed(rank.astype(np.uint64) + np.uint64(1))), begin)
    text = owner[begin]
    same = text[1:] == text[:-1]
    before, after = np.zeros(len(begin), np.uint64), np.zeros(len(begin), np.uint64)
    before[1:][same], after[:-1][same] = piece[:-1][same], piece[1:][same]
    # windows that a text holds twice repeat whatever the other texts hold
    order = np.lexsort((windows, owner))
    w, o = windows[order], owner[order]
    eq = (w[1:] == w[:-1]) & (o[1:] == o[:-1])
    double = np.zeros(len(first), bool)
    double[order[1:][eq]] = True
    double[order[:-1][eq]] = True
    return {"text": text, "at": first[begin] - starts[text], "n": size, "least": least[begin], "piece": piece, "before": before, "after": after, "twice": np.logical_or.reduceat(double, begin)}


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


class DealtTexts:
    """(rid, text) written as a table bucketed by rid, so that joins by rid leave the texts where they are."""

    def __init__(self, docs: DataFrame) -> None:
        spark = docs.sparkSession
        self.name = f"siteloom_texts_{uuid.uuid4().hex}"
        n = shuffle_partitions(spark)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", F.monotonically_increasing_id())
        rows.repartition(n, "rid").write.bucketBy(n, "rid").format("parquet").option("path", shared_path(spark, "texts")).saveAsTable(self.name)
        self.rows = spark.table(self.name)
        import atexit

        def drop() -> None:
            try:
                spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            except Exception:
                return

        atexit.register(drop)


def pieces(texts: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """The pieces of all texts (rid, text), written: :data:`PIECES`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            words = Words(b.column("text"))
            p = pieces_of(words.hashes(), words.starts, width, seed)
            if p is not None:
                rid = b.column("rid").to_numpy()[p["text"]]
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(p["at"].astype(np.int32)), pa.array(p["n"].astype(np.int32)), _i64(p["least"]), _i64(p["piece"]), _i64(p["before"]), _i64(p["after"]), pa.array(p["twice"])], names=["rid", "at", "n", "least", "piece", "before", "after", "twice"])

    return stored(texts.select("rid", "text").mapInArrow(tidied(run), PIECES), "pieces")


def repeated_pieces(found: DataFrame, texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """rid, at, n, mask, digest: stretches of ``n`` windows that repeat, each from window ``at`` on.

    Either a whole path (``mask`` null) with the digest of its words, or a piece of which bit i of ``mask`` says whether
    window i repeats (``digest`` null).
    """
    # stored, so that a join with it has an exchange on both sides, which adaptive execution can split
    twice = stored(found.groupBy("least").agg((F.count(F.lit(1)) + F.max(F.col("twice").cast("long"))).alias("c")).where("c > 1").select("least"), "twice")
    candidates = stored(found.join(twice.hint("merge"), "least"), "candidates")
    # the distinct pieces, with one occurrence of each and their neighbours
    kinds = stored(
        candidates.groupBy("least", "piece", "n").agg(
            F.count(F.lit(1)).alias("times"), F.max("twice").alias("twice"), F.min(F.struct("rid", "at")).alias("one"),
            F.when(F.min("before") == F.max("before"), F.min("before")).alias("before"), F.when(F.min("after") == F.max("after"), F.min("after")).alias("after"),
        ),
        "kinds",
    )
    several = kinds.groupBy("least").agg(F.count(F.lit(1)).alias("kinds"), F.min("times").alias("times"), F.max("twice").alias("twice")).where("(kinds > 1 and times = 1) or twice").select("least")
    several = stored(several, "several")
    open_ = stored(kinds.join(several.hint("merge"), "least").select("least", "piece", "n", "times", F.col("one.rid").alias("rid"), F.col("one.at").alias("at")), "open")
    by_text = open_.groupBy("rid").agg(F.collect_list(F.struct("at", "n", "least", "piece", "times")).alias("p"))
    again = texts.select("rid", "text").join(by_text.hint("shuffle_hash"), "rid")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            words = Words(b.column("text"))
            all_windows, checks = ngram_hashes(words.hashes(), width), ngram_hashes(words.hashes(1), width, 0xD6E8FEB86659FD93)
            cols: list[list] = [[], [], [], [], [], []]
            for start, found in zip(words.starts[:-1].tolist(), b.column("p").to_pylist(), strict=True):
                for p in found:
                    n = p["n"]
                    at = start + p["at"]
                    cols[0].append(np.full(n, p["least"]))
                    cols[1].append(np.full(n, p["piece"]))
                    cols[2].append(np.arange(n, dtype=np.int32))
                    cols[3].append(all_windows[at : at + n].view(np.int64))
                    cols[4].append(np.full(n, p["times"]))
                    cols[5].append(checks[at : at + n].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["least", "piece", "i", "window", "times", "check"])

    # windows are equal if two independent hashes of their words are
    single = stored(again.mapInArrow(tidied(windows), "least long, piece long, i int, window long, times long, check long"), "windows")
    again_met = stored(single.groupBy("least", "window", "check").agg(F.sum("times").alias("c")).where("c > 1").select("least", "window", "check"), "met")
    masks = single.join(again_met.hint("merge"), ["least", "window", "check"]).groupBy("least", "piece").agg(F.bit_or(F.expr("shiftleft(1, i)")).alias("mask"))
    whole = stored(kinds.where("times > 1").select("piece", "n", "times", "before", "after", "one"), "whole")
    paths = stored(verifiable(compacted(whole), texts, width), "digests")
    partial = stored(kinds.where("times = 1").select("piece", "n", "least").join(masks.hint("merge"), ["least", "piece"]).where("mask <> 0").select("piece", "n", "mask"), "partial")
    known = stored(paths.select("piece", "n", "windows", F.lit(None).cast("int").alias("mask"), "digest").union(partial.select("piece", "n", F.col("n").alias("windows"), "mask", F.lit(None).cast("binary"))), "decided")
    return candidates.select("rid", "at", "n", "piece").join(known.hint("merge"), ["piece", "n"]).select("rid", "at", F.col("windows").alias("n"), "mask", "digest")


def compacted(whole: DataFrame) -> DataFrame:
    """piece, n, one, windows: the first piece of each path without a branch, an occurrence of it, the path's windows.

    ``whole``: the repeated pieces (piece, n, times, the only ``before`` and ``after``, or null at a branch, one). Two
    pieces belong to one path if each is the other's only neighbour on that side. Paths end: the first occurrence of a
    piece in a text has something else before it than a piece of a circle.
    """
    left = whole.select(F.col("piece").alias("up"), F.col("after").alias("piece"), F.col("n").alias("far"))
    linked = whole.select("piece", F.col("before").alias("up")).join(left.hint("merge"), ["piece", "up"])
    nodes = stored(whole.select("piece", "n").join(linked.hint("merge"), "piece", "left").select("piece", "n", F.coalesce("up", "piece").alias("up"), F.coalesce("far", F.lit(0)).cast("long").alias("far")), "paths")
    while True:
        # pointer jumping: the way to the first piece halves each round
        jump = nodes.select(F.col("piece").alias("up"), F.col("up").alias("up_up"), F.col("far").alias("up_far"))
        nodes_ = stored(nodes.join(jump.hint("merge"), "up").select("piece", "n", F.col("up_up").alias("up"), (F.col("far") + F.col("up_far")).alias("far"), (F.col("up") != F.col("up_up")).alias("moved")), "paths")
        nodes = nodes_.drop("moved")
        if not nodes_.where("moved").limit(1).count():
            break
    length = stored(nodes.groupBy(F.col("up").alias("piece")).agg(F.max(F.col("far") + F.col("n")).alias("windows")), "lengths")
    return whole.select("piece", "n", "one").join(length.hint("merge"), "piece")


def digest_of(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def verifiable(paths: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``paths`` (piece, n, one, windows) with the digest of the words of their one occurrence."""
    by_text = paths.groupBy(F.col("one.rid").alias("rid")).agg(F.collect_list(F.struct(F.col("one.at").alias("at"), "n", "piece", "windows")).alias("p"))
    here = texts.select("rid", "text").join(by_text.hint("shuffle_hash"), "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            rows = []
            for text, found in zip(b.column("text").to_pylist(), b.column("p").to_pylist(), strict=True):
                words = text.encode().split()
                rows += [(p["piece"], p["n"], p["windows"], digest_of(words[p["at"] : p["at"] + p["windows"] + width - 1])) for p in found]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["piece", "n", "windows", "digest"])

    return here.mapInArrow(tidied(run), "piece long, n int, windows long, digest binary")


def spans_of(parts: list[dict], words: list[bytes], width: int) -> list[tuple[int, int]]:
    """Word spans [from, to) under the repeated windows of one text; paths whose words aren't those of their source stay."""
    spans: list[list[int]] = []
    for p in sorted(parts, key=lambda p: p["at"]):
        at, n, mask = p["at"], p["n"], p["mask"]
        if mask is None:
            stretches = [(at, n)] if at + n + width - 1 <= len(words) and digest_of(words[at : at + n + width - 1]) == p["digest"] else []
        else:
            stretches = [(at + i, 1) for i in range(n) if mask >> i & 1]
        for first, count in stretches:
            to = first + count - 1 + width
            if spans and first <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], to)
            else:
                spans.append([first, to])
    return [(a, b) for a, b in spans]


def removals(docs: DataFrame, width: int = WIDTH, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans (and kept_text) for each document of ``docs`` (doc_id, text)."""
    texts = DealtTexts(docs).rows
    marks = repeated_pieces(pieces(texts, width, seed), texts, width)
    by_text = marks.groupBy("rid").agg(F.collect_list(F.struct("at", "n", "mask", "digest")).alias("p"))
    joined = texts.join(by_text.hint("shuffle_hash"), "rid", "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,after:int>>" + ", kept_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
        for b in _slices(batches):
            n_words, n_removed, shas, all_spans, kept = [], [], [], [], []
            for text, parts in zip(b.column("text").to_pylist(), b.column("p").to_pylist(), strict=True):
                words = (text or "").encode().split()
                spans = spans_of(parts, words, width) if parts else []
                n_words.append(len(words))
                rest, at = [], 0
                for x, y in spans:
                    rest += words[at:x]
                    at = y
                rest += words[at:]
                n_removed.append(len(words) - len(rest))
                out = b" ".join(rest)
                shas.append(hashlib.sha256(out).hexdigest())
                all_spans.append([{"first": x, "after": y} for x, y in spans])
                if with_text:
                    kept.append(out.decode())
            cols = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas), pa.array(all_spans, kind)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
            if with_text:
                cols.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.select("doc_id", "text", "p").mapInArrow(tidied(run), schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each of the ``documents`` without the words of repeated 35-word windows."""
    return removals(table(spark, sf_dir, "documents")).drop("spans")


OP5_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     g AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM w, unnest(range(1, len(ws) - 33)) AS t(i)),
     r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
     c AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN r USING (h), unnest(range(0, 35)) AS t(k)),
     l AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY doc_id),
     k AS (SELECT w.doc_id, string_agg(ws[p], ' ' ORDER BY p) AS kept FROM w, unnest(range(1, len(ws) + 1)) AS t(p) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = w.doc_id AND c.p = t.p) GROUP BY w.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(l.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)
"""
