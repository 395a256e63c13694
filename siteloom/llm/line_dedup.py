"""Line deduplication by a deletion-neighbourhood join.

A line is its words. Two lines are near if one edit makes them equal: of a word, where the longer one has ``UNITS`` words
or more; else of a character (of the words joined by a space), where both have ``UNITS`` characters or more. So at most an
eighth of a line differs, and lines on both sides of the border meet. A line goes if an earlier line (by doc_id, then place
in the document) is equal or near. Lines without words stay.

1. Every document's lines become hashes. Equal lines meet in a pre-aggregated join that keeps the earliest.
2. Of two lines at distance one, the first or the last half of the units is equal. Only distinct lines that share such a half with
   another one go on (an exact filter: nothing within the bound is lost). Lines one word short of the border take part
   with their words and with their characters.
3. Those emit all variants within the bound as hashed keys: the line itself and the line without each of its units.
   Equal variants meet: the same place left out on both sides means a replaced unit; a whole line equal to another one
   with a unit left out means an inserted unit. Each group gives its earliest line (a partial aggregate, so a
   variant that a third of all lines share is no load), not pairs.
4. Each line with an earlier partner is verified by the edit distance of the words themselves.

Defined results: null and empty texts have one line without words, which stays; repeated rows lose all lines of the
later row (the rows' order of reading breaks ties of doc_id); null doc_ids come first; other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import small, stored, table, tidied, unused

UNITS = 8
LINES = "rid long, doc_id long, line int, words int, hash long, halves array<long>, body binary"


def _hash(b: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b) - (1 << 63)


def readings(body: bytes) -> list[tuple[list[bytes], bytes, bytes]]:
    """The units by which a line may be near another one, what joins them, and a mark of their kind (words, characters)."""
    words, out = body.split(b" "), []
    if len(words) >= UNITS - 1:
        out.append((words, b" ", b"w"))
    if len(words) < UNITS and len(chars := [c.encode() for c in body.decode()]) >= UNITS:
        out.append((chars, b"", b"c"))
    return out


def near(x: bytes, y: bytes) -> bool:
    """Whether two lines are near, by the reading that the longer one has."""
    a, b = x.split(b" "), y.split(b" ")
    if max(len(a), len(b)) >= UNITS:
        return within_one(a, b)
    a, b = list(x.decode()), list(y.decode())
    return min(len(a), len(b)) >= UNITS and within_one(a, b)


def half_keys(parts: list[bytes], between: bytes, kind: bytes) -> list[int]:
    """Hashes of the halves that a line at distance one may share: both ends, for either of two lengths."""
    n, out = len(parts), []
    for k in {(n - 1) // 2, n // 2}:
        out.append(_hash(kind + b"<%d " % k + between.join(parts[:k])))
        out.append(_hash(kind + b">%d " % k + between.join(parts[n - k :])))
    return out


def variants(parts: list[bytes], between: bytes, kind: bytes) -> Iterator[tuple[int, int]]:
    """(key, place left out) of a line within an edit distance of one; -1 is the whole line."""
    yield _hash(kind + between.join(parts)), -1
    for i in range(len(parts)):
        yield _hash(kind + between.join(parts[:i] + parts[i + 1 :])), i


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance of two lists of units is one at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def lines(docs: DataFrame) -> DataFrame:
    """:data:`LINES` of all documents, written; ``halves`` and ``body`` stand once a task for each distinct line that may be near another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("words", pa.int32()), ("hash", pa.int64()), ("halves", pa.list_(pa.int64())), ("body", pa.binary())])
        seen: set[int] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                rows = []
                b = whole.slice(at, 500)
                for rid, doc, text in zip(*(b.column(c).to_pylist() for c in ("rid", "doc_id", "text")), strict=True):
                    for n, line in enumerate((text or "").encode().split(b"\n")):
                        words = line.split()
                        body = b" ".join(words)
                        h = _hash(body)
                        parts = readings(body) if h not in seen else None
                        if parts:
                            seen.add(h)
                            rows.append((rid, doc, n, len(words), h, [k for p in parts for k in half_keys(*p)], body))
                        else:
                            rows.append((rid, doc, n, len(words), h, None, None))
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    narrow = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(narrow.mapInArrow(tidied(run), LINES), "lines")


def near_lines(found: DataFrame, first: DataFrame) -> DataFrame:
    """hash: distinct lines that have an earlier line within the bound (but not an equal one).

    ``first``: hash, e (doc_id, line, rid of the earliest occurrence).
    """
    long_lines = found.where("halves is not null")
    halves = long_lines.select("hash", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low <> high").select("half")
    alive = stored(halves.join(stored(shared, "shared").hint("merge"), "half").select("hash").distinct(), "alive")
    bodies = stored(long_lines.select("hash", "body").join(small(alive), "hash", "left_semi").dropDuplicates(["hash"]).join(first.hint("merge"), "hash"), "bodies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                key, place, row = [], [], []
                for i, body in enumerate(b.column("body").to_pylist()):
                    for reading in readings(body):
                        for k, p in variants(*reading):
                            key.append(k)
                            place.append(p)
                            row.append(i)
                index = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(place, pa.int32()), b.column("hash").take(index), b.column("e").take(index)], names=["key", "place", "hash", "e"])

    e_type = first.schema["e"].dataType.simpleString()
    sent = stored(bodies.select("hash", "e", "body").mapInArrow(tidied(run), f"key long, place int, hash long, e {e_type}"), "variants")
    # the earliest of each group that may be a partner: whole lines for lines with a word left out, and the other way
    # round, and lines with the same word left out
    whole = F.when(F.col("place") < 0, F.struct("e", "hash"))
    cut = F.when(F.col("place") >= 0, F.struct("e", "hash"))
    by_key = sent.groupBy("key").agg(F.min(whole).alias("whole"), F.min(cut).alias("cut"), F.min("hash").alias("low"), F.max("hash").alias("high")).where("low <> high").drop("low", "high")
    by_place = sent.where("place >= 0").groupBy("key", "place").agg(F.min(F.struct("e", "hash")).alias("same"), F.min("hash").alias("low"), F.max("hash").alias("high")).where("low <> high").drop("low", "high")
    # stored, so that the joins have an exchange on both sides, which adaptive execution can split
    met = stored(sent.join(stored(by_key, "by-key").hint("merge"), "key"), "met").join(stored(by_place, "by-place").hint("merge"), ["key", "place"], "left")
    partners = F.array(F.when(F.col("place") >= 0, F.col("whole")), F.when(F.col("place") < 0, F.col("cut")), F.col("same"))
    pairs = met.select("hash", "e", F.explode(partners).alias("p")).where("p is not null and p.hash <> hash and p.e < e").select("hash", F.col("p.hash").alias("other")).distinct()
    left = bodies.select("hash", "body")
    right = bodies.select(F.col("hash").alias("other"), F.col("body").alias("other_body"))
    both = pairs.join(left.hint("merge"), "hash").join(right.hint("merge"), "other").select("hash", "body", "other_body")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [h for h, x, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if near(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64())], names=["hash"])

    return both.mapInArrow(tidied(verify), "hash long").distinct()


def line_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers from 0, sorted) for each document of ``docs`` (doc_id, text)."""
    found = lines(docs)
    first = stored(found.where("words > 0").groupBy("hash").agg(F.min(F.struct("doc_id", "line", "rid")).alias("e")), "first")
    near = stored(near_lines(found, first), "near")
    decided = stored(first.join(near.withColumn("near", F.lit(True)).hint("merge"), "hash", "left"), "decided")
    marked = found.select("rid", "doc_id", "line", "words", "hash").join(decided.hint("merge"), "hash", "left")
    gone = (F.col("words") > 0) & (F.coalesce("near", F.lit(False)) | (F.col("rid") != F.col("e.rid")) | (F.col("line") != F.col("e.line")))
    per = marked.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_lines"), F.sort_array(F.collect_list(F.when(gone, F.col("line")))).alias("dropped"))
    return per.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def without_lines(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """``docs`` (with distinct doc_ids) with the lines of ``drops`` (doc_id, dropped) taken out of their texts."""
    key, gone = unused(docs, "_doc_id"), unused(docs, "_dropped")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(gone, i)), "\n")
    some = drops.where("n_dropped > 0").select(F.col("doc_id").alias(key), F.col("dropped").alias(gone))
    joined = docs.join(some, docs["doc_id"].eqNullSafe(some[key]), "left")
    return joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every one of the ``documents`` with the lines that have an earlier line, equal or one edit apart."""
    return line_duplicates(table(spark, sf_dir, "documents"))
