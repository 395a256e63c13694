"""How far sources of a language differ from each other, and the terms that set one apart.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` matches with A-Z lower-cased; a language keeps the V terms that are in
at least ``least`` of its documents. A group (lang, source) and the language itself give each kept term the share
p = 1 + floor(10**9 (count + 1) / (N + V)), N being all its occurrences of kept terms, and two shares p and q differ by
floor((p - q)**2 / q). Part ``pair`` sums that over all kept terms for each ordered pair of sources, part ``term`` holds
a group's ``top`` terms against its language.

Terms of a language are dealt into blocks. A block is a dense int64 tile of groups by terms; numpy takes all pairs of
its rows at once by broadcasting and sums over the block's terms, and keeps the block's largest terms of each group. The
partial pair matrices are then summed, the heaps merged. A tile has ``256 * groups**2`` cells on average, between
:data:`LEAST_TILE` and :data:`TILE`: the number of blocks follows V, one language is many tasks, and what is added up by
pairs is much less than what a tile computes. A language of many groups is also cut into slices of its first group.

Arithmetic is exact: quotients are taken in steps that stay below 2**63 for counts up to 9 * 10**15.

Defined results: null text, lang and source are empty text; a group without terms has N = 0; a language without kept
terms has the value 0 for each pair and no terms; a source alone in its language has no pairs. Repeated rows count each
time. Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteloom.llm.common import small, stored, table, tidied

#: Bytes that end a term become a space, A-Z small letters; every byte of a character above 7F is kept, so this reads
#: code points as the pattern does.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
UNIT = 1_000_000_000
#: int64 cells of a tile, at most and at least, and of what broadcasting takes at once.
TILE, LEAST_TILE, BROADCAST_CELLS = 1 << 22, 1 << 16, 1 << 20
#: Distinct (group, term) that a task gathers before it gives them out.
GATHERED = 400_000
COUNTS = "lang string, source string, term string, n long, docs long"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term) with occurrences and documents, summed within a task; a null term marks the group itself."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            size = len(n) + 1
            names = [pa.array([x], pa.string()).take(pa.array(np.zeros(size, np.int64))) for x in (lang, source)]
            term = pa.array([None, *n], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*names, term, pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            if (lang, source) not in seen:
                seen[lang, source] = Counter(), Counter()
            n, docs = seen[lang, source]
            held -= len(n)
            words = terms_of(text)
            n.update(words)
            docs.update(set(words))
            held += len(n)
            if held > GATHERED:
                yield from given()
                seen.clear()
                held = 0
    yield from given()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents); a row with a null term for each group."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(tidied(_counter), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, all_of: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 (count + 1) / all_of), exactly; three digits of the quotient at a time."""
    out, left = np.zeros(np.broadcast(count, all_of).shape, np.int64), count + 1
    for _ in range(3):
        digits, left = np.divmod(left * 1000, all_of)
        out = out * 1000 + digits
    return 1 + out


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / q) of two broadcast arrays of shares."""
    d = p - q
    return d * d // q


def pair_sums(p: np.ndarray, first: int, last: int) -> np.ndarray:
    """For groups first..last-1 against all: the differences summed over the tile's terms."""
    groups, terms = p.shape
    out = np.zeros((last - first, groups), np.int64)
    rows = max(1, min(last - first, BROADCAST_CELLS // max(groups, 1)))
    wide = max(1, BROADCAST_CELLS // (rows * max(groups, 1)))
    for g in range(first, last, rows):
        own = p[g : min(g + rows, last)]
        for t in range(0, terms, wide):
            out[g - first : g - first + len(own)] += differences(own[:, None, t : t + wide], p[None, :, t : t + wide]).sum(2)
    return out


TILES = "lang string, g int, h int, term string, value long"


def _tiles(top: int):  # noqa: ANN202
    def run(key: tuple, sparse: pa.Table, groups: pa.Table) -> pa.Table:
        """A block of terms (term, at, n) against a language's groups (number, total, V, N of the language, slice)."""
        groups = groups.sort_by("number")
        total, kept, all_n = (groups.column(c).to_numpy() for c in ("total", "kept", "lang_total"))
        terms = sparse.column("term").to_pylist()
        size = len(total)
        count = np.zeros((size, len(terms)), np.int64)
        if terms:
            lists = pa.concat_arrays(sparse.column("at").chunks)
            inner = lists.flatten()
            lengths = np.diff(lists.offsets.to_numpy())
            count[inner.field("number").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(terms)), lengths)] = inner.field("n").to_numpy(zero_copy_only=False)
        # a language that keeps no term has no tile, but its pairs are there with the value 0
        p = shares(count, (total + kept)[:, None]) if terms else np.ones((size, 0), np.int64)
        slices = groups.column("slice").to_numpy()
        own = np.flatnonzero(slices == key[2].as_py())
        first, last = int(own[0]), int(own[-1]) + 1
        sums = pair_sums(p, first, last)
        g, h = np.divmod(np.arange(sums.size), size)
        different = g + first != h
        parts = [((g + first)[different], h[different], None, sums.ravel()[different])]
        if terms:
            q = shares(count.sum(0), all_n[:1] + kept[:1])
            for i in range(first, last):
                above = np.flatnonzero((count[i] > 0) & (p[i] > q))
                values = differences(p[i, above], q[above])
                best = heapq.nsmallest(top, zip((-values).tolist(), (terms[k].encode() for k in above), strict=True))
                if best:
                    parts.append((np.full(len(best), i), None, [t.decode() for _, t in best], np.array([-v for v, _ in best], np.int64)))
        tables = []
        for a, b, names, values in parts:
            n = len(a)
            tables.append(pa.table([
                pa.array([key[0].as_py()], pa.string()).take(pa.array(np.zeros(n, np.int64))), pa.array(a, pa.int32()), pa.nulls(n, pa.int32()) if b is None else pa.array(b, pa.int32()),
                pa.nulls(n, pa.string()) if names is None else pa.array(names, pa.string()), pa.array(values, pa.int64()),
            ], names=["lang", "g", "h", "term", "value"]))
        return pa.concat_tables(tables)

    return run


def divergence(docs: DataFrame, least: int = 3, top: int = 200, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank of each group of ``docs`` (lang, source, text)."""
    counted = stored(counts(docs), "counts")
    groups = counted.where("term is null").select("lang", "source")
    groups = stored(groups.withColumn("number", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")), "groups")
    numbered = counted.where("term is not null").join(small(groups), ["lang", "source"])
    kept = numbered.groupBy("lang", "term").agg(F.collect_list(F.struct("number", "n")).alias("at"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = stored(kept.select("lang", "term", "at"), "terms")

    totals = kept.select("lang", F.explode("at").alias("a")).groupBy("lang", F.col("a.number").alias("number")).agg(F.sum("a.n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.aggregate("at", F.lit(0).cast("long"), lambda s, x: s + x["n"])).alias("lang_total"))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    langs = sizes.join(langs, "lang", "left").na.fill(0, ["kept", "lang_total"])
    # blocks of terms so that a tile has about so many cells; slices of the first group so that a pair matrix has no more
    cells = F.least(F.greatest(256 * F.col("size") * F.col("size"), F.lit(LEAST_TILE)), F.lit(tile))
    langs = langs.withColumn("blocks", F.ceil(F.greatest(F.col("kept"), F.lit(1)) * F.col("size") / cells).cast("int")).withColumn("slices", F.ceil(F.col("size") * F.col("size") / F.lit(tile)).cast("int"))
    langs = stored(langs, "langs")
    sides = groups.join(totals, ["lang", "number"], "left").na.fill(0, ["total"]).join(small(langs), "lang")
    sides = sides.withColumn("slice", F.floor(F.col("number") * F.col("slices") / F.col("size")).cast("int"))
    sides = sides.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("of", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    sides = sides.select("lang", "block", "of", "number", "total", "kept", "lang_total", "slice")
    tiles = kept.join(small(langs), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).withColumn("of", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    tiles = tiles.select("lang", "block", "of", "term", "at")
    by = ["lang", "block", "of"]
    made = stored(tiles.groupBy(*by).cogroup(sides.groupBy(*by)).applyInArrow(_tiles(top), TILES), "tiles")

    pairs = made.where("h is not null").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    named = groups.select("lang", F.col("number").alias("g"), "source")
    others = groups.select("lang", F.col("number").alias("h"), F.col("source").alias("item"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    columns = ["lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank")]
    pairs = pairs.join(small(named), ["lang", "g"]).join(small(others), ["lang", "h"]).withColumn("part", F.lit("pair")).select(*columns)
    best = made.where("h is null").join(small(named), ["lang", "g"]).withColumnRenamed("term", "item").withColumn("part", F.lit("term")).select(*columns).where(F.col("rank") <= top)
    return pairs.unionByName(best)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources of each language of ``documents``, and the 200 terms that set each source apart."""
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
     o AS (SELECT rid, lang, source, unnest(terms) AS term FROM d),
     k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
     l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
     g AS (SELECT DISTINCT lang, source FROM d),
     c AS (SELECT o.lang, source, o.term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
     s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
     p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(s.total, 0) + l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v) AS q
           FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
     f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
     a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
           UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
     r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM a)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
