"""Jaccard self-join on word shingles by T-occurrence search (DivideSkip), exact.

Two sets with Jaccard similarity s or more, of sizes m and n, share T = ceil(s / (1 + s) * (m + n)) shingles or more.
In any order of all shingles, the first shingle that both hold stands at place m - T or before in the one and at n - T
or before in the other, so it stands in the prefix of both (the first ``n - ceil(s n) + 1``). The order here: shingles
that few documents have first (frequent ones last), each part by length (long ones are seldom shared by chance), then
by hash.

1. One pass counts the shingles of prefixes by hash and finds the frequent ones (the set is bounded, and only orders).
2. One pass turns documents into sets: size, a 64-bit id of the set (equal sets are one set from here on), the prefix.
3. Inverted lists of the prefixes. A list keeps its members that can be similar to another one by size and place, and
   names one of them its leader: the one with the largest share of frequent shingles, which is most alike the others.
   What leaves this step is a row for each leader and set that share a list: as many as memberships, never pairs.
4. Each set is compared with its leaders. Links of copies are found here, and all links of lists of two.
5. A leader and the sets of its longer lists are a group, so any two sets of such a list share a group. In a group, the
   sets outside its largest component are searched against all of it, in blocks of bounded size.
6. Comparisons are T-occurrence searches: the sets of a block are turned into inverted lists, and DivideSkip merges the
   short lists with a heap, probes the long ones by binary search and keeps sets that reach their T. Sets that are
   already known to be connected are not probed, so a block gives fewer links than it has components.
7. Components of the links; every document gets the smallest doc_id reachable.

Defined results: null and empty texts, and those of white space, have no shingles and are linked with nothing; a text
with fewer words than a shingle has one shingle, all its words; repeated rows have equal sets and are linked; other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import Words, mixed, ngram_hashes, shuffle_partitions, small, stored, table, tidied
from siteloom.llm.components import connected

SHINGLE, PERCENT = 5, 75
#: A shingle counts as frequent from so many documents on; of more than FREQUENT_MOST such, the most frequent ones.
FREQUENT, FREQUENT_MOST = 6, 4_000_000
#: Sets in the inverted lists of one T-occurrence search, and sets that are searched against them.
CHUNK = 128
#: Members up to which a list is looked through by pairs of sizes and places, without giving rows; longer ones by neighbours in size.
CLOSE = 512


def required(m: int, n: int, percent: int = PERCENT) -> int:
    """The least intersection of sets of m and n elements with 100 * intersection >= percent * union."""
    return -(-percent * (m + n) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, as numbers: 255 less the bytes of the words, then 56 bits of hash.

    So long shingles come first in their order, which few documents share by chance.
    """
    words = Words(column, lower=True)
    hashes, starts = words.hashes(), words.starts.tolist()
    size = np.array([len(w) for w in words.distinct], np.int64)[words.codes] if len(words.codes) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(size)])

    def numbers(grams: np.ndarray, at: int, n: int) -> np.ndarray:
        length = np.minimum(255, total[at + n : at + n + len(grams)] - total[at : at + len(grams)]).astype(np.uint64)
        return (np.uint64(255) - length) << np.uint64(56) | grams >> np.uint64(8)

    grams = ngram_hashes(hashes, width)
    grams = numbers(grams, 0, width) if len(grams) else grams
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:
            yield numbers(ngram_hashes(hashes[a:b], b - a), a, b - a)
        else:
            yield np.zeros(0, np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def frequent_shingles(docs: DataFrame, at_least: int = FREQUENT, most: int = FREQUENT_MOST) -> np.ndarray:
    """Hashes of shingles that many documents have in their prefix by hash, sorted.

    Shingles go to places by hash, packed: what one batch sends to one place is one row. The set only orders shingles;
    which ones just miss it doesn't change the result.
    """
    places = max(shuffle_partitions(docs.sparkSession), 12)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _slices(batches, 500):
            held = []
            for s in shingle_sets(b.column("text")):
                key = xxhash.xxh3_64_intdigest(s.tobytes())
                if len(s) and key not in seen:
                    seen.add(key)
                    held.append(s[: prefix_length(len(s))])
            if len(seen) > 500_000:
                seen.clear()
            if held:
                tokens = np.concatenate(held)
                place = (mixed(tokens) % np.uint64(places)).astype(np.int32)
                order = np.argsort(place, kind="stable")
                cuts = np.searchsorted(place[order], np.arange(places + 1)).tolist()
                tokens = tokens[order]
                some = [d for d in range(places) if cuts[d + 1] > cuts[d]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([tokens[cuts[d] : cuts[d + 1]].tobytes() for d in some], pa.binary())], names=["place", "tokens"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= at_least
            return pa.RecordBatch.from_arrays([pa.array(signed(tokens[keep])), pa.array(n[keep].astype(np.int64))], names=["token", "n"])

        place, held = None, []
        for b in batches:
            for d, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if d != place and held:
                    yield told()
                    held = []
                place = d
                held.append(np.frombuffer(blob, np.uint64))
        if held:
            yield told()

    packed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidied(send), "place int, tokens binary")
    counts = packed.repartition(places, "place").sortWithinPartitions("place").mapInArrow(tidied(count), "token long, n long")
    top = stored(counts, "frequent").orderBy(F.desc("n"), "token").limit(most).select("token")
    return np.sort(top.toArrow().column(0).to_numpy().view(np.uint64))


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each element, by hash, in the next power of two of bits (64 at least)."""
    m = max(64, 1 << (len(s) - 1).bit_length())
    bits = np.zeros(m, bool)
    bits[(s & np.uint64(m - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def bitmap_bound(x: bytes, y: bytes, m: int, n: int) -> int:
    """An upper bound of the intersection of sets of m and n elements: a bit that differs is an element of one of them."""
    if len(x) < len(y):
        x, y = y, x
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    return (m + n - int(np.bitwise_count(a ^ b).sum())) // 2


SETS = "doc_id long, th long, n long, sk long, central int, prefix binary, bits binary"


def document_sets(docs: DataFrame, frequent: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """A row for each document (:data:`SETS`), written. ``prefix`` (64-bit hashes) stands once a task for each set.

    ``th`` is a hash of the text, ``central`` the thousandths of frequent shingles among those that were counted.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, seen = sent.value, set()
        for b in _slices(batches):
            n, sk, central, prefix, bits = [], [], [], [], []
            for s in shingle_sets(b.column("text")):
                n.append(len(s))
                key = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
                sk.append(key)
                if key is None or key in seen:
                    prefix.append(None)
                    bits.append(None)
                    central.append(0)
                    continue
                seen.add(key)
                if len(seen) > 500_000:
                    seen.clear()
                bits.append(bitmap(s))
                if len(hot):
                    at = np.searchsorted(hot, s)
                    at[at == len(hot)] = 0
                    is_hot = hot[at] == s
                    # how central a set is shows in the part that was counted
                    counted = prefix_length(len(s))
                    central.append(int(1000 * np.count_nonzero(is_hot[:counted]) // counted))
                    s = np.concatenate([s[~is_hot], s[is_hot]])
                else:
                    central.append(0)
                prefix.append(s[: prefix_length(len(s), percent)].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(sk, pa.int64()), pa.array(central, pa.int32()), pa.array(prefix, pa.binary()), pa.array(bits, pa.binary())], names=["doc_id", "th", "n", "sk", "central", "prefix", "bits"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    return stored(narrow.mapInArrow(tidied(run), SETS), "sets")


def memberships(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, many): leader and set of each list of prefixes, written; ``many``: 1 if one such list has more than the two.

    Shingles go to places by hash, packed: what one batch sends to one place is one row.
    """
    places = max(shuffle_partitions(sets.sparkSession), 12)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 2000):
            prefix = [np.frombuffer(p, np.uint64) for p in b.column("prefix").to_pylist()]
            if not prefix:
                continue
            times = np.array([len(p) for p in prefix])
            tokens = mixed(np.concatenate(prefix))
            owner = np.repeat(np.arange(len(times)), times)
            # a place in the order that doesn't fit counts as an earlier one, which excludes less
            at = np.minimum(np.arange(len(tokens)) - np.repeat(np.cumsum(times) - times, times), 65535).astype(np.uint16)
            place = ((tokens >> np.uint64(32)) % np.uint64(places)).astype(np.int64)
            order = np.argsort(place * len(times) + owner, kind="stable")
            tokens, owner, at, place = tokens[order].astype(np.uint32), owner[order], at[order], place[order]
            cuts = np.searchsorted(place, np.arange(places + 1)).tolist()
            sk, n, central = b.column("sk").to_numpy(), b.column("n").to_numpy().astype(np.uint32), b.column("central").to_numpy().astype(np.uint16)
            rows: list[tuple] = []
            for d, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if y > x:
                    who, count = np.unique(owner[x:y], return_counts=True)
                    rows.append((d, *(z.tobytes() for z in (tokens[x:y], at[x:y], count.astype(np.uint32), sk[who], n[who], central[who]))))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["place", "tokens", "at", "counts", "sk", "n", "central"])

    packed = sets.where("prefix is not null").select("sk", "n", "central", "prefix").mapInArrow(tidied(send), "place int, tokens binary, at binary, counts binary, sk binary, n binary, central binary")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if row[0] != place and held:
                    yield from _lists(held, percent)
                    held = []
                place = row[0]
                held.append(row[1:])
        if held:
            yield from _lists(held, percent)

    met = packed.repartition(places, "place").sortWithinPartitions("place").mapInArrow(tidied(meet), "a long, b long, many int")
    return stored(met.groupBy("a", "b").agg(F.max("many").alias("many")), "members")


def _lists(held: list[tuple], percent: int) -> Iterator[pa.RecordBatch]:
    """Leaders and members of the lists of one place."""
    tokens, at, counts, sk, n, central = (np.concatenate([np.frombuffer(h[i], kind) for h in held]) for i, kind in enumerate((np.uint32, np.uint16, np.uint32, np.int64, np.uint32, np.uint16)))
    # a set that several tasks met is taken once; sets are numbered from the least central one on, so that the last of a list leads it
    _, first, number = np.unique(sk, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.lexsort((sk[first], central[first]))] = np.arange(len(first))
    by_rank = first[np.argsort(rank)]
    sk, n = sk[by_rank], n[by_rank].astype(np.int64)
    owner = np.repeat(rank[number], counts)
    order = np.lexsort((at, owner, tokens))
    tokens, owner, at = tokens[order], owner[order], at[order].astype(np.int64)
    once = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])
    tokens, owner, at = tokens[once], owner[once], at[once]
    begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    length = np.diff(np.append(begin, len(tokens)))

    def can(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether members i and j of a list can be similar, by their sizes and the shingle's places."""
        m, o = n[owner[i]], n[owner[j]]
        need = -(-percent * (m + o) // (100 + percent))
        return (100 * np.minimum(m, o) >= percent * np.maximum(m, o)) & (at[i] <= m - need) & (at[j] <= o - need)

    two = begin[length == 2]
    two = two[can(two, two + 1)]
    leader, member, many = [owner[two + 1]], [owner[two]], [np.zeros(len(two), np.int32)]
    known: set[int] = set()
    for x, size in zip(begin[length > 2].tolist(), length[length > 2].tolist(), strict=True):
        if size <= CLOSE:
            i, j = np.triu_indices(size, 1)
            ok = can(x + i, x + j)
            keep = np.zeros(size, bool)
            keep[i[ok]] = keep[j[ok]] = True
        else:
            by_size = np.argsort(n[owner[x : x + size]], kind="stable")
            sizes = n[owner[x : x + size]][by_size]
            near = 100 * sizes[:-1] >= percent * sizes[1:]
            keep = np.zeros(size, bool)
            keep[by_size[:-1][near]] = keep[by_size[1:][near]] = True
        who = owner[x : x + size][keep]
        if len(who) < 2 or (key := xxhash.xxh3_64_intdigest(who.tobytes())) in known:
            continue
        known.add(key)
        leader.append(np.full(len(who) - 1, who[-1]))
        member.append(who[:-1])
        many.append(np.full(len(who) - 1, len(who) > 2, np.int32))
    leader, member, many = np.concatenate(leader), np.concatenate(member), np.concatenate(many)
    pairs, which = np.unique(leader * len(sk) + member, return_inverse=True)
    most = np.zeros(len(pairs), np.int32)
    np.maximum.at(most, which, many)
    for c in range(0, len(pairs), 100_000):
        a, b = np.divmod(pairs[c : c + 100_000], len(sk))
        yield pa.RecordBatch.from_arrays([pa.array(sk[a]), pa.array(sk[b]), pa.array(most[c : c + 100_000])], names=["a", "b", "many"])


# --- T-occurrence search --------------------------------------------------------------------------------------------


def divide_skip(lists: list[list[int]], need: list[int], known: Callable[[int], bool] | None = None) -> dict[int, int]:
    """Members that occur in ``need[member]`` or more of the sorted lists, with their number of occurrences.

    ``known`` tells members that are not wanted. The longest lists are set aside, fewer than the least need. A heap merges the short ones; a member that occurs often
    enough there to reach its need with all the long lists is probed in those by binary search.
    """
    if not lists:
        return {}
    least = max(1, min(need))
    lists = sorted(lists, key=len)
    # the share of long lists: all that the bound allows pays while a probe is cheaper than merging the list
    aside = min(least - 1, len(lists))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    heap = [(x[0], i, 0) for i, x in enumerate(short) if x]
    heapq.heapify(heap)
    found: dict[int, int] = {}
    while heap:
        member, count = heap[0][0], 0
        while heap and heap[0][0] == member:
            _, i, at = heap[0]
            count += 1
            if at + 1 < len(short[i]):
                heapq.heapreplace(heap, (short[i][at + 1], i, at + 1))
            else:
                heapq.heappop(heap)
        left = len(long)
        if count + left < need[member] or (known and known(member)):
            continue
        for x in long:
            left -= 1
            at = bisect_left(x, member)
            if at < len(x) and x[at] == member:
                count += 1
            if count + left < need[member]:
                break
        if count >= need[member]:
            found[member] = count
    return found


class Lists:
    """Inverted lists of a bounded chunk of sets."""

    def __init__(self, members: list[np.ndarray]) -> None:
        self.sizes = [len(m) for m in members]
        tokens = np.concatenate(members)
        owner = np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(tokens, kind="stable")  # by token, then member
        self.tokens, self.owner = tokens[order], owner[order].tolist()

    def search(self, leader: np.ndarray, percent: int = PERCENT, known: Callable[[int], bool] | None = None) -> dict[int, int]:
        """Members (by place) similar to the leader, with the size of the intersection; without those ``known``."""
        need = [required(len(leader), n, percent) for n in self.sizes]
        lo, hi = np.searchsorted(self.tokens, leader, "left"), np.searchsorted(self.tokens, leader, "right")
        has = hi > lo
        return divide_skip([self.owner[a:b] for a, b in zip(lo[has].tolist(), hi[has].tolist(), strict=True)], need, known)


def possible(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow the required intersection, written. Nothing that is similar is lost."""
    bits = stored(sets.where("bits is not null").select("sk", "n", "bits").dropDuplicates(["sk"]), "bits")
    left, right = (bits.select(F.col("sk").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, m, n, x, y = (b.column(k).to_pylist() for k in ("a", "b", "n_a", "n_b", "bits_a", "bits_b"))
            ok = [i for i in range(len(a)) if bitmap_bound(x[i], y[i], m[i], n[i]) >= required(m[i], n[i], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([c[i] for i in ok], pa.int64())], names=["a", "b"])

    return stored(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").mapInArrow(tidied(keep), "a long, b long"), "possible")


def texts_of_sets(members: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(sk, text) of the sets ``members`` (sk), written: each from one of its documents."""
    place = sets.where("prefix is not null").groupBy("sk").agg(F.min(F.struct("doc_id", "th")).alias("p"))
    need = stored(members.join(place.hint("merge"), "sk").select("sk", F.col("p.doc_id").alias("doc_id"), F.col("p.th").alias("th")), "need")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    return stored(source.join(small(need), (source["doc_id"].eqNullSafe(need["doc_id"])) & (source["th"] == need["th"])).select("sk", "text"), "texts")


def searched_groups(members: DataFrame, components: DataFrame, sets: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, common): links that connect the components of each group (of ``members`` with ``many``), written.

    The sets outside a group's largest component are queries against all of its sets. Both meet in blocks of bounded
    size, each a T-occurrence search, so a group whose sets are alike in part only gives rows by blocks, not by pairs.
    """
    groups = members.where("many = 1")
    groups = groups.select(F.col("a").alias("family"), F.col("b").alias("sk")).union(groups.select("a", "a").distinct())
    named = stored(groups.join(components.select(F.col("node").alias("sk"), "component").hint("merge"), "sk", "left").select("sk", "family", F.coalesce("component", "sk").alias("component")), "groups")
    sizes = named.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("family").agg(F.max(F.struct("n", "component")).alias("m"), F.sum("n").alias("n")).where("n > m.n")
    main = stored(main.select("family", F.col("m.component").alias("main"), (F.col("n") / CHUNK).cast("long").alias("chunks"), ((F.col("n") - F.col("m.n")) / CHUNK).cast("long").alias("turns")), "main")
    known = stored(named.join(main.hint("merge"), "family"), "known")
    texts = texts_of_sets(known.select("sk").distinct(), sets, docs)
    chunk, turn = F.pmod("sk", F.col("chunks") + 1), F.pmod(F.xxhash64("sk"), F.col("turns") + 1)
    targets = known.select("family", "sk", "component", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), "turns")).alias("turn"), F.lit(0).alias("query"))
    queries = known.where("component <> main").select("family", "sk", "component", F.explode(F.sequence(F.lit(0).cast("long"), "chunks")).alias("chunk"), turn.alias("turn"), F.lit(1).alias("query"))
    dealt = stored(targets.union(queries.select(*targets.columns)), "blocks")
    rows = dealt.join(texts.hint("merge"), "sk").select(*targets.columns, "text")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, comps, members, index, root, out = None, [], [], [], None, {}, []

        def find(c: int) -> int:
            while (up := root.get(c, c)) != c:
                root[c] = c = root.get(up, up)
            return c

        for b in _slices(batches):
            for f, c, t, query, sk, comp, s in zip(*(b.column(k).to_pylist() for k in ("family", "chunk", "turn", "query", "sk", "component")), shingle_sets(b.column("text")), strict=True):
                if (f, c, t) != key:
                    key, ids, comps, members, index, root = (f, c, t), [], [], [], None, {}
                if not query:
                    ids.append(sk)
                    comps.append(comp)
                    members.append(s)
                elif members:
                    index, own = index or Lists(members), find(comp)
                    for i, n in index.search(s, percent, lambda i, own=own, comps=comps: find(comps[i]) == own).items():
                        if find(comps[i]) != find(comp):
                            root[find(comps[i])] = find(comp)
                            out.append((sk, ids[i], n))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b", "common"])
                out = []

    n = shuffle_partitions(docs.sparkSession)
    keys = ["family", "chunk", "turn"]
    return stored(rows.repartition(n, *keys).sortWithinPartitions(*keys, "query").mapInArrow(tidied(block), "a long, b long, common long"), "links")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, common) of the pairs (a stored table) that are similar; texts of the sets concerned are read again."""
    pairs = possible(pairs, sets, percent)
    texts = texts_of_sets(pairs.select(F.col("b").alias("sk")).union(pairs.select(F.col("a").alias("sk"))).distinct(), sets, docs)
    chunks = stored(pairs.groupBy("a").agg((F.count(F.lit(1)) / CHUNK).cast("long").alias("chunks")), "chunks")
    dealt = stored(pairs.join(chunks.hint("merge"), "a").select("a", "b", F.pmod("b", F.col("chunks") + 1).alias("chunk")), "dealt")
    rows = dealt.join(texts.hint("merge"), dealt["b"] == texts["sk"]).select("a", "chunk", "sk", F.lit(1).alias("member"), "text")
    heads = dealt.select("a", "chunk").distinct()
    rows = rows.union(heads.join(texts.hint("merge"), heads["a"] == texts["sk"]).select("a", "chunk", "sk", F.lit(0).alias("member"), "text"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leader, held, out = None, None, {}, []

        def close() -> None:
            if held:
                ids = list(held)
                out.extend((key[0], ids[i], c) for i, c in Lists(list(held.values())).search(leader, percent).items())
                held.clear()

        for b in _slices(batches):
            for a, chunk, sk, member, s in zip(*(b.column(c).to_pylist() for c in ("a", "chunk", "sk", "member")), shingle_sets(b.column("text")), strict=True):
                if (a, chunk) != key:
                    close()
                    key = (a, chunk)
                if not member:
                    leader = s
                else:
                    held[sk] = s
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b", "common"])
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b", "common"])

    n = shuffle_partitions(docs.sparkSession)
    return stored(rows.repartition(n, "a", "chunk").sortWithinPartitions("a", "chunk", "member").mapInArrow(tidied(compare), "a long, b long, common long"), "links")


def similar(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The documents' sets (stored, :data:`SETS`) and (node, component) of the sets that have links."""
    sets = document_sets(docs, frequent_shingles(docs), percent)
    members = memberships(sets, percent)
    star = verified(members.select("a", "b"), sets, docs, percent)
    first = connected(star)
    more = searched_groups(members, first, sets, docs, percent)
    return sets, joined_components(first, more)


def joined_components(components: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` (node, component) after more ``links`` (a, b), which are few and between components mostly."""
    if not links.limit(1).count():
        return components
    ends = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    fresh = stored(ends.join(components.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "ends")
    at_a, at_b = (fresh.select(F.col("node").alias(k), F.col("component").alias(f"component_{k}")) for k in "ab")
    contracted = links.select("a", "b").join(at_a.hint("merge"), "a").join(at_b.hint("merge"), "b").select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))
    moved = connected(stored(contracted, "contracted")).select(F.col("node").alias("component"), F.col("component").alias("to"))
    nodes = components.union(fresh.select("node", "component")).distinct()
    return stored(nodes.join(moved.hint("merge"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "components")


def components_of(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, th (a hash of the text) for each document of ``docs`` (doc_id, text)."""
    sets, comps = similar(docs, percent)
    narrow = sets.select("doc_id", "th", "n", "sk")
    least = narrow.where("sk is not null").groupBy("sk").agg(F.min("doc_id").alias("least"))
    label = least.join(comps.select(F.col("node").alias("sk"), "component").hint("merge"), "sk", "left").select("sk", "least", F.coalesce("component", "sk").alias("component"))
    label = stored(label, "labels")
    low = stored(label.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    by_set = stored(label.join(low.hint("merge"), "component").select("sk", "component_id"), "by-set")
    linked = narrow.join(by_set.hint("merge"), "sk", "left")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "th")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of ``documents`` with the component of its links (75 % of the five-word shingles in common)."""
    return components_of(table(spark, sf_dir, "documents")).drop("th")
