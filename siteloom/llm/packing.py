"""Best-fit packing of documents into token sequences by linear grouping.

1. Every document becomes pieces of at most ``capacity`` tokens. The pieces table is written once.
2. The lengths' histogram (at most ``capacity`` rows, whatever the input) goes to the driver and is planned there:
   - large lengths, sorted down, fall into groups of equal cardinality; each group counts as its largest length;
   - configurations (how many pieces of each group fill a sequence) are optimised by column generation: a revised
     simplex over the groups, whose columns an unbounded knapsack prices;
   - the whole part of the optimum becomes sequences; actual lengths then take the place of the rounded ones, and the
     pieces beyond the whole part go best-fit decreasing, as do the small ones, into the room that is left.
   All of this works on runs (a length pattern and how many sequences have it), so it is bounded by the histogram.
3. The plan says for ranks a..b of a length which sequences and offsets they take. Pieces are ranked within their
   length by the task that made them plus the counts of the tasks before, so no length is gathered in one task.

Defined results: null and empty texts are the single separator token; repeated rows are packed as often as they come;
other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.llm.common import stored, table, tidied, tokenizer_path

CAPACITY = 2048
SEPARATOR = 0
#: Cached words of a task (about 0.2 kB each); beyond, the cache starts anew.
CACHE_WORDS = 100_000
#: Bytes of text from which on a slice of texts is turned into ids.
SLICE = 2_000_000
#: Unicode letters that stand for the 256 bytes in the vocabulary: printable ones for themselves, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b if b in _PRINTABLE else 256 + b - sum(p < b for p in _PRINTABLE)) for b in range(256)}


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + length]``, one after the other."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


class WordTokenizer:
    """Ids of the public word-end BPE, for Arrow batches of texts.

    The vocabulary's pre-tokenizer never joins what white space parts, so a text's ids are those of its chunks, and a
    chunk's those of its words. Each distinct chunk of a batch is split once, each new word is encoded once, by the
    library's model; ids are gathered by number.
    """

    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n"
    ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\s0-9a-z]+|\n")

    def __init__(self, path: str | None = None) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or tokenizer_path())
        self.model = self.tokenizer.model
        self.pieces = regex.compile(self.PIECES)
        self.forget()

    def forget(self) -> None:
        """Without this at a task's end, the workers that Spark uses again would keep the words beside the next operator's data."""
        self.words: dict[str, int] = {"\n": 0}
        self.ids, self.length = array("I"), array("I", [0])

    def _learn(self, words: list[str]) -> None:
        tokenize = self.model.tokenize
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            got = [tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LETTERS)) for w in part]
            self.words.update(zip(part, range(len(self.length), len(self.length) + len(part)), strict=True))
            self.ids.extend([t.id for ts in got for t in ts])
            self.length.extend(map(len, got))

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, lengths) of distinct chunks."""
        odd = pc.or_(pc.match_substring_regex(chunks, r"[\x00-\x1f\x7f]"), pc.match_substring(chunks, "<|"))
        ascii_ = pc.and_not(pc.string_is_ascii(chunks), odd).to_numpy(zero_copy_only=False)
        odd = odd.to_numpy(zero_copy_only=False)
        rest = dict(zip(np.flatnonzero(~ascii_).tolist(), chunks.filter(pa.array(~ascii_)).to_pylist(), strict=True))
        # only the whole library can tell the ids of the odd ones
        other = [i for i, c in rest.items() if not odd[i] and c.isprintable() and "Σ" not in c and "İ" not in c]
        if len(self.words) > CACHE_WORDS:
            self.forget()
        # a line for each chunk; every line's end counts as a word without ids
        split, where = [], np.flatnonzero(ascii_)
        if len(where):
            lines = pa.ListArray.from_arrays(pa.array([0, len(where)], pa.int32()), chunks.filter(pa.array(ascii_)).cast(pa.string()))
            split = self.ASCII_PIECES.findall(pc.binary_join(lines, "\n")[0].as_py().lower() + "\n")
        if other:
            split += self.pieces.findall(unicodedata.normalize("NFC", "\n".join([rest[i] for i in other])).lower() + "\n")
            where = np.concatenate([where, np.array(other, np.int64)])
        known = self.words
        self._learn(list({w for w in split if w not in known}))
        number = np.fromiter(map(known.__getitem__, split), np.int64, len(split))
        lengths = np.frombuffer(self.length, np.uint32).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        ids = gathered(np.frombuffer(self.ids, np.uint32), starts[number], lengths[number]) if len(self.ids) else np.zeros(0, np.uint32)
        stop = np.cumsum(lengths[number])[number == 0]
        first, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        size[where] = np.diff(stop, prepend=0)
        first[where] = stop - size[where]
        more = {i: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids, np.uint32) for i, c in rest.items() if not size[i] and c}
        at = len(ids)
        for i, x in more.items():
            first[i], size[i] = at, len(x)
            at += len(x)
        return np.concatenate([ids, *more.values()]), first, size

    def columns(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each :data:`SLICE` of texts (null: empty): all ids, and where each text's end (one entry more than texts)."""
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        cuts = np.unique(np.concatenate([[0], np.searchsorted(size, np.arange(SLICE, size[-1] if len(size) else 0, SLICE)) + 1, [len(column)]])).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            lists = pc.ascii_split_whitespace(column.slice(a, b - a).cast(pa.large_string()))
            stops = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            encoded = lists.flatten().dictionary_encode()
            codes = encoded.indices.to_numpy(zero_copy_only=False)
            ids, first, size_ = self._chunks(encoded.dictionary)
            counts = size_[codes]
            yield gathered(ids, first[codes], counts), np.concatenate([[0], np.cumsum(counts)])[stops]

    def encode(self, texts: pa.Array | list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit bytes."""
        for ids, stops in self.columns(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())):
            ids = ids.astype("<u4", copy=False)
            yield from (ids[x:y].tobytes() for x, y in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True))


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """The pieces of all documents, written: :data:`PIECES`. ``nth`` counts the task's pieces of the same length."""
    where = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task, seen = tokenizer(where), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([SEPARATOR], "<u4").tobytes()
        for b in batches:
            out: list[tuple] = []
            for doc, raw in zip(b.column("doc_id").to_pylist(), tok.encode(b.column("text")), strict=True):
                raw = memoryview(raw + end)
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    n = len(part) // 4
                    out.append((doc, piece, at // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            if out:
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])
        tok.forget()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), PIECES), "pieces")


# --- the plan, on the driver, over the histogram of lengths -------------------------------------------------------


def grouped(lengths: list[int], counts: list[int], groups: int) -> list[tuple[int, int]]:
    """Linear grouping: (rounded length, cardinality) of at most ``groups`` groups of lengths that go down."""
    total, out = sum(counts), []
    if not total:
        return out
    size, todo = -(-total // groups), 0
    for length, count in zip(lengths, counts, strict=True):
        while count:
            if not todo:
                out.append([length, 0])
                todo = size
            take = min(count, todo)
            out[-1][1] += take
            count, todo = count - take, todo - take
    merged: dict[int, int] = {}
    for length, count in out:
        merged[length] = merged.get(length, 0) + count
    return list(merged.items())


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Column generation for the fractional optimum: (pieces of each size, how many sequences)."""
    k = len(sizes)
    need, size = np.array(demand, float), np.array(sizes)
    columns = np.diag(capacity // size).astype(float)  # the basis, one column each
    inverse = np.diag(1 / np.diag(columns))
    amount = inverse @ need
    for turn in range(rounds):
        if turn % 50 == 49:
            inverse = np.linalg.inv(columns)
            amount = inverse @ need
        prices = inverse.sum(0)
        best, new = _knapsack(size, prices, capacity)
        if best <= 1 + 1e-7:
            break
        step = inverse @ new
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, amount / step, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        theta = ratio[out]
        amount = amount - theta * step
        amount[out] = theta
        columns[:, out] = new
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    return [(columns[:, j].astype(int), max(0.0, amount[j])) for j in range(k)]


def _knapsack(size: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best value, and how many of each."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(size.min())
    for c in range(least, capacity + 1):
        fits = np.flatnonzero(size <= c)
        gain = best[c - size[fits]] + value[fits]
        j = int(np.argmax(gain))
        if gain[j] > best[c - 1]:
            best[c], choice[c] = gain[j], fits[j]
        else:
            best[c], choice[c] = best[c - 1], -1
    out, c = np.zeros(len(size)), capacity
    while c >= least:
        if choice[c] < 0:
            c -= 1
        else:
            out[choice[c]] += 1
            c -= size[choice[c]]
    return float(best[capacity]), out


class Plan:
    """Runs of equally filled sequences, and for each length which ranks go where.

    ``takes[length]``: (first rank, ranks, first sequence, pieces a sequence, offset of the first).
    """

    def __init__(self, capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.room: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)
        self.rooms: list[int] = []  # sorted
        self.takes: dict[int, list[tuple[int, int, int, int, int]]] = {}
        self.used: dict[int, int] = {}  # ranks of a length given so far

    def give_room(self, room: int, first: int, count: int) -> None:
        if not count or not room:
            return
        if room not in self.room:
            bisect.insort(self.rooms, room)
            self.room[room] = []
        self.room[room].append((first, count))

    def put(self, length: int, first: int, each: int, sequences: int, offset: int) -> None:
        """``each`` pieces of a length in each of ``sequences`` sequences from ``first``."""
        rank = self.used.get(length, 0)
        self.takes.setdefault(length, []).append((rank, each * sequences, first, each, offset))
        self.used[length] = rank + each * sequences

    def best_fit(self, length: int, count: int) -> None:
        """Pieces of one length, each to the fullest sequence that has room for it."""
        while count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = min(self.capacity // length, count)
                runs = count // each
                self.put(length, self.sequences, each, runs, 0)
                self.give_room(self.capacity - each * length, self.sequences, runs)
                self.sequences += runs
                count -= runs * each
                continue
            room = self.rooms[at]
            first, have = self.room[room].pop()
            if not self.room[room]:
                del self.room[room], self.rooms[at]
            each = min(room // length, count)
            runs = min(have, count // each)
            self.put(length, first, each, runs, self.capacity - room)
            self.give_room(room - each * length, first, runs)
            self.give_room(room, first + runs, have - runs)
            count -= runs * each


def planned(histogram: dict[int, int], capacity: int = CAPACITY, settings: tuple = ((24, 1 / 2), (24, 1 / 4), (48, 1 / 4))) -> Plan:
    """The plan with the fewest sequences for pieces of these lengths, over a few (groups, small share) settings."""
    return min((planned_with(histogram, capacity, groups, small) for groups, small in settings), key=lambda p: p.sequences)


def planned_with(histogram: dict[int, int], capacity: int, groups: int, small: float) -> Plan:
    """One plan; pieces up to ``small`` times the capacity are small, the larger ones fall into ``groups`` groups."""
    plan = Plan(capacity)
    left = {n: c for n, c in histogram.items() if c}
    if full := left.pop(capacity, 0):
        plan.put(capacity, 0, 1, full, 0)
        plan.sequences = full
    large = sorted((n for n in left if n > small * capacity), reverse=True)
    groups_of = grouped(large, [left[n] for n in large], groups)
    if groups_of:
        sizes, demand = [g[0] for g in groups_of], [g[1] for g in groups_of]
        # the actual lengths of each group, largest first, as runs
        actual: list[list[list[int]]] = []
        queue = [[n, left[n]] for n in large]
        for d in demand:
            actual.append([])
            while d:
                take = min(d, queue[0][1])
                actual[-1].append([queue[0][0], take])
                queue[0][1] -= take
                d -= take
                if not queue[0][1]:
                    queue.pop(0)
        for config, amount in configurations(sizes, demand, capacity):
            slots = [j for j, m in enumerate(config) for _ in range(m)]
            todo = int(amount + 1e-6)
            while todo and slots:
                # the longest run in which each slot keeps one actual length
                need: dict[int, int] = {}
                for j in slots:
                    need[j] = need.get(j, 0) + 1
                if any(sum(c for _, c in actual[j]) < m for j, m in need.items()):
                    break
                run = todo
                for j, m in need.items():
                    run = min(run, max(1, actual[j][0][1] // m))
                pattern: list[int] = []
                if run == 1:
                    for j, m in need.items():
                        for _ in range(m):
                            pattern.append(actual[j][0][0])
                            actual[j][0][1] -= 1
                            if not actual[j][0][1]:
                                actual[j].pop(0)
                else:
                    for j, m in need.items():
                        pattern += [actual[j][0][0]] * m
                        actual[j][0][1] -= m * run
                        if not actual[j][0][1]:
                            actual[j].pop(0)
                offset = 0
                for n in sorted(set(pattern), reverse=True):
                    each = pattern.count(n)
                    plan.put(n, plan.sequences, each, run, offset)
                    offset += each * n
                plan.give_room(capacity - offset, plan.sequences, run)
                plan.sequences += run
                todo -= run
        for n in large:
            left[n] -= plan.used.get(n, 0)
    for n in sorted(left, reverse=True):
        plan.best_fit(n, left[n])
    return plan


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    parts = pieces(docs, capacity, path)
    by_task = stored(parts.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # at most `capacity` rows come to the driver
    plan = planned({r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select("length", "task", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = parts.join(before.hint("merge"), ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth"))
    takes = sorted((n << 40 | t[0], t[2], t[3], t[4]) for n, ts in plan.takes.items() for t in ts)
    keys, first, each, offset = (np.array(x, np.int64) for x in (zip(*takes, strict=True) if takes else ([0],) * 4))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            nth = (length << 40 | rank) - keys[at]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(first[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(tidied(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    return packed(table(spark, sf_dir, "documents"))
