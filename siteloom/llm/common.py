"""Helpers that every operator of this subpackage shares.

Tables that several later steps read (row ids, digests, candidate lists) are *written* to a folder that all
executors share and read back. That cuts lineage, survives a lost executor, and makes values such as
``monotonically_increasing_id()`` stable, because later steps read the stored value.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The 26 ASCII capitals and their small letters: the contracts lower-case these only.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The same for UTF-8 bytes.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows up to which a side of ids or keys (tens of bytes each) is broadcast; it is counted first.
BROADCAST_ROWS = 300_000
BATCH_ROWS = 2000

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, by any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder for written tables: ``spark.checkpoint.dir``, else one below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the process ends."""
    path = f"{scratch(spark)}/siteloom-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a task gives freed memory back. Spark uses workers again, and freed memory that they keep would
    count beside what the next operator's tasks take."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            return

    return tidy


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most :data:`BATCH_ROWS` rows meanwhile: long texts in batches of ten thousand rows take hundreds of MB on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; removed when the process ends.

    ``partitions`` coalesces (no shuffle) before writing.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    with small_batches(spark):
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone: the folder is the cluster's to clean
            return


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` has it (letter case aside)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (it is counted), else without one.

    Without it the join shuffles both sides, which adaptive execution splits where a key is hot.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def by_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function from one Arrow batch to a dict of arrays (or None) named as in ``schema``."""
    struct = T._parse_datatype_string(schema)
    names, kinds = struct.fieldNames(), [arrow_type(f.dataType) for f in struct.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield pa.RecordBatch.from_arrays([as_arrow(out[n], k) for n, k in zip(names, kinds, strict=True)], names=names)

    return df.mapInArrow(tidied(run), struct)


def as_arrow(x: object, kind: pa.DataType) -> pa.Array:
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    if isinstance(x, pa.Array):
        return x if x.type == kind else x.cast(kind)
    return pa.array(x, type=kind)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings; null counts as the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts as numbers.

    ``codes[i]`` is the word's number within this batch, ``distinct`` the words (bytes), ``starts`` the first word of
    each text (one entry more than texts). Null texts have no words.
    """

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        import pyarrow.compute as pc

        raw = column.cast(pa.large_binary())
        if lower:
            raw = _lowered(raw)
        lists = pc.ascii_split_whitespace(raw.cast(pa.large_string()))
        flat, offsets = lists.flatten(), np.zeros(len(lists) + 1, np.int64)
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        np.cumsum(lengths, out=offsets[1:])
        encoded = flat.dictionary_encode()
        if isinstance(encoded, pa.ChunkedArray):
            encoded = encoded.combine_chunks()
        codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
        self.distinct: list[bytes] = encoded.dictionary.cast(pa.large_binary()).to_pylist()
        try:
            empty = self.distinct.index(b"")
        except ValueError:
            self.codes, self.starts = codes, offsets
            return
        keep = codes != empty
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(keep, out=before[1:])
        self.codes, self.starts = codes[keep], before[offsets]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        import xxhash

        h = xxhash.xxh3_64_intdigest
        table = np.fromiter((h(w, seed) for w in self.distinct), np.uint64, len(self.distinct))
        return table[self.codes] if len(self.distinct) else np.zeros(0, np.uint64)


def _lowered(raw: pa.Array) -> pa.Array:
    """ASCII letters of a large_binary array lower-cased in one pass over its buffer."""
    if not len(raw):
        return raw
    valid, offsets, data = raw.buffers()
    if data is None:
        return raw
    table = np.frombuffer(ASCII_LOWER, np.uint8)
    new = table[np.frombuffer(data, np.uint8)]
    return pa.Array.from_buffers(raw.type, len(raw), [valid, offsets, pa.py_buffer(new)], null_count=-1, offset=raw.offset)


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of ``n`` words; entry i is the run that starts at word i (runs may cross texts)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    # doubling: H(2k)[i] = H(k)[i] * B^k + H(k)[i+k]
    out, have, power = None, 0, 1
    block, size, mult = words, 1, base
    left = n
    while left:
        if left & 1:
            if out is None:
                out, have = block[:], size
            else:
                k = len(words) - have - size + 1
                out = out[:k] * np.uint64(pow(base, size, 1 << 64)) + block[have : have + k]
                have += size
        left >>= 1
        if left:
            k = len(block) - size
            block = block[:k] * np.uint64(mult) + block[size : size + k]
            mult = mult * mult & 0xFFFFFFFFFFFFFFFF
            size *= 2
    del power
    return mixed(out[:m])


def clean_name(text: str) -> str:
    return re.sub(r"\W+", "_", text)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies; ``SITELOOM_TOKENIZERS`` names another folder."""
    if folder := os.environ.get("SITELOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
