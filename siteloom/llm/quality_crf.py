"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. Its features (shares of character classes, repeated words and lines, lengths) and those of its
neighbours feed the field, and neighbouring labels are tied by a transition matrix. Forward-backward gives each line's
marginal of being good; their mean, weighted by the lines' lengths, is the document's raw quality, and a logistic curve
fitted on the training documents makes a score of it whose cut is 0.7. The field is fitted on the driver, on a bounded
sample of labelled documents (``SAMPLE`` documents a class, of which longer ones than ``SAMPLE_BYTES`` give a part).
Labels are of documents, those of lines are latent: the field is fitted to the documents' labels first, then, in rounds
of expectation and maximisation, to each line's marginal under the field and its document's label (which counts as an
observation of the line that is right ``TRUST`` of the time). So a bad document may have good lines, and the transitions
learn where labels change. Executors score whole texts, whatever their length.

Defined results: null and empty texts get the score 0 (there is nothing to keep); repeated rows get the same score;
null doc_ids have a null ``held_out``; other columns pass or are ignored, whatever their names; if no labels (or only one
class) are given, all texts that are not empty score 1; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import mixed, table, tidied, unused
from siteloom.llm.labelled import held_out, sample

FOLDS, LEFT_OUT, CUT = 4, 2, 0.7
SAMPLE, SAMPLE_BYTES = 1500, 20_000
#: How often a document's label is right for one of its lines, and rounds of expectation and maximisation.
TRUST, LATENT_ROUNDS = 0.6, 3
#: Byte classes that are counted in a line.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\x0b\x0c", "stop": b".,;:?'\"()-",
    "bang": b"!", "pipe": b"|", "symbol": b"#$%&*<>=@^_`{}[]~+/\\", "high": bytes(range(128, 256)),
}
N_FEATURES = len(CLASSES) + 9


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, the line's bytes, the first line of each text and the end) of a batch of texts."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data == 10)  # each line's newline
    starts = np.concatenate([[0], ends[:-1] + 1])
    text_end = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], np.searchsorted(ends, text_end - 1) + 1])
    size = (ends - starts).astype(np.float64)
    at_least = np.maximum(size, 1)
    cols = []
    for chars in CLASSES.values():
        lut = np.zeros(256, bool)
        lut[np.frombuffer(chars, np.uint8)] = True
        cols.append(np.add.reduceat(lut[data], starts, dtype=np.int32) / at_least)
    # words, by a hash of their bytes
    blank = (data <= 32) | False
    begin = ~blank
    begin[1:] &= blank[:-1]
    w = np.flatnonzero(begin)
    line_of = np.searchsorted(ends, w)
    n_lines = len(ends)
    words = np.bincount(line_of, minlength=n_lines).astype(np.float64)
    if len(w):
        index = np.arange(len(data)) - np.repeat(w, np.diff(np.append(w, len(data)))) if w[0] == 0 else np.arange(len(data)) - np.concatenate([np.zeros(w[0], np.int64), np.repeat(w, np.diff(np.append(w, len(data))))])
        value = mixed(data.astype(np.uint64) + np.uint64(1) + (index.astype(np.uint64) << np.uint64(8)))
        value[blank] = 0
        h = mixed(np.add.reduceat(value, w))
        same_line = line_of[1:] == line_of[:-1]
        again = np.bincount(line_of[1:][(h[1:] == h[:-1]) & same_line], minlength=n_lines)
        order = np.lexsort((h, line_of))
        hs, ls = h[order], line_of[order]
        distinct = np.bincount(ls, weights=np.concatenate([[True], (hs[1:] != hs[:-1]) | (ls[1:] != ls[:-1])]), minlength=n_lines)
        line_hash = np.zeros(n_lines, np.uint64)
        np.add.at(line_hash, line_of, mixed(h + (np.arange(len(w)) - np.searchsorted(line_of, line_of)).astype(np.uint64)))
    else:
        again = distinct = np.zeros(n_lines)
        line_hash = np.zeros(n_lines, np.uint64)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    order = np.lexsort((np.arange(n_lines), line_hash, text_of))
    copy = np.zeros(n_lines, bool)
    copy[order[1:]] = (line_hash[order][1:] == line_hash[order][:-1]) & (text_of[order][1:] == text_of[order][:-1]) & (words[order][1:] > 2)
    some = np.maximum(words, 1)
    cols += [again / some, distinct / some, np.minimum(1, 20 * (cols[5] > 0)), copy, np.log1p(np.minimum(size, 2000)) / 8, np.minimum(size / some, 30) / 10, np.log1p(np.minimum(words, 300)) / 6, size == 0, np.ones(n_lines)]
    return np.stack(cols, 1), size, first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and of the line after (zeros at a text's ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after], 1)


class LineField:
    """The conditional random field: emission weights for ``good`` (``bad`` is 0) and a transition matrix."""

    def __init__(self, features: int) -> None:
        self.w = np.zeros(3 * features)
        self.t = np.array([[0.5, 0.0], [0.0, 0.5]])
        self.a, self.b = 1.0, 0.0  # the logistic curve over the raw quality

    def marginals(self, x: np.ndarray, first: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """P(good) of each line; with ``pairs`` the expected transitions, summed.

        Texts are padded in groups of like numbers of lines and run together; states are normalised at each step.
        """
        score = np.clip(x @ self.w, -30, 30)
        emit = np.stack([np.ones(len(score)), np.exp(score - np.maximum(score, 0))], 1)
        emit[:, 0] = np.exp(-np.maximum(score, 0))
        move = np.exp(self.t)
        lengths = np.diff(first)
        out, expected = np.zeros(len(score)), np.zeros((2, 2))
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            group = order[at : at + 256]
            group = group[lengths[group] <= max(8, 2 * lengths[group[0]])]
            at += len(group)
            n, steps = len(group), int(lengths[group].max())
            if not steps:
                continue
            where = first[group][:, None] + np.arange(steps)
            real = np.arange(steps) < lengths[group][:, None]
            e = emit[np.where(real, where, 0)]
            e[~real] = 1
            alpha, beta = np.empty((steps, n, 2)), np.ones((steps, n, 2))
            alpha[0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
            for s in range(1, steps):
                a = (alpha[s - 1] @ move) * e[:, s]
                alpha[s] = a / a.sum(1, keepdims=True)
            for s in range(steps - 2, -1, -1):
                b = (e[:, s + 1] * beta[s + 1]) @ move.T
                b /= b.sum(1, keepdims=True)
                beta[s] = np.where(real[:, s + 1, None], b, 1)
            p = alpha * beta
            p /= p.sum(2, keepdims=True)
            out[where[real]] = p[:, :, 1].T[real]
            if pairs and steps > 1:
                joint = alpha[:-1, :, :, None] * move * (e.transpose(1, 0, 2)[1:] * beta[1:])[:, :, None, :]
                joint /= joint.sum((2, 3), keepdims=True)
                expected += joint[real.T[1:]].sum(0)
        return out, expected if pairs else None

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, ridge: float = 1e-3, chain: bool = True) -> None:
        """Gradient ascent (Adam) on the expected likelihood of the lines' labels; ``y``: each line's probability of being good.

        Without ``chain`` the transitions are zero: each line stands alone with its neighbours' features.
        """
        if not chain:
            self.t = np.zeros((2, 2))
        n = len(x)
        both = np.stack([1 - y, y], 1).astype(float)
        inner = np.ones(n, bool)
        inner[first[:-1]] = False
        k = np.flatnonzero(inner)
        seen = both[k - 1].T @ both[k]
        m, v = np.zeros(len(self.w) + 4), np.zeros(len(self.w) + 4)
        for i in range(1, rounds + 1):
            p, expected = self.marginals(x, first, pairs=True)
            g = np.concatenate([x.T @ (y - p), (seen - expected).ravel()]) / n
            g -= ridge * np.concatenate([self.w, self.t.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
            self.w += step[:-4]
            if chain:
                self.t += step[-4:].reshape(2, 2)

    def raw(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The length-weighted mean of the lines' marginals; 0 for texts without a character."""
        p, _ = self.marginals(with_neighbours(x, first), first)
        weight = np.add.reduceat(size, first[:-1])
        return np.add.reduceat(p * size, first[:-1]) / np.maximum(weight, 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, size, first = line_features(texts)
        q = self.raw(x, size, first)
        out = 1 / (1 + np.exp(-np.clip(self.a * q + self.b, -40, 40)))
        return np.where(np.add.reduceat(size, first[:-1]) > 0, out, 0.0)


def fitted(texts: list[str], labels: list[int]) -> LineField:
    """A field for these documents; its curve's cut lies where most of both classes are told apart."""
    field = LineField(N_FEATURES)
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        field.a, field.b = 0.0, 40.0
        return field
    raw = [t.encode() for t in texts]
    x, size, first = line_features(raw)
    near, of_document = with_neighbours(x, first), np.repeat(y, np.diff(first))
    # a first guess line by line: with transitions, whole documents would keep the one label they start with
    field.fit(near, first, of_document, chain=False)
    odds = np.log(TRUST / (1 - TRUST)) * (2 * of_document - 1)
    for _ in range(LATENT_ROUNDS):
        p = np.clip(field.marginals(near, first)[0], 1e-9, 1 - 1e-9)
        field.fit(near, first, 1 / (1 + np.exp(-(np.log(p / (1 - p)) + odds))), rounds=40)
    q = field.raw(x, size, first)
    # the cut with the highest balanced accuracy, in the middle of its gap
    order = np.argsort(q)
    qs, ys = q[order], y[order]
    good_kept = 1 - np.concatenate([[0], np.cumsum(ys)]) / ys.sum()
    bad_out = np.concatenate([[0], np.cumsum(1 - ys)]) / (1 - ys).sum()
    k = int(np.argmax(good_kept + bad_out))
    lo, hi = (qs[k - 1] if k else 0.0), (qs[k] if k < len(qs) else 1.0)
    cut = (lo + hi) / 2
    field.a = 12.0
    field.b = float(np.log(CUT / (1 - CUT)) - field.a * cut)
    return field


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, left_out: int = LEFT_OUT, most: int = SAMPLE) -> LineField:
    return fitted(*sample(docs, labels, "quality", folds, left_out, {0: most, 1: most}, SAMPLE_BYTES))


def scored(docs: DataFrame, field: LineField, name: str = "score") -> DataFrame:
    """``docs`` with a column of scores."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 300):
                b = whole.slice(at, 300)
                texts = [(t or "").encode() for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.score(texts))], names=[*b.schema.names, name])

    return docs.mapInArrow(tidied(run), schema)


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the classifier rejects; all columns pass."""
    score = unused(docs, "_llm_score")
    return scored(docs, fit(docs, labels), score).where(F.col(score) >= CUT).drop(score)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every one of the ``documents`` with its quality, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    field = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), field)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    return out.select("doc_id", (fold == LEFT_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
