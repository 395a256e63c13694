"""Toxicity classifier: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word is read twice: as a word (its hashed log-odds between toxic and other documents, from one part of the training
sample) and as characters (the log-odds of its 3- to 5-byte pieces, hashed, of which the strongest and the mean count).
These inputs run forward and backward through gated recurrent units over a window of ``WINDOW`` words; attention pools
the states, and a logistic output gives the window's probability. Windows overlap by half and cover every word of a text,
whatever its length; a document's score is its highest window.

Training (on the driver, numpy, by back-propagation through time) uses a bounded sample: ``SAMPLE`` documents a class,
of which longer ones than ``SAMPLE_BYTES`` give a part. The labels are of documents, so each round trains on the window that scores highest in each
(multiple-instance learning), and on a window at random of the others.

Defined results: null and empty texts, and those of white space, score 0; repeated rows get the same score; null doc_ids
have a null ``held_out``; other columns are ignored, whatever their names; if no labels (or only one class) are given all
scores are 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import Words, mixed, table, tidied
from siteloom.llm.labelled import sample

FOLDS, LEFT_OUT, CUT = 5, 0, 0.5
SAMPLE = {1: 1500, 0: 2500}
SAMPLE_BYTES = 15_000
WINDOW, STRIDE, HIDDEN = 32, 16, 6
WORD_BITS, PIECE_BITS = 19, 18
STRIP = b".,;:!?\"'()[]{}|&%$#*-_<>/\\"
N_INPUTS = 7


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


class WordTable:
    """Distinct words of a batch: slots of the word table, and those of their character pieces."""

    def __init__(self, distinct: list[bytes]) -> None:
        bare = [w.strip(STRIP) or w for w in distinct]
        sizes = np.array([len(w) + 2 for w in bare], np.int64)
        data = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in bare), np.uint8).astype(np.uint64)
        ends = np.cumsum(sizes)
        begin = ends - sizes
        index = np.arange(len(data)) - np.repeat(begin, sizes)
        value = mixed(data + np.uint64(1) + (index.astype(np.uint64) << np.uint64(8)))
        self.sizes = sizes
        self.word = _slot(mixed(np.add.reduceat(value, begin)), WORD_BITS) if len(begin) else np.zeros(0, np.int64)
        left = np.repeat(ends, sizes) - np.arange(len(data))
        slots, owner = [], []
        word_of = np.repeat(np.arange(len(bare)), sizes)
        for n in (3, 4, 5):
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + data[at + k]
            slots.append(_slot(mixed(h), PIECE_BITS))
            owner.append(word_of[at])
        slots, owner = np.concatenate(slots), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        self.piece, owner = slots[order], owner[order]
        self.piece_begin = np.searchsorted(owner, np.arange(len(bare)))
        self.piece_count = np.diff(np.append(self.piece_begin, len(owner)))


def log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of document frequencies, and in standard errors; both bounded and scaled."""
    lo = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    z = lo / np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5))
    seen = toxic + other > 0
    return np.where(seen, np.clip(lo, -3, 6) / 3, 0).astype(np.float32), np.where(seen, np.clip(z, -6, 6) / 3, 0).astype(np.float32)


def windows_of(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of each window; the windows of a text cover all its words and overlap by half."""
    first, size, text = [], [], []
    for t, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
        n = b - a
        if n <= 0:
            continue
        at = np.arange(0, max(1, n - STRIDE), STRIDE)
        at = np.minimum(at, max(0, n - WINDOW)) + a
        first.append(at)
        size.append(np.full(len(at), min(n, WINDOW)))
        text.append(np.full(len(at), t))
    if not first:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(first), np.concatenate(size), np.concatenate(text)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class ToxicityModel:
    """Input tables, two recurrent directions (gates: update, reset, candidate), attention and output."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.ready = False
        self.tables: dict[str, np.ndarray] = {}
        h = HIDDEN
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"W{d}"] = r.normal(0, 0.4, (N_INPUTS, 3 * h)).astype(np.float32)
            self.p[f"U{d}"] = r.normal(0, 0.3, (h, 3 * h)).astype(np.float32)
            self.p[f"c{d}"] = np.zeros(3 * h, np.float32)
        self.p["A"] = r.normal(0, 0.4, (2 * h, h)).astype(np.float32)
        self.p["v"] = r.normal(0, 0.4, h).astype(np.float32)
        self.p["o"] = r.normal(0, 0.4, 2 * h).astype(np.float32)
        self.p["o0"] = np.zeros(1, np.float32)

    # --- inputs
    def learn_tables(self, batches: list[tuple[Words, WordTable]], labels: list[np.ndarray]) -> None:
        counts = {k: np.zeros((2, 1 << b), np.float64) for k, b in (("word", WORD_BITS), ("piece", PIECE_BITS))}
        total = [0, 0]
        for (words, wt), y in zip(batches, labels, strict=True):
            for t, (a, b) in enumerate(zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True)):
                k, c = np.unique(words.codes[a:b]), int(y[t])
                total[c] += 1
                counts["word"][c][np.unique(wt.word[k])] += 1
                if len(k):
                    at = np.concatenate([np.arange(s, s + m) for s, m in zip(wt.piece_begin[k].tolist(), wt.piece_count[k].tolist(), strict=True)])
                    counts["piece"][c][np.unique(wt.piece[at])] += 1
        for k, c in counts.items():
            self.tables[f"{k}_lo"], self.tables[f"{k}_z"] = log_odds(c[1], c[0], total[1], total[0])
        strong = np.maximum(self.tables["piece_z"], 0) * np.clip(self.tables["piece_lo"], 0, 1)
        self.tables["piece_strong"] = strong.astype(np.float32)
        del self.tables["piece_z"]

    def inputs(self, wt: WordTable) -> np.ndarray:
        """The inputs of each distinct word."""
        x = np.zeros((len(wt.sizes), N_INPUTS), np.float32)
        if not len(x):
            return x
        lo, z = self.tables["word_lo"][wt.word], self.tables["word_z"][wt.word]
        x[:, 0], x[:, 1], x[:, 2] = lo, z, np.maximum(z, 0) * np.clip(lo, 0, 1)
        strong, plo = self.tables["piece_strong"][wt.piece], self.tables["piece_lo"][wt.piece]
        x[:, 3] = np.maximum.reduceat(strong, wt.piece_begin)
        x[:, 4] = np.add.reduceat(strong, wt.piece_begin) / wt.piece_count
        x[:, 5] = np.add.reduceat(plo, wt.piece_begin) / wt.piece_count
        x[:, 6] = np.minimum(wt.sizes, 20) / 10
        return x

    # --- network
    def _direction(self, d: str, pre: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States [steps, windows, hidden]; ``pre``: the inputs' part of the gates, in the order of reading."""
        h, u = HIDDEN, self.p[f"U{d}"]
        s = np.zeros((pre.shape[1], h), np.float32)
        out, tape = np.empty((*pre.shape[:2], h), np.float32), []
        uzr, uc = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        for t in range(len(pre)):
            g = _sigmoid(pre[t, :, : 2 * h] + s @ uzr)
            z, r = g[:, :h], g[:, h:]
            c = np.tanh(pre[t, :, 2 * h :] + (r * s) @ uc)
            new = s + z * (c - s)
            if not mask[t].all():
                new = np.where(mask[t][:, None], new, s)
            if keep:
                tape.append((s, z, r, c))
            s = new
            out[t] = s
        return out, tape

    def forward(self, pre_f: np.ndarray, pre_b: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Probabilities of windows; arrays are [steps, windows, ...]."""
        sf, tf = self._direction("f", pre_f, mask, keep)
        sb, tb = self._direction("b", pre_b[::-1], mask[::-1], keep)
        s = np.concatenate([sf, sb[::-1]], 2)
        a = np.tanh(s @ self.p["A"])
        e = a @ self.p["v"]
        e = np.where(mask, e, -1e9)
        e = np.exp(e - e.max(0))
        alpha = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", alpha, s)
        prob = _sigmoid(pooled @ self.p["o"] + self.p["o0"][0])
        return prob, (s, a, alpha, pooled, tf, tb, mask)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log-loss of windows with inputs x [steps, windows, inputs]."""
        h = HIDDEN
        prob, (s, a, alpha, pooled, tf, tb, _) = self.forward(x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"], mask, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        d = (prob - y) * weight / weight.sum()
        g["o"], g["o0"][0] = pooled.T @ d, d.sum()
        dp = d[:, None] * self.p["o"]
        ds = alpha[:, :, None] * dp
        dalpha = np.einsum("nh,tnh->tn", dp, s)
        de = alpha * (dalpha - (alpha * dalpha).sum(0))
        g["v"] = np.einsum("tn,tnh->h", de, a)
        da = de[:, :, None] * self.p["v"] * (1 - a * a)
        g["A"] = np.einsum("tni,tnj->ij", s, da)
        ds = ds + da @ self.p["A"].T
        for k, tape, inp, dstate, m in (("f", tf, x, ds[:, :, :h], mask), ("b", tb, x[::-1], ds[::-1, :, h:], mask[::-1])):
            u = self.p[f"U{k}"]
            back = np.zeros((x.shape[1], h), np.float32)
            for t in range(len(tape) - 1, -1, -1):
                prev, z, r, c = tape[t]
                dn = (back + dstate[t]) * m[t][:, None]
                idle = (back + dstate[t]) * ~m[t][:, None]
                dc = dn * z * (1 - c * c)
                dz = dn * (c - prev) * z * (1 - z)
                drs = dc @ u[:, 2 * h :].T
                dr = drs * prev * r * (1 - r)
                gate = np.concatenate([dz, dr, dc], 1)
                g[f"W{k}"] += inp[t].T @ gate
                g[f"c{k}"] += gate.sum(0)
                g[f"U{k}"][:, : 2 * h] += prev.T @ gate[:, : 2 * h]
                g[f"U{k}"][:, 2 * h :] += (r * prev).T @ dc
                back = dn * (1 - z) + drs * r + gate[:, : 2 * h] @ u[:, : 2 * h].T + idle
        return g

    def window_scores(self, words: Words, x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Probabilities of all windows of a batch, by blocks; x: the inputs of distinct words."""
        pre_f, pre_b = x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]
        out = np.empty(len(first), np.float32)
        steps = np.arange(WINDOW)[:, None]
        for at in range(0, len(first), 4096):
            f, n = first[at : at + 4096], size[at : at + 4096]
            mask = steps < n
            codes = words.codes[np.where(mask, f + steps, f)]
            out[at : at + 4096] = self.forward(pre_f[codes], pre_b[codes], mask)[0]
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        """The highest window of each text; 0 for texts without words."""
        out = np.zeros(len(column))
        if not self.ready:
            return out
        words = Words(column, lower=True)
        first, size, text = windows_of(words.starts)
        if len(first):
            p = self.window_scores(words, self.inputs(WordTable(words.distinct)), first, size)
            np.maximum.at(out, text, p.astype(np.float64))
        return out


def trained(texts: list[str], labels: list[int], rounds: int = 10, seed: int = 7) -> ToxicityModel:
    """A model for these documents. Tables are learnt from three fifths of them, the network from the others."""
    model = ToxicityModel(seed)
    if not labels or min(labels) == max(labels):
        return model
    r = np.random.default_rng(seed)
    order = r.permutation(len(texts))
    texts, y = [texts[i] for i in order], np.array(labels)[order]

    def batches(part: np.ndarray) -> list[tuple]:
        out = []
        for at in range(0, len(part), 500):
            k = part[at : at + 500]
            words = Words(pa.array([texts[i] for i in k], pa.string()), lower=True)
            out.append((words, WordTable(words.distinct), y[k]))
        return out

    cut = int(0.6 * len(texts)) if len(texts) >= 20 else len(texts)
    for_tables, for_net = np.arange(cut), np.arange(cut, len(texts)) if cut < len(texts) else np.arange(len(texts))
    found = batches(for_tables)
    model.learn_tables([(w, t) for w, t, _ in found], [k for _, _, k in found])
    data = []
    for words, wt, k in batches(for_net):
        first, size, text = windows_of(words.starts)
        if len(first):
            data.append((words, model.inputs(wt), first, size, text, k))
    adam = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step, steps = 0, np.arange(WINDOW)[:, None]
    for turn in range(rounds):
        xs, ms, ys = [], [], []
        for words, x, first, size, text, k in data:
            if turn:
                p = model.window_scores(words, x, first, size)
            else:  # a first guess: the window with the strongest piece
                codes = words.codes[np.minimum(first + steps, len(words.codes) - 1)]
                p = np.where(steps < size, x[codes, 3] + x[codes, 2], 0).max(0)
            best = np.lexsort((-p, text))
            best = best[np.concatenate([[True], text[best][1:] != text[best][:-1]])]
            others = np.flatnonzero(k[text] == 0)
            if len(others):
                best = np.concatenate([best, r.choice(others, min(len(others), len(best)), replace=False)])
            mask = steps < size[best]
            xs.append(x[words.codes[np.where(mask, first[best] + steps, first[best])]])
            ms.append(mask)
            ys.append(k[text[best]])
        x, m, t = np.concatenate(xs, 1), np.concatenate(ms, 1), np.concatenate(ys).astype(np.float32)
        weight = np.where(t > 0, 0.5 / max(1, t.sum()), 0.5 / max(1, (1 - t).sum())).astype(np.float32)
        for _ in range(3):
            shuffled = r.permutation(len(t))
            for at in range(0, len(t), 256):
                b = shuffled[at : at + 256]
                g = model.gradients(x[:, b], t[b], weight[b], m[:, b])
                step += 1
                for k, v in model.p.items():
                    a1, a2 = adam[k]
                    a1 *= 0.9
                    a1 += 0.1 * g[k]
                    a2 *= 0.99
                    a2 += 0.01 * g[k] ** 2
                    v -= 0.02 * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.99**step)) + 1e-7)
    model.ready = True
    # move the output's threshold to where documents of the training sample are told apart best
    scores, truth = [], []
    for words, x, first, size, text, k in data:
        p, best = model.window_scores(words, x, first, size).astype(float), np.zeros(len(k))
        np.maximum.at(best, text, p)
        scores.append(best)
        truth.append(k)
    s, t = np.concatenate(scores), np.concatenate(truth)
    order = np.argsort(s)
    ss, ts = s[order], t[order]
    right = np.concatenate([[0], np.cumsum(1 - ts)]) / max(1, (1 - ts).sum()) + 1 - np.concatenate([[0], np.cumsum(ts)]) / max(1, ts.sum())
    k = int(np.argmax(right))
    lo, hi = (ss[k - 1] if k else 0.0), (ss[k] if k < len(ss) else 1.0)
    mid = np.clip((lo + hi) / 2, 1e-4, 1 - 1e-4)
    model.p["o0"] = (model.p["o0"] - np.log(mid / (1 - mid))).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, left_out: int = LEFT_OUT, most: dict[int, int] | None = None) -> ToxicityModel:
    return trained(*sample(docs, labels, "toxic", folds, left_out, most or SAMPLE, SAMPLE_BYTES))


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score of each document of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 300):
                b = whole.slice(at, 300)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sent.value.score(b.column("text")))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every one of the ``documents`` with its toxicity, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    return out.select("doc_id", (fold == LEFT_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
