"""Hidden Markov models along a contig: Viterbi and forward-backward, runs of homozygosity, copy-number states.

A long contig is cut into pieces of ``piece`` sites, which bounds a task's memory, and the pieces are chained exactly: each
gives the best (or total) weight of its paths from every state before it to every state at its end, a small matrix; the
matrices of a (sample, contig), one row a piece, are multiplied forward and backward; and each piece is decoded between
the states (or messages) that this gives at its ends. So the result doesn't depend on where a contig is cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import genotype as g
from siteloom.operators.carried import RANGE, carried, ranged
from siteloom.sources.shared import stored

PIECE = 200_000


def viterbi(emission: np.ndarray, transition: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The most probable states. ``emission``: sites x states; ``transition``: states x states, or one for each site."""
    n, k = emission.shape
    if not n:
        return np.zeros(0, int)
    t = np.broadcast_to(transition, (n, k, k)) if transition.ndim == 2 else transition
    v = (np.full(k, 1 / k) if start is None else start) * emission[0]
    back = np.zeros((n, k), int)
    for i in range(1, n):
        step = v[:, None] * t[i]
        back[i] = step.argmax(0)
        v = step.max(0) * emission[i]
        total = v.sum()
        v = v / total if total > 0 else np.full(k, 1 / k)
    path = np.empty(n, int)
    path[-1] = int(v.argmax())
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def forward_backward(emission: np.ndarray, transition: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Posterior probabilities of the states, sites x states."""
    n, k = emission.shape
    if not n:
        return np.zeros((0, k))
    t = np.broadcast_to(transition, (n, k, k)) if transition.ndim == 2 else transition
    a, b = np.empty((n, k)), np.ones((n, k))
    a[0] = (np.full(k, 1 / k) if start is None else start) * emission[0]
    a[0] /= a[0].sum() or 1
    for i in range(1, n):
        a[i] = (a[i - 1] @ t[i]) * emission[i]
        a[i] /= a[i].sum() or 1
    for i in range(n - 2, -1, -1):
        b[i] = t[i + 1] @ (emission[i + 1] * b[i + 1])
        b[i] /= b[i].sum() or 1
    p = a * b
    return p / p.sum(1, keepdims=True)


def distance_transitions(positions: np.ndarray, to_other: float, back: float, before: float = np.nan) -> np.ndarray:
    """Two-state transitions for each site, from rates a base: 1 - exp(-rate * distance); ``before``: the position before."""
    d = np.diff(positions, prepend=positions[:1] if np.isnan(before) else before).clip(0)
    a, b = -np.expm1(-to_other * d), -np.expm1(-back * d)
    t = np.empty((len(positions), 2, 2))
    t[:, 0, 0], t[:, 0, 1], t[:, 1, 0], t[:, 1, 1] = 1 - a, a, b, 1 - b
    return t


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def _sum_of_logs(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis, keepdims=True), -1e300)
    return (_log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def _segments(emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions and transitions of a piece as (places, segments, ...): about as many places as segments, which are solved side by side.

    The last segment is filled up with sites that change nothing.
    """
    n, k = emission.shape
    length = max(1, math.isqrt(n))
    segments = -(-n // length)
    fill = segments * length - n
    e = np.concatenate([emission, np.ones((fill, k))]).reshape(segments, length, k)
    t = np.concatenate([np.broadcast_to(transition, (n, k, k)), np.broadcast_to(np.eye(k), (fill, k, k))]).reshape(segments, length, k, k)
    return np.ascontiguousarray(e.swapaxes(0, 1)), np.ascontiguousarray(t.swapaxes(0, 1))


def _best_products(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """segments x states x states: the best log weight of a segment's paths; ``e`` and ``t`` are logs of :func:`_segments`."""
    best = t[0] + e[0][:, None, :]
    for i in range(1, len(e)):
        best = (best[:, :, :, None] + t[i][:, None, :, :]).max(2) + e[i][:, None, :]
    return best


def _total_products(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """segments x states x states: the total log weight of a segment's paths; each row has a scale of its own."""
    total, scale = np.ones((1, 1)), 0.0
    for i in range(len(e)):
        total = (total @ t[i] if i else t[0]) * e[i][:, None, :]
        s = total.sum(2)
        s = np.where(s > 0, s, 1)
        total, scale = total / s[:, :, None], scale + np.log(s)
    return _log(total) + scale[:, :, None]


def transfer(emission: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best, total) log weights of a piece's paths, from each state at the site before it to each state at its end."""
    e, t = _segments(emission, transition)
    bests, totals = _best_products(_log(e), _log(t)), _total_products(e, t)
    best, total = bests[0], totals[0]
    for m, n in zip(bests[1:], totals[1:], strict=True):
        best, total = (best[:, :, None] + m).max(1), _sum_of_logs(total[:, :, None] + n, 1)
    return best, total


def chained(pieces: list[tuple[np.ndarray, np.ndarray]], states: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each piece: the best path's state before it (-1: none) and at its end; log messages into it from either side."""
    best, into, after = np.full(states, -np.log(states)), [], []
    ahead = np.full(states, -np.log(states))
    for m, total in pieces:
        into.append((best, ahead))
        best, ahead = (best[:, None] + m).max(0), _sum_of_logs(ahead[:, None] + total, 0)
        best, ahead = best - best.max(), ahead - ahead.max()
    back, end = np.zeros(states), int(best.argmax())
    for k in range(len(pieces) - 1, -1, -1):
        m, total = pieces[k]
        before = int((into[k][0] + m[:, end]).argmax())
        after.append((before if k else -1, end, into[k][1], back))
        back = _sum_of_logs(total + back[None, :], 1)
        back, end = back - back.max(), before
    return after[::-1]


def between(emission: np.ndarray, transition: np.ndarray, before: int, end: int) -> np.ndarray:
    """The best path of a piece from a state before it (-1: any, as likely) to a state at its end."""
    e, t = (_log(x) for x in _segments(emission, transition))
    length, segments, k = e.shape
    products, into = _best_products(e, t), np.full((segments + 1, k), -np.inf)
    into[0, before if before >= 0 else slice(None)] = 0
    for b in range(segments):
        into[b + 1] = (into[b][:, None] + products[b]).max(0)
        into[b + 1] -= into[b + 1].max() if np.isfinite(into[b + 1].max()) else 0
    ends = np.empty(segments, int)
    ends[-1] = end
    for b in range(segments - 1, 0, -1):
        ends[b - 1] = int((into[b] + products[b][:, ends[b]]).argmax())
    # each segment between its states, all at once
    v = np.concatenate([(into[0][:, None] + t[0][0]).max(0)[None], t[0][np.arange(1, segments), ends[:-1]]]) + e[0]
    back = np.zeros((length, segments, k), int)
    for i in range(1, length):
        step = v[:, :, None] + t[i]
        back[i] = step.argmax(1)
        v = step.max(1) + e[i]
    path = np.empty((length, segments), int)
    path[-1] = ends
    for i in range(length - 1, 0, -1):
        path[i - 1] = back[i][np.arange(segments), path[i]]
    return path.T.ravel()[: len(emission)]


def posteriors(emission: np.ndarray, transition: np.ndarray, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Posterior probabilities of a piece's states, given the log messages at its ends."""
    e, t = _segments(emission, transition)
    length, segments, k = e.shape
    products = _total_products(e, t)
    into, after = np.empty((segments, k)), np.empty((segments, k))
    into[0], after[-1] = ahead - ahead.max(), back - back.max()
    for b in range(segments - 1):
        into[b + 1] = _sum_of_logs(into[b][:, None] + products[b], 0)
        into[b + 1] -= into[b + 1].max() if np.isfinite(into[b + 1].max()) else 0
    for b in range(segments - 1, 0, -1):
        after[b - 1] = _sum_of_logs(products[b] + after[b][None, :], 1)
        after[b - 1] -= after[b - 1].max() if np.isfinite(after[b - 1].max()) else 0

    def scaled(x: np.ndarray) -> np.ndarray:
        s = x.sum(1, keepdims=True)
        return x / np.where(s > 0, s, 1)

    a, b = np.empty((length, segments, k)), np.empty((length, segments, k))
    now = np.exp(into)
    for i in range(length):
        now = a[i] = scaled((now[:, None, :] @ t[i])[:, 0] * e[i])
    now = b[-1] = np.exp(after)
    for i in range(length - 2, -1, -1):
        now = b[i] = scaled((t[i + 1] @ (e[i + 1] * now)[:, :, None])[:, :, 0])
    p = (a * b).swapaxes(0, 1).reshape(-1, k)[: len(emission)]
    return p / p.sum(1, keepdims=True)


Model = Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]
_KEYS = ["sample", "chrom", "_piece"]


def _pieces(calls: DataFrame, piece: int) -> DataFrame:
    """Calls (sample, chrom, pos, ...) numbered along their contig (``_at``), in pieces, with the position before (``_prev``)."""
    order = ["pos", *[c for c in calls.columns if c not in ("sample", "chrom", "pos")]]
    t = carried(ranged(calls, ["sample", "chrom"], order), ["sample", "chrom"], order, sums={"_at": F.lit(1)}, before={"_prev": F.col("pos")}).drop(RANGE)
    return t.withColumn("_piece", F.floor((F.col("_at") - 1) / piece))


def _messages(t: DataFrame, model: Model, states: int) -> DataFrame:
    """What each piece has to know of the others: a row for each of sample, chrom and piece."""

    def weigh(p: pd.DataFrame) -> pd.DataFrame:
        best, total = transfer(*model(p.sort_values("_at")))
        return pd.DataFrame({"sample": [p["sample"].iloc[0]], "chrom": [p["chrom"].iloc[0]], "_piece": [p["_piece"].iloc[0]], "best": [best.ravel()], "total": [total.ravel()]})

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_piece")
        out = chained([(np.asarray(b).reshape(states, states), np.asarray(c).reshape(states, states)) for b, c in zip(p["best"], p["total"], strict=True)], states)
        return pd.DataFrame({"sample": p["sample"].to_numpy(), "chrom": p["chrom"].to_numpy(), "_piece": p["_piece"].to_numpy(), "_before": [o[0] for o in out], "_end": [o[1] for o in out], "_ahead": [o[2] for o in out], "_back": [o[3] for o in out]})

    matrices = t.groupBy(*_KEYS).applyInPandas(weigh, "sample int, chrom string, _piece long, best array<double>, total array<double>")
    return matrices.groupBy("sample", "chrom").applyInPandas(chain, "sample int, chrom string, _piece long, _before int, _end int, _ahead array<double>, _back array<double>")


def _decoded(calls: DataFrame, model: Model, states: int, piece: int, finish: Callable[[pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Calls with their states. ``model``: emissions and transitions of sites."""
    t = stored(_pieces(calls, piece), "pieces")

    def decode(key: tuple, p: pd.DataFrame, ends_: pd.DataFrame) -> pd.DataFrame:
        p, end = p.sort_values("_at"), ends_.iloc[0]
        e, tr = model(p)
        return finish(p, between(e, tr, int(end["_before"]), int(end["_end"])), posteriors(e, tr, np.asarray(end["_ahead"]), np.asarray(end["_back"])))

    return t.groupBy(*_KEYS).cogroup(_messages(t, model, states).groupBy(*_KEYS)).applyInPandas(decode, schema)


def expected_transitions(emission: np.ndarray, transition: np.ndarray, ahead: np.ndarray, back: np.ndarray, first: bool) -> np.ndarray:
    """states x states: how often a piece's sites are expected to be reached from each state, given the messages at its ends.

    ``first``: the piece begins its contig, so its first site isn't reached from anywhere.
    """
    n, k = emission.shape
    a, b = np.empty((n, k)), np.empty((n, k))
    before = np.exp(ahead - ahead.max())
    a[0] = emission[0] * (before if first else before @ transition)
    a[0] /= a[0].sum() or 1
    for i in range(1, n):
        a[i] = (a[i - 1] @ transition) * emission[i]
        a[i] /= a[i].sum() or 1
    b[-1] = np.exp(back - back.max())
    for i in range(n - 2, -1, -1):
        b[i] = transition @ (emission[i + 1] * b[i + 1])
        b[i] /= b[i].sum() or 1
    came = a[:-1] if first else np.concatenate([before[None], a[:-1]])
    went = (emission * b)[1 if first else 0 :]
    pair = came[:, :, None] * transition * went[:, None, :]
    return (pair / np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)).sum(0)


def trained(calls: DataFrame, emissions: Callable[[pd.DataFrame], np.ndarray], start: np.ndarray, rounds: int = 20, tolerance: float = 1e-4, piece: int = PIECE) -> np.ndarray:
    """Baum-Welch over all samples and contigs of ``calls`` (sample, chrom, pos, ...): the transitions that expected ones settle at.

    ``emissions``: sites x states of some rows, which don't change. A round is a job: the pieces' messages are chained, each
    piece counts its expected transitions between them, and the sums (states x states) come to the driver. The result doesn't
    depend on where contigs are cut. States that are never left keep their row.
    """
    t, transition = stored(_pieces(calls, piece), "pieces"), np.array(start, float)
    states = len(transition)

    def of(now: np.ndarray) -> tuple[Model, Callable]:
        def model(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            e = emissions(p)
            each = np.array(np.broadcast_to(now, (len(p), states, states)))
            if int(p["_at"].iloc[0]) == 1:
                each[0] = np.eye(states)
            return e, each

        def count(key: tuple, p: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
            p, end = p.sort_values("_at"), ends.iloc[0]
            c = expected_transitions(emissions(p), now, np.asarray(end["_ahead"]), np.asarray(end["_back"]), int(p["_at"].iloc[0]) == 1)
            return pd.DataFrame({"i": np.repeat(np.arange(states), states), "j": np.tile(np.arange(states), states), "n": c.ravel()})

        return model, count

    for _ in range(rounds):
        now = transition
        model, count = of(now)
        counted = t.groupBy(*_KEYS).cogroup(_messages(t, model, states).groupBy(*_KEYS)).applyInPandas(count, "i int, j int, n double")
        sums = np.zeros((states, states))
        for r in counted.groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # states x states rows
            sums[r["i"], r["j"]] = r["n"]
        total = sums.sum(1, keepdims=True)
        transition = np.where(total > 0, sums / np.maximum(total, 1e-300), transition)
        if np.abs(transition - now).max() < tolerance:
            break
    return transition


def runs_of_homozygosity(df: DataFrame, to_az: float = 6.7e-8, to_hw: float = 5e-9, error: float = 0.01, piece: int = PIECE) -> DataFrame:
    """sample, chrom, pos, state (1: autozygous), p_az for each called site of each sample.

    Emissions from the genotype's probabilities and the ALT frequency f: autozygous p0(1-f) + p2 f, otherwise
    p0(1-f)^2 + 2 p1 f(1-f) + p2 f^2. Sites without a call, or of one allele only, are left out.
    """
    of = lambda af: F.transform("samples", lambda s, i: F.struct(i.alias("sample"), af.alias("af"), F.least(g.dosage(s["GT"]), F.lit(2)).alias("d")))
    # arrays of one element give names to what is used again; in a generator nothing of it is moved or repeated
    counts = F.transform(F.array(g.called_alleles(F.col("samples"))), lambda c: F.struct(F.size(F.filter(c, lambda a: a > 0)).alias("ac"), F.size(c).alias("an")))
    varying = F.filter(counts, lambda x: (x["ac"] > 0) & (x["ac"] < x["an"]))
    called = F.filter(F.flatten(F.transform(varying, lambda x: of(x["ac"].cast("double") / x["an"]))), lambda x: x["d"].isNotNull())
    calls = df.select("chrom", "pos", F.explode(called).alias("s")).select("s.sample", "chrom", "pos", "s.af", "s.d")

    def model(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        d, f = p["d"].to_numpy(), p["af"].to_numpy()
        like = np.full((len(p), 3), error / 2)
        like[np.arange(len(p)), d] = 1 - error
        az = like[:, 0] * (1 - f) + like[:, 2] * f
        hw = like[:, 0] * (1 - f) ** 2 + 2 * like[:, 1] * f * (1 - f) + like[:, 2] * f**2
        return np.stack([hw, az], 1), distance_transitions(p["pos"].to_numpy().astype(float), to_az, to_hw, p["_prev"].to_numpy(dtype=float, na_value=np.nan)[0])

    def finish(p: pd.DataFrame, path: np.ndarray, posterior: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"sample": p["sample"].to_numpy(), "chrom": p["chrom"].to_numpy(), "pos": p["pos"].to_numpy(), "state": path, "p_az": posterior[:, 1]})

    return _decoded(calls, model, 2, piece, finish, "sample int, chrom string, pos long, state int, p_az double")


def regions(decoded: DataFrame, state: int = 1) -> DataFrame:
    """Runs of one state: sample, chrom, beg, end, n."""
    keys = ["sample", "chrom"]
    t = carried(ranged(decoded.select(*keys, "pos", "state"), keys, ["pos"]), keys, ["pos"], before={"_last": F.col("state")})
    t = carried(t, keys, ["pos"], sums={"_run": F.coalesce((F.col("_last") != F.col("state")).cast("int"), F.lit(1))})
    return t.where(F.col("state") == state).groupBy("sample", "chrom", "_run").agg(F.min("pos").alias("beg"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n")).drop("_run")


#: Centres of the log R ratio and of the B allele frequency for 0 to 3 copies.
LRR = (None, -0.45, 0.0, 0.3)
BAF = ((0.5,), (0.0, 1.0), (0.0, 0.5, 1.0), (0.0, 1 / 3, 2 / 3, 1.0))


def copy_number(df: DataFrame, baf: str = "BAF", lrr: str = "LRR", w_baf: float = 1.0, w_lrr: float = 0.2, sd_baf: float = 0.04, sd_lrr: float = 0.2, stay: float = 1 - 1e-4, error: float = 1e-4, piece: int = PIECE) -> DataFrame:
    """sample, chrom, pos, copies (0 to 3) from FORMAT values of B allele frequency and log R ratio.

    The emission of a state: error + (1-wB + wB B) (1-wL + wL L) with Gaussian peaks; a missing BAF is 0.5 for no copies
    and the rest in equal parts.
    """
    t = df.select("chrom", "pos", F.posexplode("samples").alias("sample", "s"))
    calls = t.select("sample", "chrom", "pos", F.col("s")[baf].cast("double").alias("b"), F.col("s")[lrr].cast("double").alias("l"))
    change = (1 - stay) / 3
    tr = np.full((4, 4), change)
    np.fill_diagonal(tr, stay)

    def model(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        b, r = p["b"].to_numpy(float), p["l"].to_numpy(float)
        e = np.empty((len(p), 4))
        for k in range(4):
            pb = sum(np.exp(-0.5 * ((b - c) / sd_baf) ** 2) for c in BAF[k]) / len(BAF[k]) if k else np.full(len(p), 0.5)
            pb = np.where(np.isnan(b), 0.5 if k == 0 else 0.5 / 3, pb)
            pl = np.where(r < -1.5, 1.0, 0.0) if k == 0 else np.exp(-0.5 * ((r - LRR[k]) / sd_lrr) ** 2)
            pl = np.where(np.isnan(r), 1.0, pl)
            e[:, k] = error + (1 - w_baf + w_baf * pb) * (1 - w_lrr + w_lrr * pl)
        first = np.isnan(p["_prev"].to_numpy(dtype=float, na_value=np.nan)[0])
        t = np.broadcast_to(tr, (len(p), 4, 4))
        return e, np.concatenate([np.eye(4)[None], t[1:]]) if first else t

    def finish(p: pd.DataFrame, path: np.ndarray, posterior: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"sample": p["sample"].to_numpy(), "chrom": p["chrom"].to_numpy(), "pos": p["pos"].to_numpy(), "copies": path})

    return _decoded(calls, model, 4, piece, finish, "sample int, chrom string, pos long, copies int")


def trained_transitions(emission: np.ndarray, transition: np.ndarray, rounds: int = 20, tolerance: float = 1e-4) -> np.ndarray:
    """Baum-Welch: the transition matrix that expected transitions settle at, for fixed emissions (sites x states)."""
    t = transition.copy()
    for _ in range(rounds):
        n, k = emission.shape
        a, b = np.empty((n, k)), np.ones((n, k))
        a[0] = emission[0] / emission[0].sum()
        for i in range(1, n):
            a[i] = (a[i - 1] @ t) * emission[i]
            a[i] /= a[i].sum() or 1
        for i in range(n - 2, -1, -1):
            b[i] = t @ (emission[i + 1] * b[i + 1])
            b[i] /= b[i].sum() or 1
        pair = a[:-1, :, None] * t * (emission[1:] * b[1:])[:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        new = pair.sum(0)
        new /= new.sum(1, keepdims=True)
        done, t = np.abs(new - t).max() < tolerance, new
        if done:
            break
    return t
