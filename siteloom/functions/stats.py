"""Exact tests in numpy, as Arrow-batched UDFs. Log-factorials come from a table that grows as needed."""

from __future__ import annotations

from collections.abc import Callable
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_table = np.zeros(1)


def log_factorial(n: np.ndarray) -> np.ndarray:
    global _table
    n = np.asarray(n)
    top = int(n.max(initial=0))
    if top >= len(_table) and top < 10_000_000:
        _table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 2 * top + 2)))])
    if top < len(_table):
        return _table[n.astype(np.int64)]
    return np.array([lgamma(x + 1) for x in n.ravel()]).reshape(n.shape)


def fisher_two_sided(n11: int, n12: int, n21: int, n22: int) -> float:
    """Two-tailed Fisher exact test of a 2x2 table: all tables at most as likely."""
    r1, r2, c1 = n11 + n12, n21 + n22, n11 + n21
    n = r1 + r2
    if not n:
        return 1.0
    k = np.arange(max(0, c1 - r2), min(r1, c1) + 1)
    lf = log_factorial
    fixed = lf(np.array(r1)) + lf(np.array(r2)) + lf(np.array(c1)) + lf(np.array(n - c1)) - lf(np.array(n))
    logp = fixed - (lf(k) + lf(r1 - k) + lf(c1 - k) + lf(r2 - c1 + k))
    p = np.exp(logp)
    here = p[n11 - k[0]]
    return float(min(1.0, p[p <= here * (1 + 1e-8)].sum()))


def binomial_two_sided(a: int, b: int) -> float | None:
    """Two-sided exact binomial test of a against b with equal odds; None without observations."""
    n = a + b
    if n == 0:
        return None
    if a == b:
        return 1.0
    k = np.arange(0, min(a, b) + 1)
    logp = log_factorial(np.full(k.shape, n)) - log_factorial(k) - log_factorial(n - k) - n * np.log(2)
    return float(min(1.0, 2 * np.exp(logp).sum()))


def hwe_exact(n_ref: int, n_alt: int, n_het: int) -> tuple[float, float]:
    """(Hardy-Weinberg p, excess heterozygosity p) for allele counts and observed heterozygotes."""
    rare = min(n_ref, n_alt)
    n = n_ref + n_alt
    if n == 0 or rare == 0:
        return 1.0, 1.0
    hets = np.arange(rare & 1, rare + 1, 2)
    rare_hom, common_hom = (rare - hets) // 2, (n - rare - hets) // 2
    lf = log_factorial
    logp = hets * np.log(2) - lf(hets) - lf(rare_hom) - lf(common_hom)
    p = np.exp(logp - logp.max())
    p /= p.sum()
    at = np.searchsorted(hets, n_het)
    if at >= len(hets) or hets[at] != n_het:
        return 1.0, 1.0
    return float(min(1.0, p[p <= p[at] * (1 + 1e-12)].sum())), float(min(1.0, p[at:].sum()))


def _each(test: Callable, columns: list[np.ndarray]) -> np.ndarray:
    """``test`` of the rows of columns of counts; each distinct row is computed once, a row with a missing count gives NaN."""
    x = np.stack(columns, 1)
    out, known = np.full(len(x), np.nan), ~np.isnan(x).any(1)
    if known.any():
        rows, which = np.unique(x[known].astype(np.int64), axis=0, return_inverse=True)
        values = [test(*r) for r in rows.tolist()]
        out[known] = np.array([np.nan if v is None else v for v in values])[which.ravel()]
    return out


def _nullable(x: np.ndarray) -> pd.Series:
    return pd.Series(x).astype(object).where(~np.isnan(x), None)


def _floats(s: pd.Series) -> np.ndarray:
    return pd.to_numeric(s).to_numpy(dtype=float, na_value=np.nan)


@F.pandas_udf(T.DoubleType())
def fisher_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _nullable(_each(fisher_two_sided, [_floats(x) for x in (a, b, c, d)]))


@F.pandas_udf(T.DoubleType())
def binom_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _nullable(_each(binomial_two_sided, [_floats(a), _floats(b)]))


def _of_arrays(test: Callable, columns: list[pd.Series]) -> pd.Series:
    """The same for arrays of one length a row (an array of results a row)."""
    sizes = [0 if x is None else len(x) for x in columns[0]]
    flat = [np.concatenate([np.asarray(x, float) for x in c if x is not None]) if sum(sizes) else np.zeros(0) for c in columns]
    parts = np.split(_each(test, flat), np.cumsum(sizes)[:-1]) if len(sizes) else []
    return pd.Series([[None if np.isnan(v) else float(v) for v in p] for p in parts], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def binom_arrays_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return _of_arrays(binomial_two_sided, [a, b])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fisher_arrays_udf(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return _of_arrays(fisher_two_sided, [a, b, c, d])


@F.pandas_udf(T.StructType([T.StructField("hwe", T.DoubleType()), T.StructField("exc_het", T.DoubleType())]))
def hwe_udf(n_ref: pd.Series, n_alt: pd.Series, n_het: pd.Series) -> pd.DataFrame:
    columns = [_floats(x) for x in (n_ref, n_alt, n_het)]
    return pd.DataFrame({"hwe": _nullable(_each(lambda *r: hwe_exact(*r)[0], columns)), "exc_het": _nullable(_each(lambda *r: hwe_exact(*r)[1], columns))})
