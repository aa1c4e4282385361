"""Student t distribution for already grouped results.

Spark has no t distribution.  These Arrow functions see one row per test or
group, never raw answers.
"""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def _inc_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction."""
    flip = x > (a + 1.0) / (a + b + 2.0)
    p = np.where(flip, b, a)
    q = np.where(flip, a, b)
    z = np.where(flip, 1.0 - x, x)
    log_beta = np.array([lgamma(i) + lgamma(j) - lgamma(i + j) for i, j in zip(p, q)])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) - log_beta) / p
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1.0 - (p + q) * z / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    fraction = d.copy()
    for m in range(1, 300):
        even = m * (q - m) * z / ((p + 2 * m - 1.0) * (p + 2 * m))
        odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1.0))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            fraction = fraction * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    value = np.where(z > 0, front * fraction, 0.0)
    return np.where(flip, 1.0 - value, value)


def two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    out = np.full(len(t), np.nan)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    if ok.any():
        out[ok] = _inc_beta(df[ok] / 2.0, 0.5, df[ok] / (df[ok] + t[ok] ** 2))
    return out


def quantile(prob: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper quantile for prob >= 0.5 by bisection."""
    out = np.full(len(prob), np.nan)
    ok = np.isfinite(prob) & np.isfinite(df) & (df > 0)
    if not ok.any():
        return out
    tail = 2.0 * (1.0 - prob[ok])
    lo = np.zeros(ok.sum())
    hi = np.ones(ok.sum())
    while np.any(two_sided(hi, df[ok]) > tail):
        hi = np.where(two_sided(hi, df[ok]) > tail, hi * 2.0, hi)
    for _ in range(200):
        mid = (lo + hi) / 2.0
        above = two_sided(mid, df[ok]) > tail
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    out[ok] = (lo + hi) / 2.0
    return out


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value; NULL in gives NULL out."""
    p = two_sided(t.to_numpy(float), df.to_numpy(float))
    return pd.Series(p).astype(object).where(~np.isnan(p), None)


@F.pandas_udf(T.DoubleType())
def t_quantile(prob: pd.Series, df: pd.Series) -> pd.Series:
    q = quantile(prob.to_numpy(float), df.to_numpy(float))
    return pd.Series(q).astype(object).where(~np.isnan(q), None)
