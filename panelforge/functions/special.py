"""Exact binomial intervals without SciPy: the regularised incomplete beta function and its inverse, for many values at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x <= 0, 0.0, 1.0)
    inner = (x > 0) & (x < 1)
    swap = inner & (x > (a + 1) / (a + b + 2))
    p, q, z = np.where(swap, b, a)[inner], np.where(swap, a, b)[inner], np.where(swap, 1 - x, x)[inner]
    front = np.exp((_lgamma(p + q) - _lgamma(p) - _lgamma(q)).astype(float) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    guard = lambda v: np.where(v == 0, tiny, v)
    c, d = np.ones_like(z), 1 / guard(1 - (p + q) * z / (p + 1))
    f, m = d.copy(), 1
    while z.size and m < 1000:
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / guard(1 + num * d), guard(1 + num / c)
            f *= c * d
        if np.abs(c * d - 1).max() < 1e-16:
            break
        m += 1
    value = front * f
    out[inner] = np.where(swap[inner], 1 - value, value)
    return out


def beta_quantile(p: float, a, b) -> np.ndarray:
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    low, high = np.zeros(a.shape), np.ones(a.shape)
    for _ in range(64):
        mid = (low + high) / 2
        less = incomplete_beta(a, b, mid) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


def clopper_pearson(k, n, confidence: float = 0.95):
    """Two-sided exact interval of a binomial share; 0 and 1 exactly at the ends. Numbers give numbers, arrays arrays."""
    k, n = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float))
    tail = (1 - confidence) / 2
    low = np.where(k == 0, 0.0, beta_quantile(tail, np.maximum(k, 1), n - k + 1))
    high = np.where(k == n, 1.0, beta_quantile(1 - tail, k + 1, np.maximum(n - k, 1)))
    return (float(low), float(high)) if low.ndim == 0 else (low, high)


def upper_bound(k, n, confidence: float = 0.95):
    k, n = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float))
    out = np.where(k == n, 1.0, beta_quantile(confidence, k + 1, np.maximum(n - k, 1)))
    return float(out) if out.ndim == 0 else out


def with_exact_interval(df: DataFrame, k: str, n: str, upper: float = 0.95) -> DataFrame:
    """df with low and high (two-sided, 95 %) and the one-sided upper bound of the share k of n. Each distinct pair of a batch is solved once, all together."""

    @F.pandas_udf("struct<low: double, high: double, upper: double>")
    def interval(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        pairs, back = np.unique(np.stack([a.to_numpy(np.int64), b.to_numpy(np.int64)]), axis=1, return_inverse=True)
        low, high = clopper_pearson(*pairs)
        return pd.DataFrame({"low": low, "high": high, "upper": upper_bound(*pairs, upper)}).iloc[back.ravel()].reset_index(drop=True)

    return df.withColumn("__i", interval(k, n)).select("*", "__i.*").drop("__i")
