"""Exact binomial bounds, without a statistics library."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularized incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 1000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def clopper_pearson_upper(misses: int, n: int, confidence: float) -> float:
    """1 for an empty lane and for one that only misses."""
    return 1.0 if n == 0 or misses >= n else beta_quantile(confidence, misses + 1, n - misses)


def clopper_pearson_lower(hits: int, n: int, confidence: float) -> float:
    return 0.0 if n == 0 or hits == 0 else beta_quantile(1 - confidence, hits, n - hits + 1)


def upper_bound(confidence: float):
    @F.pandas_udf(DoubleType())
    def bound(misses: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([clopper_pearson_upper(int(m), int(k), confidence) for m, k in zip(misses, n)], dtype="float64")

    return bound
