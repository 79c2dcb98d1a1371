"""Tail probabilities that Spark has no function for, on small result frames."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the incomplete-beta continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_upper(t: float, df: float) -> float:
    """P(T > t) of Student's t."""
    half = 0.5 * incomplete_beta(df / 2.0, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


@F.pandas_udf(DoubleType())
def upper_tail(stat: pd.Series, df: pd.Series) -> pd.Series:
    """P(X > stat): Student's t with df degrees, normal where df is missing."""
    ok = lambda v: v is not None and v == v
    return pd.Series([None if not ok(t) else student_upper(t, d) if ok(d) and d > 0 else normal_upper(t) for t, d in zip(stat, df)], dtype="float64")


def two_sided(stat, df):
    p = 2.0 * upper_tail(F.abs(stat), df)
    return F.least(F.lit(1.0), p)


@F.pandas_udf(DoubleType())
def signed_rank_p(w: pd.Series, n: pd.Series, tie_term: pd.Series) -> pd.Series:
    """Two-sided p of the signed-rank statistic: exact counts to 50 pairs without ties, else normal."""

    def one(stat: float, size: float, ties: float) -> float:
        size = int(size)
        if size == 0:
            return 1.0
        if size <= 50 and ties == 0:
            counts = [1]
            for k in range(1, size + 1):
                new = counts + [0] * k
                for i, c in enumerate(counts):
                    new[i + k] += c
                counts = new
            return min(1.0, 2.0 * sum(counts[: int(stat) + 1]) / 2.0**size)
        mean = size * (size + 1) / 4.0
        var = size * (size + 1) * (2 * size + 1) / 24.0 - ties / 48.0
        return min(1.0, 2.0 * normal_upper(abs(stat - mean) / math.sqrt(var))) if var > 0 else 1.0

    return pd.Series([one(a, b, c) for a, b, c in zip(w, n, tie_term)], dtype="float64")
