"""Student's t distribution for result rows, by the continued fraction of the incomplete beta function."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta_part(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_part(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Evaluated backwards from a depth at which double precision is reached.
    value = 0.0
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = odd / (1 + even / (1 + value))
    return front / (1 + value)


def cdf(t: float, df: float) -> float:
    if not (math.isfinite(t) and df > 0):
        return math.nan
    tail = 0.5 * _beta_part(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def quantile(p: float, df: float) -> float:
    if not (0 < p < 1 and df > 0):
        return math.nan
    lo, hi = -1.0, 1.0
    while cdf(lo, df) > p:
        lo *= 2
    while cdf(hi, df) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def _cdfs(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([cdf(a, b) for a, b in zip(t.astype(float), df.astype(float), strict=True)])


def _quantiles(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([quantile(a, b) for a, b in zip(p.astype(float), df.astype(float), strict=True)])


def t_cdf(t: Column, df: Column) -> Column:
    return F.pandas_udf(_cdfs, "double")(t, df)


def t_quantile(p: Column, df: Column) -> Column:
    return F.pandas_udf(_quantiles, "double")(p, df)
