"""Normal and Student t distributions without SciPy, in plain Python and as Arrow functions over per-test rows."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_N = NormalDist()
Z95 = _N.inv_cdf(0.975)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _N.inv_cdf(p)


def scan_corrected_z(n: int, alpha: float = 0.05) -> float:
    """Threshold for the largest of n deviations (Bonferroni over both sides)."""
    return _N.inv_cdf(1 - alpha / (2 * n))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, modified Lentz."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    if df <= 0 or math.isnan(t):
        return 1.0
    if math.isinf(t):
        return 0.0
    return regularised_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Inverse of the t distribution function, by bisection on the tail."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high, target = 0.0, 2.0, 2 * (1 - p)
    while t_two_sided(high, df) > target and high < 1e12:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if t_two_sided(mid, df) > target:
            low = mid
        else:
            high = mid
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else t_two_sided(a, b) for a, b in zip(t, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_critical95(df: pd.Series) -> pd.Series:
    return df.map(lambda x: None if pd.isna(x) else t_quantile(0.975, x)).astype("float64")


@F.pandas_udf(T.DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else normal_two_sided(x)).astype("float64")
