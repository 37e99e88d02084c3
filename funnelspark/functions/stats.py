"""Small statistics: intervals, weights, deterministic draws."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, places: int | None = None) -> Column:
    """a / b, 0 where b is 0 or null."""
    out = F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return out if places is None else F.bround(out, places)


def kish_n(weight: Column) -> Column:
    """Effective sample size (aggregate) of the finite positive weights."""
    w = F.when((weight > 0) & ~F.isnan(weight) & (weight < float("inf")), weight)
    return F.coalesce(F.try_divide(F.pow(F.sum(w), F.lit(2.0)), F.sum(w * w)), F.lit(0.0))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d if abs(1 + num * d) > tiny else tiny)
            c = 1 + num / c if abs(1 + num / c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * total


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if incomplete_beta(a, b, mid) < p else (low, mid)
    return (low + high) / 2


def jeffreys(successes: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Interval of a rate under the Jeffreys prior; (0, 1) without observations."""
    if not n:
        return 0.0, 1.0
    tail = (1 - level) / 2
    return tuple(beta_quantile(p, successes + 0.5, n - successes + 0.5) for p in (tail, 1 - tail))


def jeffreys_column(successes: Column, n: Column) -> Column:
    """struct<low, high>; an Arrow UDF, as Spark has no beta quantile. Distinct pairs are computed once."""

    @F.pandas_udf("low double, high double")
    def run(s: pd.Series, m: pd.Series) -> pd.DataFrame:
        known = {k: jeffreys(*k) for k in set(zip(s.astype(int), m.astype(int), strict=True))}
        return pd.DataFrame([known[k] for k in zip(s.astype(int), m.astype(int), strict=True)], columns=["low", "high"])

    return run(successes, n)


def triangular(u: Column, low: float, mode: float, high: float) -> Column:
    """Inverse distribution function; the central value where the range is empty."""
    if high <= low:
        return F.lit(float(mode))
    cut = (mode - low) / (high - low)
    up = low + F.sqrt(u * (high - low) * (mode - low))
    return F.when(u < cut, up).otherwise(high - F.sqrt((1 - u) * (high - low) * (high - mode)))


def spread(i: Column, n: int, a: int, b: int) -> Column:
    """Stratified u in (0, 1) of draw i: a permutation of n strata for each (a, b); a is coprime to n."""
    return (F.pmod(i * a + b, F.lit(n)) + 0.5) / n


def penalised_ls(gram: np.ndarray, moment: np.ndarray, penalty: np.ndarray, prior: tuple[int, float, float] | None = None) -> np.ndarray:
    """Coefficients of least squares with ridge penalties and, for one of them, a prior (index, mean, strength)."""
    gram, moment = gram + np.diag(penalty), moment.copy()
    if prior:
        i, mean, strength = prior
        gram[i, i] += strength
        moment[i] += strength * mean
    return np.linalg.solve(gram, moment)
