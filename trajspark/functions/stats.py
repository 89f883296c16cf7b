"""Exact tails on summary counts.

These run on result rows (a handful per study), never on data rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _log_choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _sum_down(log_first: float, ratio, k: int, last: int) -> float:
    """Terms from k down to ``last``, stopping once they no longer count."""
    total, term = 0.0, math.exp(log_first)
    while k >= last:
        total += term
        if term < total * 1e-18:
            break
        term *= ratio(k)
        k -= 1
    return total


def binom_half_two_sided(k: int, n: int) -> float:
    """Exact two-sided binomial p-value at p = 1/2."""
    if n == 0:
        return 1.0
    lo = min(k, n - k)
    if 2 * lo == n:
        return 1.0
    first = _log_choose(n, lo) - n * math.log(2.0)
    return min(1.0, 2.0 * _sum_down(first, lambda i: i / (n - i + 1.0), lo, 0))


def fisher_greater(a: int, a_n: int, b: int, b_n: int) -> float:
    """One-sided Fisher p: chance of at least ``a`` hits in the first arm."""
    hits, total = a + b, a_n + b_n
    if total == 0:
        return 1.0
    top, low = min(a_n, hits), max(0, a_n - (total - hits))
    if a <= low:
        return 1.0
    if a > top:
        return 0.0
    # sum the shorter way from a: up if a lies above the mode, else one minus the way down; both fall from the start
    up = a * (total + 2) > (a_n + 1) * (hits + 1)
    x = a if up else a - 1
    at = math.exp(_log_choose(hits, x) + _log_choose(total - hits, a_n - x) - _log_choose(total, a_n))
    tail, term = 0.0, at
    while low <= x <= top and term > tail * 1e-18:
        tail += term
        term *= (hits - x) * (a_n - x) / ((x + 1.0) * (total - hits - a_n + x + 1.0)) if up else \
            x * (total - hits - a_n + x) / ((hits - x + 1.0) * (a_n - x + 1.0))
        x += 1 if up else -1
    return min(1.0, tail if up else 1.0 - tail)


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction, evaluated from the front."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    value, c, d = 1.0, 1.0, 0.0
    for step in range(1, 10_000):
        m = step // 2
        part = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if step % 2 == 0 else \
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + part * d) or tiny)
        c = (1.0 + part / c) or tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front / value


def _binom_tail_ge(k: int, n: int, p: float) -> float:
    """Chance of k hits or more: an incomplete beta, whatever n is."""
    return 1.0 if k <= 0 else 0.0 if k > n else _beta_inc(k, n - k + 1, p)


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact binomial interval by bisection on the tails."""
    if n == 0:
        return (float("nan"), float("nan"))
    a = (1.0 - level) / 2.0

    def solve(f) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2.0
            lo, hi = (mid, hi) if f(mid) else (lo, mid)
        return (lo + hi) / 2.0

    low = 0.0 if k == 0 else solve(lambda p: _binom_tail_ge(k, n, p) < a)
    high = 1.0 if k == n else solve(lambda p: 1.0 - _binom_tail_ge(k + 1, n, p) > a)
    return (low, high)


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-square: series of the lower incomplete gamma, or far out the upper one's fraction."""
    if x <= 0 or df <= 0:
        return 1.0
    s, h = df / 2.0, x / 2.0
    if h > s + 1.0:
        value = h + 400.0
        for k in range(200, 0, -1):
            value = h + (k - s) / (1.0 + k / value)
        return math.exp(s * math.log(h) - h - math.lgamma(s)) / value
    term = total = 1.0 / s
    i = s
    while term > total * 1e-17:
        i += 1.0
        term *= h / i
        total += term
    return max(0.0, 1.0 - total * math.exp(s * math.log(h) - h - math.lgamma(s)))


@F.pandas_udf(T.DoubleType())
def mcnemar_p(n10: pd.Series, n01: pd.Series) -> pd.Series:
    return pd.Series([binom_half_two_sided(int(a), int(a + b)) for a, b in zip(n10, n01)])


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, a_n: pd.Series, b: pd.Series, b_n: pd.Series) -> pd.Series:
    return pd.Series([fisher_greater(*map(int, r)) for r in zip(a, a_n, b, b_n)])


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)) if v == v else float("nan"))


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(float(a), int(b)) for a, b in zip(x, df)])


@F.pandas_udf(T.StructType([T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType())]))
def exact_interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clopper_pearson(int(a), int(b)) for a, b in zip(k, n)],
                        columns=["low", "high"])


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval as expressions (null when n = 0)."""
    p = k / n
    zz = F.lit(z * z)
    d = F.lit(1.0) + zz / n
    centre = (p + zz / (2 * n)) / d
    half = F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / d
    has = n > 0
    return (F.when(has, F.greatest(F.lit(0.0), centre - half)),
            F.when(has, F.least(F.lit(1.0), centre + half)))
