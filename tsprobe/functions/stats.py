"""Student t quantiles and signed-rank p-values for tables that already have one row per group."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f, tiny = 1.0, 0.0, 1.0, 1e-300
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


@lru_cache(maxsize=4096)
def t_quantile(p: float, dof: float) -> float:
    """Quantile of Student's t for p > 0.5 by bisection on the tail area."""
    def tail(t: float) -> float:
        return 0.5 * _beta_tail(dof / (dof + t * t), dof / 2, 0.5)

    lo, hi = 0.0, 1.0
    while tail(hi) > 1 - p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > 1 - p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def t_critical_95(dof: pd.Series) -> pd.Series:
    return dof.map(lambda d: t_quantile(0.975, float(d)) if d and d > 0 else 0.0)


@lru_cache(maxsize=64)
def _rank_sum_counts(n: int) -> tuple[int, ...]:
    """How many sign patterns of ranks 1..n give each positive rank sum."""
    ways = [1]
    for r in range(1, n + 1):
        ways = [(ways[s] if s < len(ways) else 0) + (ways[s - r] if 0 <= s - r < len(ways) else 0) for s in range(len(ways) + r)]
    return tuple(ways)


def signed_rank_p(n: int, w_plus: float, ties: float) -> float:
    """One-sided p (greater): exact for at most 50 untied differences, else normal with tie correction."""
    if n == 0:
        return float("nan")
    if n <= 50 and ties == 0:
        ways = _rank_sum_counts(n)
        return sum(ways[int(math.ceil(w_plus)):]) / 2 ** n
    variance = (n * (n + 1) * (2 * n + 1) - ties / 2) / 24
    if variance <= 0:
        return float("nan")
    return 0.5 * math.erfc((w_plus - n * (n + 1) / 4) / math.sqrt(2 * variance))


@F.pandas_udf(DoubleType())
def signed_rank_p_udf(n: pd.Series, w_plus: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(int(a), float(b), float(c)) for a, b, c in zip(n, w_plus, ties)], dtype="float64")
