"""Student t and F tail probabilities as vectorised column functions over fit rows.

Spark SQL has no t or F distribution. Both tails are regularised incomplete beta values, computed
per Arrow batch; there is one row per fitted model, so the volume is that of the results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def _lgamma(values: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in values.ravel()]).reshape(values.shape)


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln B(a, b), with the gamma ratio expanded for large a where lgamma would cancel."""
    big, small = np.maximum(a, b), np.minimum(a, b)
    direct = _lgamma(big) + _lgamma(small) - _lgamma(np.minimum(big + small, 1e300))
    ratio = -small * np.log(big) + small * (1 - small) / (2 * big)
    return np.where((big > 1e6) & (small < 1e3), _lgamma(small) + ratio, direct)


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta, evaluated until it settles."""
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    value = d.copy()
    for m in range(1, 20000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + step / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            value = value * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    return value


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), elementwise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    if not ok.any():
        return out
    a, b, x = a[ok], b[ok], x[ok]
    inner = np.clip(x, _TINY, 1 - 1e-16)
    front = np.exp(a * np.log(inner) + b * np.log1p(-inner) - _log_beta(a, b))
    swap = inner > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - inner, inner)
    part = front * _fraction(p, q, z) / p
    part = np.where(swap, 1 - part, part)
    out[ok] = np.where(x == 0, 0.0, np.where(x == 1, 1.0, part))
    return out


def t_two_sided_np(t, df) -> np.ndarray:
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper_np(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_quantile_np(level, df) -> np.ndarray:
    """Positive t with ``level`` probability between -t and t, by bisection."""
    level, df = np.broadcast_arrays(np.asarray(level, float), np.asarray(df, float))
    low, high = np.zeros(df.shape), np.full(df.shape, 2.0)
    for _ in range(200):
        short = 1 - t_two_sided_np(high, df) < level
        if not np.any(short):
            break
        high = np.where(short, high * 2, high)
    for _ in range(100):
        mid = (low + high) / 2
        below = 1 - t_two_sided_np(mid, df) < level
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.where(df > 0, (low + high) / 2, np.nan)


@F.pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided_np(t, df))


@F.pandas_udf(DoubleType())
def _f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper_np(f, d1, d2))


@F.pandas_udf(DoubleType())
def _t_quantile(level: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_quantile_np(level, df))


def _real(c: Column) -> Column:
    return F.nullif(c, F.lit(float("nan")))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic."""
    return _real(_t_two_sided(t.cast("double"), df.cast("double")))


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    """Upper-tail p-value of an F statistic."""
    return _real(_f_upper(f.cast("double"), d1.cast("double"), d2.cast("double")))


def t_quantile(level: float, df: Column) -> Column:
    """Half-width, in standard errors, of a two-sided confidence interval."""
    return _real(_t_quantile(F.lit(float(level)), df.cast("double")))
