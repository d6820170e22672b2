"""Distribution functions and quantiles in plain numpy, and the vectorised UDFs made of them."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return _NORMAL.cdf(x)


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def gamma_cdf(x: float, shape: float, scale: float) -> float:
    """Regularised lower incomplete gamma: series below shape + 1, continued fraction above."""
    z = x / scale
    if z <= 0:
        return 0.0
    front = math.exp(shape * math.log(z) - z - math.lgamma(shape))
    if z < shape + 1:
        term = total = 1 / shape
        k = shape
        while abs(term) > 1e-17 * abs(total):
            k += 1
            term *= z / k
            total += term
        return front * total
    b, tiny = z + 1 - shape, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - shape)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def polygammas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of log Gamma at positive numbers: shifted above 10, then the asymptotic series."""
    y = np.array(x, float)
    first, second = np.zeros_like(y), np.zeros_like(y)
    for _ in range(10):
        low = y < 10
        inverse = np.where(low, 1 / y, 0.0)
        first, second = first - inverse, second + inverse * inverse
        y = np.where(low, y + 1, y)
    i = 1 / y
    q = i * i
    first += np.log(y) - i / 2 - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132))))
    second += i + q / 2 + i * q * (1 / 6 - q * (1 / 30 - q * (1 / 42 - q * (1 / 30 - q * 5 / 66))))
    return first, second


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers: shifted above 10, then Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1, y)
    i = 1 / y
    i2 = i * i
    series = i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188))))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, on arrays."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    turn = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(inner) + b * np.log1p(-inner)) / a
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * inner / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for even in (True, False):
            if even:
                k = m * (b - m) * inner / ((a + 2 * m - 1) * (a + 2 * m))
            else:
                k = -(a + m) * (a + b + m) * inner / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    p = np.where(x <= 0, 0.0, front * h)
    return np.where(turn, 1 - p, p)


def beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By bisection to the last bits."""
    p, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(p, a, b))
    low, high = np.zeros_like(p), np.ones_like(p)
    for _ in range(64):
        mid = (low + high) / 2
        below = beta_cdf(mid, a, b) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def t_quantile(p: float | np.ndarray, df: np.ndarray) -> np.ndarray:
    """Student's t, through the beta distribution of df / (df + t^2)."""
    p, df = np.asarray(p, float), np.asarray(df, float)
    tail = np.minimum(p, 1 - p)
    x = beta_quantile(2 * tail, df / 2, np.full_like(df, 0.5))
    t = np.sqrt(df * (1 - x) / np.maximum(x, 1e-300))
    return np.where(p < 0.5, -t, t)


def clopper_pearson(k: np.ndarray, n: np.ndarray, confidence: float) -> tuple[np.ndarray, np.ndarray]:
    """Exact binomial limits; 0 at k = 0 and 1 at k = n; nan for n = 0."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    tail = (1 - confidence) / 2
    low = np.where(k > 0, beta_quantile(tail, np.maximum(k, 1), np.maximum(n - k, 0) + 1), 0.0)
    high = np.where(k < n, beta_quantile(1 - tail, k + 1, np.maximum(n - k, 1)), 1.0)
    none = n <= 0
    return np.where(none, np.nan, low), np.where(none, np.nan, high)


def binomial_interval(k, n, confidence: float = 0.95):
    """Column struct(lower, upper) of the exact interval; for grouped results, so a few rows."""

    @F.pandas_udf("lower double, upper double")
    def limits(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        low, high = clopper_pearson(k.to_numpy(float), n.to_numpy(float), confidence)
        return pd.DataFrame({"lower": pd.Series(low).where(~np.isnan(low), None), "upper": pd.Series(high).where(~np.isnan(high), None)})

    return limits(k, n)


def t_critical(df, confidence: float = 0.95):
    """Column of two-sided t quantiles by degrees of freedom; null below one."""

    @F.pandas_udf("double")
    def critical(df: pd.Series) -> pd.Series:
        d = df.to_numpy(float)
        out = t_quantile(np.full(len(d), 0.5 + confidence / 2), np.maximum(d, 1))
        return pd.Series(out).where(pd.Series(d) >= 1, None)

    return critical(df)
