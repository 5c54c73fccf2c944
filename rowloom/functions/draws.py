"""Binomial and negative binomial draws by inversion, at any count, and log-gamma as a column.

A draw is the least k whose cumulative probability reaches u, so it depends on nothing but its
arguments. The cumulative probabilities are regularised incomplete beta functions: a continued fraction,
or where both of its arguments are large a fixed Gauss-Legendre sum, over Loader's saddle-point form of the
density, which neither underflows nor cancels. The search starts at the Cornish-Fisher quantile, so
a value takes a few evaluations whatever its count.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Both arguments of the beta function from which on the fixed sum is used, and its nodes.
LARGE, NODES = 3_000.0, 48
#: Steps of the continued fraction; below LARGE it settles long before.
MOST_STEPS = 2_000
_X, _W = np.polynomial.legendre.leggauss(NODES)


def _stirling_error(x: np.ndarray) -> np.ndarray:
    """log x! less Stirling's formula, for x > 0."""
    small = x < 16
    y = np.where(small, x + 16, x)
    s = 1 / (y * y)
    out = (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / y
    if small.any():
        z = x[small]
        back = sum(np.log(z + k) for k in range(1, 17))  # log (x + 16)! - log x!
        big = (z + 16.5) * np.log(z + 16) - z - 16
        out[small] += big - back - ((z + 0.5) * np.log(z) - z)
    return out


def _deviance(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x log(x / m) + m - x without cancellation, for x, m > 0."""
    v = (x - m) / (x + m)
    close = np.abs(v) < 0.1
    out = np.empty_like(v)
    far = ~close
    out[far] = x[far] * np.log(x[far] / m[far]) + m[far] - x[far]
    w, xs = v[close], x[close]
    term, total, s = 2 * xs * w, (xs - m[close]) * w, w * w
    for k in range(1, 10):
        term = term * s
        total = total + term / (2 * k + 1)
    out[close] = total
    return out


def _density(x: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Binomial probability of x in n for real 0 < x < n."""
    log = _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * q)
    return np.exp(log) * np.sqrt(n / (2 * math.pi * x * (n - x)))


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The incomplete beta function's continued fraction by Lentz's method; rows that have settled drop out."""
    out = np.empty_like(x)
    at = np.arange(len(x))
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, MOST_STEPS):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * (d * c)
        left = np.abs(d * c - 1) > 1e-15
        if not left.all():
            out[at[~left]] = h[~left]
            at, a, b, x, c, d, h = (v[left] for v in (at, a, b, x, c, d, h))
            if not len(at):
                return out
    out[at] = h
    return out


def _large(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) for large a and b: the smaller side as a sum over ten deviations of the density at most."""
    mode = (a - 1) / (a + b - 2)
    sd = np.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    up = x > mode
    end = np.where(up, np.minimum(1, np.maximum(mode + 11 * sd, x + 6 * sd)), np.maximum(0, np.minimum(mode - 11 * sd, x - 6 * sd)))
    t = x[:, None] + (end - x)[:, None] * (_X + 1) / 2
    off = t - mode[:, None]
    log = (a - 1)[:, None] * np.log1p(off / mode[:, None]) + (b - 1)[:, None] * np.log1p(-off / (1 - mode)[:, None])
    side = np.abs(end - x) / 2 * (np.exp(log) @ _W) * _density(a - 1, a + b - 2, mode, 1 - mode) * (a + b - 1)
    return np.where(up, 1 - side, side)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """I_x(a, b), y = 1 - x, for a, b > 0 and 0 < x < 1."""
    out = np.empty_like(x)
    large = (a > LARGE) & (b > LARGE)
    if large.any():
        out[large] = _large(a[large], b[large], x[large])
    rest = ~large
    if rest.any():
        a, b, x, y = a[rest], b[rest], x[rest], y[rest]
        front = _density(a, a + b, x, y) * a * b / (a + b)
        low = x < (a + 1) / (a + b + 2)
        f = _fraction(np.where(low, a, b), np.where(low, b, a), np.where(low, x, y))
        out[rest] = np.where(low, front * f / a, 1 - front * f / b)
    return out


def _normal_quantile(u: np.ndarray) -> np.ndarray:
    """Within 5e-4; only where the search starts."""
    tail = np.clip(np.minimum(u, 1 - u), 1e-300, 0.5)
    t = np.sqrt(-2 * np.log(tail))
    z = t - (2.515517 + t * (0.802853 + t * 0.010328)) / (1 + t * (1.432788 + t * (0.189269 + t * 0.001308)))
    return np.where(u < 0.5, -z, z)


def _search(u: np.ndarray, start: np.ndarray, reaches: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The least k >= 0 with reaches(rows, k): steps that double until k is enclosed, then halves."""
    low, high = np.full(len(u), -1.0), np.full(len(u), np.inf)
    k, step = np.maximum(start, 0.0), np.ones(len(u))
    todo = np.arange(len(u))
    while len(todo):
        hit = reaches(todo, k[todo])
        high[todo[hit]] = k[todo[hit]]
        low[todo[~hit]] = k[todo[~hit]]
        todo = todo[high[todo] - low[todo] > 1]
        lo, hi, s = low[todo], high[todo], step[todo]
        inside = np.floor((lo + hi) / 2)
        nxt = np.where(np.isinf(hi), lo + s, np.where((lo < 0) & (hi - s > 0), hi - s, inside))
        k[todo], step[todo] = np.where(np.isinf(hi) | (lo < 0), nxt, inside), s * 2
    return high


def binomial_draws(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The least k with P(Binomial(n, p) <= k) >= u; n is whole."""
    n, p, u = (np.asarray(v, float) for v in (n, p, u))
    out = np.where(p >= 1, n, 0.0)
    some = (n >= 1) & (p > 0) & (p < 1)
    n, p, u = n[some], p[some], u[some]
    q = 1 - p
    sd, z = np.sqrt(n * p * q), _normal_quantile(u)
    start = np.clip(np.floor(n * p + sd * z + (z * z - 1) * (q - p) / 6), 0, n)

    def reaches(rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        below = k < n[rows]
        hit = ~below
        r, kk = rows[below], k[below]
        hit[below] = incomplete_beta(n[r] - kk, kk + 1, q[r], p[r]) >= u[r]
        return hit

    out[some] = _search(u, start, reaches)
    return np.where(np.maximum(out, 0) > 0, out, 0.0)


def negative_binomial_draws(mu: np.ndarray, theta: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The least k with P(NB(mean mu, inverse dispersion theta) <= k) >= u; u < 1."""
    mu, theta, u = (np.asarray(v, float) for v in (mu, theta, u))
    out = np.zeros(len(u))
    some = (mu > 0) & (theta > 0)
    mu, theta, u = mu[some], theta[some], u[some]
    p, q = theta / (theta + mu), mu / (theta + mu)
    sd, z = np.sqrt(mu / p), _normal_quantile(u)
    skew = (1 + q) / np.sqrt(theta * q)
    start = np.floor(np.maximum(mu + sd * (z + (z * z - 1) * skew / 6), 0))
    out[some] = _search(u, start, lambda r, k: incomplete_beta(theta[r], k + 1, p[r], q[r]) >= u[r])
    return out


def _whole(draws: Callable, a: pd.Series, b: pd.Series, u: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna() & u.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[known] = draws(*(v.to_numpy(dtype=float, na_value=np.nan)[known] for v in (a, b, u)))
    return pd.Series(out).astype("Int64")


@F.pandas_udf(LongType())
def _binomial(n: pd.Series, p: pd.Series, u: pd.Series) -> pd.Series:
    return _whole(binomial_draws, n, p, u)


@F.pandas_udf(LongType())
def _negative_binomial(mu: pd.Series, theta: pd.Series, u: pd.Series) -> pd.Series:
    return _whole(negative_binomial_draws, mu, theta, u)


def binomial(n: Column, p: Column, u: Column) -> Column:
    """The least k whose cumulative binomial probability reaches u; a null in, a null out."""
    return _binomial(n.cast("double"), p.cast("double"), u.cast("double"))


def negative_binomial(mu: Column, theta: Column, u: Column) -> Column:
    """The same for the negative binomial of mean mu and variance mu + mu^2 / theta."""
    return _negative_binomial(mu.cast("double"), theta.cast("double"), u.cast("double"))


def log_gamma(x: Column) -> Column:
    """log Gamma(x) for x > 0 in the JVM: Stirling's series at x + 8, walked back by one logarithm."""
    y = x + 8
    s = 1 / (y * y)
    series = (F.lit(1 / 12) - s * (F.lit(1 / 360) - s * (F.lit(1 / 1260) - s * (F.lit(1 / 1680) - s / 1188)))) / y
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)
