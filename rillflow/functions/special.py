"""Special functions, computed on whole Arrow batches with numpy: series, continued fractions and asymptotic expansions from the textbooks.

Each takes and gives doubles; a null or NaN argument gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bernoulli numbers B2, B4, ...
BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)
ROUNDS, CLOSE, TINY = 2000, 1e-16, 1e-300


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln |gamma(x)|: Stirling's series after moving up to 10 or more, reflection below 1/2; infinite at 0 and at negative integers."""
    below = x < 0.5
    up = np.where(below, 1 - x, x)
    moved = np.zeros_like(up)
    for _ in range(10):
        small = up < 10
        moved = moved + np.where(small, np.log(np.where(small, up, 1.0)), 0)
        up = np.where(small, up + 1, up)
    tail = sum(b / (2 * k * (2 * k - 1)) / up ** (2 * k - 1) for k, b in enumerate(BERNOULLI, 1))
    found = (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + tail - moved
    whole = below & (x == np.floor(x))
    sine = np.abs(np.sin(np.pi * np.where(below & ~whole, x, 0.5)))
    return np.where(whole, np.inf, np.where(below, np.log(np.pi / sine) - found, found))


def psi(x: np.ndarray) -> np.ndarray:
    """The derivative of ``log_gamma``."""
    below = x < 0.5
    up, moved = np.where(below, 1 - x, x), np.zeros_like(x)
    for _ in range(10):
        small = up < 10
        moved = moved + np.where(small, 1 / np.where(small, up, 1.0), 0)
        up = np.where(small, up + 1, up)
    found = np.log(up) - 0.5 / up - sum(b / (2 * k) / up ** (2 * k) for k, b in enumerate(BERNOULLI, 1)) - moved
    whole = below & (x == np.floor(x))
    return np.where(whole, np.nan, np.where(below, found - np.pi / np.tan(np.pi * np.where(below & ~whole, x, 0.25)), found))


def hurwitz(s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sum of (q + k)**-s over k from 0, for s > 1 and q > 0, by Euler and Maclaurin."""
    good = (s > 1) & (q > 0)
    s, q = np.where(good, s, 2.0), np.where(good, q, 1.0)
    total = sum((q + k) ** -s for k in range(12))
    top = q + 12
    total = total + top ** (1 - s) / (s - 1) + 0.5 * top**-s
    rising = s
    for k, b in enumerate(BERNOULLI, 1):
        total = total + b / factorial(2 * k) * rising * top ** (-s - 2 * k + 1)
        rising = rising * (s + 2 * k - 1) * (s + 2 * k)
    return np.where(good, total, np.nan)


def gamma_share(a: np.ndarray, x: np.ndarray, upper: bool = False) -> np.ndarray:
    """The regularised incomplete gamma function, lower or upper, for a > 0 and x >= 0: a series below a + 1, a continued fraction above."""
    good = (a > 0) & (x >= 0)
    a, x = np.where(good, a, 1.0), np.where(good, x, 1.0)
    scale = np.exp(a * np.log(np.maximum(x, TINY)) - x - log_gamma(a))
    term = total = 1 / a
    for n in range(1, ROUNDS):
        term = term * x / (a + n)
        total = total + term
        if (term <= total * CLOSE)[x < a + 1].all():
            break
    low = scale * total
    b = x + 1 - a
    c, d = np.full_like(x, 1 / TINY), 1 / np.where(b == 0, TINY, b)
    h = d
    for n in range(1, ROUNDS):
        an, b = -n * (n - a), b + 2
        d, c = an * d + b, b + an / c
        d, c = 1 / np.where(np.abs(d) < TINY, TINY, d), np.where(np.abs(c) < TINY, TINY, c)
        h = h * d * c
        if (np.abs(d * c - 1) < 1e-15)[x >= a + 1].all():
            break
    high = scale * h
    found = np.where(x < a + 1, 1 - low if upper else low, high if upper else 1 - high)
    return np.where(good, np.where(x == 0, float(upper), found), np.nan)


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function for a, b > 0 and x in [0, 1], by a continued fraction."""
    good = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    a, b, x = np.where(good, a, 1.0), np.where(good, b, 1.0), np.where(good, x, 0.5)
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    scale = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(np.maximum(y, TINY)) + q * np.log(np.maximum(1 - y, TINY))) / p
    safe = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    c, d = np.ones_like(y), 1 / safe(1 - (p + q) * y / (p + 1))
    h = d
    for m in range(1, ROUNDS):
        for t in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / safe(1 + t * d), safe(1 + t / c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    found = np.where(y == 0, 0.0, scale * h)
    return np.where(good, np.where(turned, 1 - found, found), np.nan)


def bessel_scaled(order: int, x: np.ndarray) -> np.ndarray:
    """exp(-|x|) I_order(x): the trapezoid rule on the integral over half a turn, which converges at once for a periodic function."""
    out = np.zeros_like(x)
    nodes = (np.arange(400) + 0.5) * np.pi / 400
    size = np.abs(x)
    for at in range(0, len(x), 4096):
        part = size[at : at + 4096, None]
        narrow = np.minimum(1.0, 12 / np.sqrt(np.maximum(part, 1.0)))  # where the integrand is more than nothing
        turn = nodes * narrow
        whole = np.exp(part * (np.cos(turn) - 1)) * np.cos(order * turn)
        out[at : at + 4096] = whole.mean(1) * narrow[:, 0]
    return np.where(x < 0, (-1) ** order * out, out)


def error_function(x: np.ndarray, complement: bool = False) -> np.ndarray:
    half, square = np.full_like(x, 0.5), x * x
    if not complement:
        return np.sign(x) * gamma_share(half, square)
    return np.where(x >= 0, gamma_share(half, square, upper=True), 1 + gamma_share(half, square))


def _vectorised(function: Callable[..., np.ndarray]) -> Callable[..., Column]:
    @F.pandas_udf(T.DoubleType())
    def one(x: pd.Series) -> pd.Series:
        return _applied(function, x)

    @F.pandas_udf(T.DoubleType())
    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        return _applied(function, x, y)

    @F.pandas_udf(T.DoubleType())
    def three(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return _applied(function, x, y, z)

    return lambda *columns: (one, two, three)[len(columns) - 1](*[c.cast("double") for c in columns])


def _applied(function: Callable[..., np.ndarray], *series: pd.Series) -> pd.Series:
    with np.errstate(all="ignore"):
        values = [s.to_numpy(np.float64, na_value=np.nan) for s in series]
        found = function(*values)
    unknown = np.isnan(np.stack(values)).any(0)
    return pd.Series(np.where(unknown, np.nan, found)).where(~unknown, None)


lgamma, digamma = _vectorised(log_gamma), _vectorised(psi)
erf, erfc = _vectorised(error_function), _vectorised(lambda x: error_function(x, True))
zeta = _vectorised(hurwitz)
polygamma = _vectorised(lambda n, x: np.where(n == 0, psi(x), np.where(n % 2 == 1, 1, -1) * np.exp(log_gamma(n + 1)) * hurwitz(n + 1, x)))
igamma, igammac = _vectorised(gamma_share), _vectorised(lambda a, x: gamma_share(a, x, True))
betainc = _vectorised(beta_share)
bessel_i0e, bessel_i1e = _vectorised(lambda x: bessel_scaled(0, x)), _vectorised(lambda x: bessel_scaled(1, x))
