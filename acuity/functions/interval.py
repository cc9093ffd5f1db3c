"""Exact (Clopper-Pearson) interval for a binomial share.

Spark has no beta quantile, so the interval is an Arrow function over the
one-row-per-procedure table. It runs on the distinct pairs of each batch, uses
the closed forms at 0 and n, and stays exact for counts of any size.
"""

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F, types as T

# Executors get this small module with the task; it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_INTERVAL = T.StructType([T.StructField("ci_lower", T.DoubleType()), T.StructField("ci_upper", T.DoubleType())])
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def _log_gamma(z):
    return np.fromiter(map(math.lgamma, z), float, len(z))


def _log_beta(a, b):
    return _log_gamma(a) + _log_gamma(b) - _log_gamma(a + b)


def _beta_fraction(x, a, b):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-14):
            return h
    raise ArithmeticError("the beta fraction did not converge")


def _beta_cdf_small(x, a, b):
    front = a * np.log(x) + b * np.log1p(-x) - _log_beta(a, b)
    flip = x > (a + 1) / (a + b + 2)
    out = np.exp(front) * _beta_fraction(np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b))
    return np.where(flip, 1 - out / b, out / a)


def _beta_cdf_large(x, a, b):
    """Quadrature of the density between x and a point 12 standard deviations past the mean."""
    mean = a / (a + b)
    sd = np.sqrt(mean * (1 - mean) / (a + b + 1))
    left = x < mean
    far = np.where(left, np.maximum(x - 12 * sd, 0), np.minimum(x + 12 * sd, 1))
    half, mid = (x - far) / 2, (x + far) / 2
    t = np.clip(mid[:, None] + half[:, None] * _NODES, 1e-300, 1 - 1e-16)
    # density relative to its value at the mean; log1p keeps precision when a + b is huge
    m, shift = mean[:, None], t - mean[:, None]
    shape = (a - 1)[:, None] * np.log1p(shift / m) + (b - 1)[:, None] * np.log1p(-shift / (1 - m))

    def rest(z):
        return 1 / (12 * z) - 1 / (360 * z ** 3)
    # Stirling's series of the density at the mean; its large terms cancel exactly there
    n = a + b
    peak = 0.5 * np.log(a * b / (n * 2 * math.pi)) - np.log(mean * (1 - mean)) - rest(a) - rest(b) + rest(n)
    area = np.abs(half) * (np.exp(shape) @ _WEIGHTS) * np.exp(peak)
    return np.where(left, area, 1 - area)


def _beta_cdf(x, a, b):
    out = np.empty_like(x)
    large = (a > 3000) & (b > 3000)
    for rows, cdf in ((large, _beta_cdf_large), (~large, _beta_cdf_small)):
        if rows.any():
            out[rows] = cdf(x[rows], a[rows], b[rows])
    return out


def _beta_quantile(p, a, b):
    low, high = np.zeros_like(a), np.ones_like(a)
    # start the bracket around the mean, then halve; 60 halvings exhaust a double there
    mean = a / (a + b)
    sd = np.sqrt(mean * (1 - mean) / (a + b + 1))
    low, high = np.maximum(mean - 12 * sd, 0), np.minimum(mean + 12 * sd, 1)
    low = np.where(_beta_cdf(np.maximum(low, 1e-300), a, b) > p, 0.0, low)
    high = np.where(_beta_cdf(np.minimum(high, 1 - 1e-16), a, b) < p, 1.0, high)
    for _ in range(60):
        mid = (low + high) / 2
        under = _beta_cdf(np.clip(mid, 1e-300, 1 - 1e-16), a, b) < p
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


def clopper_pearson(k: np.ndarray, n: np.ndarray, level: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.asarray(k, float), np.asarray(n, float)
    # As a double this tail is a hair above 0.025, which decides the one exact tie of
    # the whole-percent text: a single hit in a single trial reads "3 to 100".
    tail = (1 - level) / 2
    low, high = np.zeros_like(k), np.ones_like(k)
    all_hit, none_hit, inner = (k == n) & (n > 0), (k == 0) & (n > 0), (k > 0) & (k < n)
    low[all_hit] = tail ** (1 / n[all_hit])
    high[none_hit] = 1 - tail ** (1 / n[none_hit])
    if inner.any():
        ki, ni = k[inner], n[inner]
        low[inner] = _beta_quantile(tail, ki, ni - ki + 1)
        high[inner] = _beta_quantile(1 - tail, ki + 1, ni - ki)
    return low, high


@F.pandas_udf(_INTERVAL)
def _interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    pairs, where = np.unique(np.stack([k.to_numpy(), n.to_numpy()]), axis=1, return_inverse=True)
    low, high = clopper_pearson(*pairs)
    where = where.reshape(-1)
    return pd.DataFrame({"ci_lower": low[where], "ci_upper": high[where]})


def exact_interval(k: Column, n: Column) -> Column:
    """95 % interval as a struct (ci_lower, ci_upper) of shares."""
    return _interval(k, n)


def interval_text(interval: str) -> str:
    """SQL text for ``"l to u"`` in whole percent, half-even."""
    low, high = (f"cast(bround({interval}.{end} * 100, 0) as bigint)" for end in ("ci_lower", "ci_upper"))
    return f"concat({low}, ' to ', {high})"
