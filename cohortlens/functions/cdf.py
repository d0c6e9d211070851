"""Tail probabilities for test statistics.

Spark computes the statistics; these small numeric helpers turn the one row (or the one row per group)
that a test leaves into p-values inside a vectorised UDF.  Standard series and continued fractions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + num / c
            c = c if abs(c) > _TINY else _TINY
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        for _ in range(100000):
            k += 1.0
            term *= x / k
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1.0 - front * total)
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * h


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    """Normal quantile by bisection refined with Newton steps."""
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    lo, hi = -40.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if norm_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


LARGE_DF = 1e7  # beyond this the limiting distribution is closer than the series


def t_two_sided(t: float, df: float) -> float:
    if df > LARGE_DF:
        return min(1.0, 2.0 * norm_sf(abs(t)))
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def t_ppf(p: float, df: float) -> float:
    """Quantile for p >= 0.5, by bisection."""
    lo, hi = 0.0, 1.0
    while 1.0 - 0.5 * t_two_sided(hi, df) < p:
        hi *= 2.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1.0 - 0.5 * t_two_sided(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def f_sf(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    if d2 > LARGE_DF:
        return chi2_sf(d1 * f, d1)
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def f_ppf(p: float, d1: float, d2: float) -> float:
    lo, hi = 0.0, 1.0
    while f_sf(hi, d1, d2) > 1.0 - p:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f_sf(mid, d1, d2) > 1.0 - p else (lo, mid)
    return (lo + hi) / 2


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(df / 2.0, x / 2.0)


def noncentral_f_sf(f: float, d1: float, d2: float, nc: float) -> float:
    """Poisson mixture of central F tails, summed outwards from the Poisson mode."""
    x = d1 * f / (d1 * f + d2)
    half = nc / 2.0
    if nc > 2000.0 and d2 > 4:  # far tail: two moments of the noncentral F
        mean = d2 * (d1 + nc) / (d1 * (d2 - 2))
        var = 2 * (d2 / d1) ** 2 * ((d1 + nc) ** 2 + (d1 + 2 * nc) * (d2 - 2)) / ((d2 - 2) ** 2 * (d2 - 4))
        return norm_sf((f - mean) / math.sqrt(var))

    def term(j: int) -> float:
        w = -half + (j * math.log(half) if half > 0 else (0.0 if j == 0 else -math.inf)) - math.lgamma(j + 1)
        return 0.0 if w == -math.inf else math.exp(w) * (1.0 - beta_inc(d1 / 2.0 + j, d2 / 2.0, x))

    mode = int(half)
    total = 0.0
    for step in (1, -1):
        j = mode if step == 1 else mode - 1
        while j >= 0:
            t = term(j)
            total += t
            weight_gone = abs(j - mode) > 12 * math.sqrt(half + 1) + 30
            if weight_gone:
                break
            j += step
    return min(1.0, max(0.0, total))


def kolmogorov_sf(x: float) -> float:
    """Limiting distribution of the two-sample Kolmogorov-Smirnov statistic."""
    if x <= 0:
        return 1.0
    if x < 0.3:
        return 1.0
    return min(1.0, max(0.0, 2.0 * sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * x * x) for k in range(1, 101))))


_GL_X, _GL_W = np.polynomial.legendre.leggauss(64)


def _panels(lo: float, hi: float, parts: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.linspace(lo, hi, parts + 1)
    half = np.diff(edges) / 2
    mid = (edges[1:] + edges[:-1]) / 2
    return (mid[:, None] + half[:, None] * _GL_X).ravel(), (half[:, None] * _GL_W).ravel()


_phi = np.vectorize(norm_cdf, otypes=[float])


def studentised_range_sf(q: float, k: int, df: float) -> float:
    """P(range of k normals / pooled s > q) by double quadrature."""
    if q <= 0:
        return 1.0
    z, wz = _panels(-8.0, 8.0, 4)
    pz = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cz = _phi(z)

    def range_cdf(w: float) -> float:
        return float(k * np.sum(wz * pz * np.clip(cz - _phi(z - w), 0, 1) ** (k - 1)))

    if df > 25000:
        return min(1.0, max(0.0, 1.0 - range_cdf(q)))
    spread = 10.0 / math.sqrt(2.0 * df)
    s, ws = _panels(max(1e-6, 1.0 - spread), 1.0 + spread, 1)
    log_density = (
        math.log(2.0) + (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    )
    inner = np.array([range_cdf(q * v) for v in s])
    return min(1.0, max(0.0, 1.0 - float(np.sum(ws * np.exp(log_density) * inner))))


def studentised_range_ppf(p: float, k: int, df: float) -> float:
    lo, hi = 0.0, 8.0
    while studentised_range_sf(hi, k, df) > 1.0 - p:
        hi *= 2.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if studentised_range_sf(mid, k, df) > 1.0 - p else (lo, mid)
    return (lo + hi) / 2


# ---- Spark surface --------------------------------------------------------------------------


def _rowwise(fn, *series: pd.Series) -> pd.Series:
    out = []
    for values in zip(*series):
        try:
            bad = any(v is None or math.isnan(v) for v in values)
            out.append(None if bad else float(fn(*values)))
        except (ValueError, OverflowError, ZeroDivisionError):
            out.append(None)
    return pd.Series(out, dtype="float64")


def _udf1(fn):
    @F.pandas_udf("double")
    def udf(a: pd.Series) -> pd.Series:
        return _rowwise(fn, a)

    return udf


def _udf2(fn):
    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return _rowwise(fn, a, b)

    return udf


def _udf3(fn):
    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _rowwise(fn, a, b, c)

    return udf


def _doubles(*cols) -> list[Column]:
    return [(c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)).cast("double") for c in cols]


def p_t(t, df) -> Column:
    return _udf2(lambda a, b: t_two_sided(a, b) if b > 0 else float("nan"))(*_doubles(t, df))


def p_f(f, d1, d2) -> Column:
    return _udf3(f_sf)(*_doubles(f, d1, d2))


def p_chi2(x, df) -> Column:
    return _udf2(chi2_sf)(*_doubles(x, df))


def p_norm(z) -> Column:
    """Two-sided."""
    return _udf1(lambda a: min(1.0, 2.0 * norm_sf(abs(a))))(*_doubles(z))


def p_kolmogorov(x) -> Column:
    return _udf1(kolmogorov_sf)(*_doubles(x))


def p_tukey(q, k, df) -> Column:
    return _udf3(lambda a, b, c: studentised_range_sf(a, int(b), c))(*_doubles(q, k, df))


def q_tukey(p, k, df) -> Column:
    return _udf3(lambda a, b, c: studentised_range_ppf(a, int(b), c))(*_doubles(p, k, df))


def q_t(p, df) -> Column:
    return _udf2(t_ppf)(*_doubles(p, df))
