"""Distribution tails for p-values (scipy is not available).

Spark SQL has no erf/erfc or incomplete gamma, so tails are computed by
Arrow-batched pandas UDFs over the few result rows of a test (one row per
variable or level) — never over input rows.
"""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_EPS = 1e-15
_TINY = 1e-300


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x) (series / continued fraction)."""
    if x is None or a is None or math.isnan(x) or math.isnan(a) or a <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    log_pre = -x + a * math.log(x) - math.lgamma(a)
    if a > 1e6:  # uniform expansion, error below 1 / a
        lam = x / a
        eta = math.copysign(math.sqrt(max(0.0, 2.0 * (lam - 1.0 - math.log(lam)))), lam - 1.0)
        near = abs(lam - 1.0) < 1e-6
        first = -1.0 / 3.0 if near else 1.0 / (lam - 1.0) - 1.0 / eta
        return min(1.0, max(0.0, 0.5 * math.erfc(eta * math.sqrt(a / 2.0))
                            + math.exp(-0.5 * a * eta * eta) / math.sqrt(2.0 * math.pi * a) * first))
    if x < a + 1.0:  # series for P(a, x)
        term = total = 1.0 / a
        n = a
        while True:  # terms shrink by x / n, which falls below 1
            n += 1.0
            term *= x / n
            total += term
            if abs(term) < abs(total) * _EPS:
                break
        return max(0.0, 1.0 - total * math.exp(log_pre))
    # modified Lentz continued fraction for Q(a, x)
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in itertools.count(1):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(log_pre) * h


def chi2_sf(x: float, dof: float) -> float:
    return gammaincc(dof / 2.0, x / 2.0)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def kolmogorov_sf(d: float, n: float) -> float:
    """Asymptotic P(D > d) with Stephens' small-sample correction."""
    if n <= 0 or d is None or math.isnan(d):
        return float("nan")
    sq = math.sqrt(n)
    lam = (sq + 0.12 + 0.11 / sq) * d
    if lam < 0.3:  # the other form of the theta function: its first term is the whole sum here
        return 1.0 if lam <= 0 else 1.0 - math.sqrt(2.0 * math.pi) / lam * math.exp(-math.pi ** 2 / (8.0 * lam * lam))
    total = 0.0
    for k in itertools.count(1):
        term = 2.0 * (-1) ** (k - 1) * math.exp(-2.0 * k * k * lam * lam)
        total += term
        if abs(term) < 1e-16:
            break
    return min(1.0, max(0.0, total))


def _nan(v):
    return v is None or (isinstance(v, float) and math.isnan(v))


@pandas_udf(DoubleType())
def chi2_pvalue(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([float("nan") if _nan(s) or _nan(d) else chi2_sf(float(s), float(d))
                      for s, d in zip(stat, dof)], dtype="float64")


@pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return pd.Series([float("nan") if _nan(v) else normal_two_sided(float(v)) for v in z],
                     dtype="float64")


# FIXED VALUES: Hart's rational approximation of the normal tail (numerator, denominator; highest power first).
HART_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
HART_BOTTOM = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
# FIXED VALUES: Dallal and Wilkinson's p-value of Lilliefors' statistic, and Stephens' polynomials (constant first) above 0.1.
DALLAL = (-7.01256, 2.78019, 2.99587, -0.122119, 0.974598, 1.67997)
STEPHENS = [(0.302, [1.0]), (0.5, [2.76773, -19.828315, 80.709644, -138.55152, 81.218052]),
            (0.9, [-4.901232, 40.662806, -97.490286, 94.029866, -32.355711]),
            (1.31, [6.198765, -19.558097, 23.186922, -12.234627, 2.423045])]


def _horner(x, coefficients):
    """Polynomial with the highest power first."""
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_cdf_expr(z):
    """Normal CDF of a column as an expression, so that it is compiled with the rest: Hart's approximation to |z| = 7.07,
    a continued fraction beyond; absolute error below 1e-14 (tested). Null gives null."""
    x = F.abs(z)
    near = _horner(x, HART_TOP) / _horner(x, HART_BOTTOM)
    far = F.lit(1.0) / (x + F.lit(1.0) / (x + F.lit(2.0) / (x + F.lit(3.0) / (x + F.lit(4.0) / (x + F.lit(0.65)))))) / F.lit(math.sqrt(2.0 * math.pi))
    tail = F.when(x > 37.0, F.lit(0.0)).otherwise(F.exp(-x * x / 2.0) * F.when(x < 7.07106781186547, near).otherwise(far))
    return F.when(z > 0, F.lit(1.0) - tail).when(z <= 0, tail)


def lilliefors_p(ks, n):
    """p of the Kolmogorov distance ``ks`` between ``n`` >= 5 rows and a normal fitted to them (columns), between 0 and 1."""
    a, shift, b, c, d, e = (F.lit(x) for x in DALLAL)
    k = F.when(n > 100, ks * F.pow(n / 100.0, F.lit(0.49))).otherwise(ks)
    m = F.least(n, F.lit(100.0))
    low = F.exp(a * k * k * (m + shift) + b * k * F.sqrt(m + shift) + c + d / F.sqrt(m) + e / m)
    s = (F.sqrt(n) - 0.01 + 0.85 / F.sqrt(n)) * ks
    high = F.lit(0.0)
    for top, coefficients in reversed(STEPHENS):
        high = F.when(s <= top, _horner(s, coefficients[::-1])).otherwise(high)
    p = F.when(low > 0.1, high).otherwise(low)
    return F.when((n >= 5) & ks.isNotNull(), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def col_chi2_pvalue(stat, dof):
    return chi2_pvalue(F.col(stat) if isinstance(stat, str) else stat,
                       F.col(dof) if isinstance(dof, str) else dof)
