"""Statistics as Spark expressions.

Student-t tail probabilities are columns, without Python.  With
``x = dof / (dof + t^2)`` the two-sided p-value is the regularised incomplete
beta function ``I_x(dof / 2, 1 / 2)``: a fold over its continued fraction
(modified Lentz), or, for many degrees of freedom and a moderate t, where the
fraction converges slowly, a Gauss-Legendre sum of the density's tail.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTION_STEPS = 300
NODES = 96
MANY = 200.0  # degrees of freedom from which the tail is summed, for t^2 < dof / 4
SHIFT = 24


def _log_gamma_ratio(a: Column) -> Column:
    """``ln(gamma(a + 1/2) / gamma(a))``: shifted upwards by the recurrence, then the asymptotic series."""
    z = a + F.lit(float(SHIFT))
    series = 0.5 * F.ln(z) - 1 / (8 * z) + 1 / (192 * F.pow(z, F.lit(3.0))) - 1 / (640 * F.pow(z, F.lit(5.0))) + 17 / (14336 * F.pow(z, F.lit(7.0)))
    steps = F.sequence(F.lit(0), F.lit(SHIFT - 1))
    return F.aggregate(steps, series, lambda s, k: s - F.ln((a + k + 0.5) / (a + k)))


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function."""
    tiny = F.lit(1e-300)
    away = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
    state = "struct<c:double,d:double,h:double>"
    make = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h")).cast(state)
    first = 1 / away(1 - (a + b) * x / (a + 1))

    def half(s, top):
        d = 1 / away(1 + top * s["d"])
        c = away(1 + top / s["c"])
        return make(c, d, s["h"] * c * d)

    def step(s, m):
        m = m.cast("double")
        # a step is two halves; the first one's result is an array of one, so that it is computed once
        even = F.array(half(s, m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))))
        odd = F.transform(even, lambda e: half(e, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))))
        return F.get(odd, 0)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(FRACTION_STEPS)), make(F.lit(1.0), first, first), step)
    return out["h"]


def t_pvalue(t: Column, dof: Column) -> Column:
    """Two-sided p-value of a Student-t statistic; null where t or the degrees of freedom are null, NaN or not positive."""
    import numpy as np

    t, v = F.abs(t.cast("double")), dof.cast("double")
    a, half = v / 2, F.lit(0.5)
    ratio = _log_gamma_ratio(a) - 0.5 * math.log(math.pi)
    x, y = v / (v + t * t), t * t / (v + t * t)
    # x^a (1 - x)^(1/2) / B(a, 1/2)
    front = F.exp(ratio - a * F.log1p(t * t / v)) * F.sqrt(y)
    straight = F.least(front * _fraction(a, half, x) / a, F.lit(1.0))
    mirrored = 1 - front * _fraction(half, a, y) / half
    exact = F.when(x < (a + 1) / (a + 2.5), straight).otherwise(mirrored)
    # the tail of the density, as far as it counts
    reach = 60 / ((v + 1) * t / (v + t * t) + 4)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    points = F.array(*[F.struct(F.lit(float((n + 1) / 2)).alias("n"), F.lit(float(w / 2)).alias("w")) for n, w in zip(nodes, weights)])
    density = lambda s: F.exp(-(v + 1) / 2 * F.log1p(s * s / v))
    tail = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["w"] * density(t + p["n"] * reach)) * reach
    summed = 2 * tail * F.exp(ratio) / F.sqrt(v)
    known = t.isNotNull() & ~F.isnan(t) & (v > 0)
    return F.when(known, F.when(t == float("inf"), 0.0).when(t == 0, 1.0).when((v > MANY) & (t * t < v / 4), summed).otherwise(exact))


def _pairwise(a, b):
    a, b = (F.col(a) if isinstance(a, str) else a), (F.col(b) if isinstance(b, str) else b)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a.cast("double")), F.when(both, b.cast("double"))


def safe_corr(a, b):
    """Pearson r over rows where both are present; null (not an ANSI error) when
    either side is constant or fewer than two rows remain."""
    x, y = _pairwise(a, b)
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def safe_slope(y, x):
    """Least-squares slope of y on x; null when x is constant."""
    xx, yy = _pairwise(x, y)
    return F.try_divide(F.covar_pop(xx, yy), F.nullif(F.var_pop(xx), F.lit(0.0)))


def safe_intercept(y, x):
    xx, yy = _pairwise(x, y)
    return F.avg(yy) - safe_slope(y, x) * F.avg(xx)
