"""Student-t p-values as a column, against the scalar incomplete beta function and published values."""

import math

import pytest
from pyspark.sql import functions as F

from convlens.functions.stats import t_pvalue
from convlens.operators import evaluate as J


def _betacf(a: float, b: float, x: float) -> float:
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 200_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta ``I_x(a, b)``."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1.0 - x)
    front = math.exp(lbeta)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float | None, dof: float | None) -> float | None:
    """Two-sided p-value of a Student-t statistic."""
    if t is None or dof is None or dof <= 0 or (isinstance(t, float) and math.isnan(t)):
        return None
    if math.isinf(t):
        return 0.0
    return betainc_reg(dof / 2.0, 0.5, dof / (dof + t * t))



# t, degrees of freedom, two-sided p of the usual tables
TABLE = [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (2.042, 30, 0.05), (1.984, 100, 0.05), (1.96, 10**8, 0.05), (2.5758, 10**8, 0.01)]


def test_published_values(spark):
    df = spark.createDataFrame([(t, float(n), p) for t, n, p in TABLE], "t double, n double, p double")
    for r in df.select("p", t_pvalue(F.col("t"), F.col("n")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, rel=2e-3)


def test_against_the_scalar_function(spark):
    rows = [(s * t, float(n)) for n in (1, 2, 3, 7, 40, 150, 199, 201, 500, 5000, 60_000) for t in (0.0, 1e-6, 0.01, 0.4, 1.0, 1.3, 2.0, 3.7, 6.5, 9.0, 30.0, 400.0) for s in (1, -1)]
    df = spark.createDataFrame(rows, "t double, n double")
    for r in df.select("t", "n", t_pvalue(F.col("t"), F.col("n")).alias("p")).collect():
        want = t_two_sided_p(r.t, r.n)
        assert r.p == pytest.approx(want, rel=1e-6 if r.n > 1000 else 1e-8, abs=1e-13), (r.t, r.n)  # the gamma functions of the scalar one cancel


def test_undefined_and_extreme(spark):
    rows = [(None, 5.0), (1.0, None), (float("nan"), 5.0), (1.0, 0.0), (float("inf"), 5.0), (0.0, 5.0), (1.0, 1e12)]
    got = [r.p for r in spark.createDataFrame(rows, "t double, n double").select(t_pvalue(F.col("t"), F.col("n")).alias("p")).collect()]
    assert got[:4] == [None] * 4 and got[4:6] == [0.0, 1.0] and got[6] == pytest.approx(math.erfc(1 / math.sqrt(2)), rel=1e-9)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.9), (3.0, 6.5), (4.0, 7.0)], "a double, b double")
    out = J.pearson(df, "a", "b")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    r = out.first()
    assert r.p == pytest.approx(t_two_sided_p(r.t, 2.0), rel=1e-9)
