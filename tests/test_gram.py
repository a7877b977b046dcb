"""Blocked correlations against the expressions and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlens.operators import gram
from convlens.operators import prep as H


def data(rows, cols, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, cols)) * rng.uniform(0.1, 1000, cols) + rng.uniform(-1e4, 1e4, cols)
    x[:, 1] += 3 * x[:, 0]
    x[:, 2] = 7.5
    x[rng.random((rows, cols)) < 0.1] = np.nan
    x[:, 3] = np.where(np.isnan(x[:, 4]), x[:, 3], np.nan)  # never there together
    return x


def frame(spark, x):
    names = [f"v{k}" for k in range(x.shape[1])]
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names


def test_equals_the_expressions_on_twenty_columns(spark):
    x = data(300, 20)
    df, names = frame(spark, x)
    df = df.repartition(3)
    want = {(r.a, r.b): r.corr for r in H.correlation_matrix(df, names).collect()}
    got = {(r.a, r.b): r.corr for r in gram.correlations(df, names, block=6).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        if "v2" in k:  # the expressions' rounding may leave a constant column a correlation
            assert got[k] is None
            continue
        assert got[k] == (None if v is None else pytest.approx(v, abs=1e-9)), k
    assert got["v2", "v2"] is None and got["v3", "v4"] is None and got["v0", "v0"] == 1.0
    want = {r.feature: (r.r, r.f_score, r["rank"]) for r in H.f_regression(df, names[1:], "v0").collect()}
    far = gram.label_correlations(df, names[1:], "v0")
    for r in far.where("feature <> 'v2'").collect():
        assert r.n == 300 and r.r == (None if want[r.feature][0] is None else pytest.approx(want[r.feature][0], abs=1e-9))


def test_two_thousand_columns(spark):
    x = np.nan_to_num(data(120, 2000, seed=5))
    df, names = frame(spark, x)
    rows = H.correlation_matrix(df, names)
    want = np.corrcoef(x.T)
    picked = rows.where(F.col("a").isin("v0", "v1", "v777", "v1999")).collect()
    assert rows.count() == 2000 * 2000 and len(picked) == 4 * 2000
    for r in picked:
        v = want[int(r.a[1:]), int(r.b[1:])]
        assert (r.corr is None and not np.isfinite(v)) or r.corr == pytest.approx(v, abs=1e-8)
    best = H.select_k_best(df, names[1:], "v0", k=3)
    r = np.abs(want[0, 1:])
    assert best == [names[1:][k] for k in np.argsort(-np.nan_to_num(r))[:3]]


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, b double")
    assert {(r.a, r.b): r.corr for r in gram.correlations(df, ["a", "b"]).collect()} == {("a", "a"): None, ("a", "b"): None, ("b", "a"): None, ("b", "b"): 1.0}
    assert gram.correlations(df.limit(0), ["a", "b"]).count() == 0
