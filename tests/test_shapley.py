"""Exact attributions against the definition over orderings, and their axioms."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from convlens.operators import explain as X

NAMES = ["a", "b", "c", "d"]


def value(a, b, c, d):
    return a * b + (c or 0.0) ** 2 + (5.0 if a > b else 0.0)


def predict(df):
    a, b, c = F.col("a"), F.col("b"), F.coalesce("c", F.lit(0.0))
    return df.withColumn("prediction", a * b + c * c + F.when(a > b, 5.0).otherwise(0.0))


def rows(n, seed):
    rnd = random.Random(seed)
    out = [(k, *[float(rnd.randint(0, 3)) for _ in range(4)]) for k in range(n)]
    return [(k, a, b, None if k % 4 == 3 else c, d) for k, a, b, c, d in out]


def test_equals_the_mean_over_all_orderings(spark):
    ex, bg = rows(5, 1), rows(9, 2)
    schema = "id long, a double, b double, c double, d double"
    asked = []

    def watched(df):
        asked.append(df)
        return predict(df)

    got = {(r.id, r.feature): r.attribution for r in X.shapley_attributions(spark.createDataFrame(ex, schema), spark.createDataFrame(bg, schema), NAMES, watched).collect()}
    for i, *x in ex:
        want = dict.fromkeys(NAMES, 0.0)
        for order in itertools.permutations(range(4)):
            for _, *z in bg:
                now = list(z)
                before = value(*now)
                for j in order:
                    now[j] = x[j]
                    want[NAMES[j]] += (value(*now) - before) / 24 / len(bg)
                    before = value(*now)
        assert {f: got[i, f] for f in NAMES} == pytest.approx(want, abs=1e-9)
        assert got[i, "d"] == pytest.approx(0)  # what no prediction uses has none
        assert sum(want.values()) == pytest.approx(value(*x) - sum(value(*z) for _, *z in bg) / len(bg))
    vectors = [tuple(r) for r in asked[0].select(*NAMES).collect()]
    assert len(vectors) == len(set(vectors))


def test_symmetric_features_share_equally(spark):
    schema = "id long, a double, b double"
    ex = spark.createDataFrame([(0, 2.0, 2.0)], schema)
    bg = spark.createDataFrame([(0, 1.0, 1.0), (1, 0.0, 0.0)], schema)
    got = {r.feature: r.attribution for r in X.shapley_attributions(ex, bg, ["a", "b"], lambda df: df.withColumn("prediction", F.col("a") * F.col("b"))).collect()}
    assert got["a"] == pytest.approx(got["b"]) and got["a"] + got["b"] == pytest.approx(4 - 0.5)


def test_too_many_features(spark):
    df = spark.createDataFrame([(0, 1.0)], "id long, a double")
    with pytest.raises(ValueError, match="coalitions"):
        X.shapley_attributions(df, df, ["a"] * 13, predict)
