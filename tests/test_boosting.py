"""Boosted trees against a plain recursive grower; ridge from fold sums against refitting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlens.operators import boosting as B
from convlens.operators import models as M

NAMES = ["a", "b", "c", "d"]


def rows():
    rnd = random.Random(3)
    out = []
    for i in range(90):
        a, b, c, d = rnd.gauss(0, 1), float(rnd.randint(0, 4)), rnd.gauss(5, 2), 7.0
        y = 2 * a + (b > 2) * 3 + rnd.gauss(0, 0.2)
        out.append((i, i % 3, y, a if i % 7 else None, b if i % 11 else math.nan, c, d))
    return out + [(90, 0, None, 1.0, 1.0, 1.0, 1.0)]


def frame(spark, data):
    return spark.createDataFrame(data, "id long, f int, y double, a double, b double, c double, d double")


def plain_ensemble(data, plan, base, unit):
    """Predictions and trees by recursion over lists of rows."""
    xs = [[None if v is None or math.isnan(v) else v for v in r[3:]] for r in data]
    ys, fold = [r[2] for r in data], [r[1] for r in data]
    pred, errors = [base] * len(data), {}

    def grow(members, grads, depth):
        g, n = sum(grads[k] for k in members), len(members)
        best = None
        score = lambda s, c: (s * unit) ** 2 / (c + B.LAMBDA)
        if depth < plan.depth:
            for j in plan.features:
                for cut in sorted({xs[k][j] for k in members if xs[k][j] is not None}):
                    for missing_left in (False, True):
                        left = [k for k in members if (missing_left if xs[k][j] is None else xs[k][j] <= cut)]
                        if left and len(left) < n:
                            lg = sum(grads[k] for k in left)
                            gain = score(lg, len(left)) + score(g - lg, n - len(left)) - score(g, n)
                            if best is None or gain > best[0]:
                                best = (gain, j, cut, missing_left, left)
        if best is None or best[0] <= B.LEAST_GAIN:
            return -B.RATE * (g * unit) / (n + B.LAMBDA)
        _, j, cut, missing_left, left = best
        right = [k for k in members if k not in set(left)]
        return (j, cut, missing_left, grow(left, grads, depth + 1), grow(right, grads, depth + 1))

    def value(tree, x):
        while isinstance(tree, tuple):
            j, cut, missing_left, low, high = tree
            tree = low if (missing_left if x[j] is None else x[j] <= cut) else high
        return tree

    mine = [k for k in range(len(data)) if fold[k] != plan.fold]
    for t in range(1, plan.rounds + 1):
        grads = [round((p - y) / unit) for p, y in zip(pred, ys)]
        tree = grow(mine, grads, 0)
        pred = [p + value(tree, x) for p, x in zip(pred, xs)]
        out = [abs(pred[k] - ys[k]) for k in range(len(data)) if fold[k] == plan.fold]
        errors[t] = sum(out) / len(out) if out else None
    return pred, errors


@pytest.mark.parametrize("broadcast", [1 << 20, 0])
def test_ensembles_equal_a_plain_grower(spark, broadcast):
    data = rows()
    plans = [B.Ensemble((0, 1, 2, 3), 3, 4, f) for f in (0, 1, -1)] + [B.Ensemble((1, 2), 6, 3, -1)]
    df = frame(spark, data).repartition(3)
    fitted = B.fit_ensembles(df, NAMES, "y", plans, F.col("f"), (2, 4), broadcast=broadcast)
    known = data[:-1]
    low, high = min(r[2] for r in known), max(r[2] for r in known)
    unit = (high - low) / B.FIXED
    got = {r.id: r.predictions for r in fitted.predict(df, [(k, p.rounds) for k, p in enumerate(plans)], ["id"]).collect()}
    assert len(got) == len(data)
    for k, plan in enumerate(plans):
        pred, errors = plain_ensemble(known, plan, fitted.base[k], unit)
        assert [got[r[0]][k] for r in known] == pytest.approx(pred, abs=1e-7)
        train = [r[2] for r in known if r[1] != plan.fold]
        assert fitted.base[k] == pytest.approx(sum(train) / len(train), abs=1e-8)
        if plan.fold >= 0:
            assert fitted.errors[k] == pytest.approx({t: errors[t] for t in (2, 4)}, abs=1e-7)


def test_both_ways_of_running_grow_the_same_trees(spark):
    data = rows()
    plans = [B.Ensemble((0, 1, 2, 3), 5, 3, f) for f in (0, 1, 2, -1)]
    a = B.fit_ensembles(frame(spark, data), NAMES, "y", plans, F.col("f"))
    b = B.fit_ensembles(frame(spark, data).repartition(5), NAMES, "y", plans, F.col("f"), broadcast=0)
    assert a.trees == b.trees and a.base == b.base


def test_bins_hold_every_value_or_quantiles(spark):
    df = spark.createDataFrame([(float(k % 5), float(k), None) for k in range(1000)], "a double, b double, c double")
    a, b, c = B.bin_cuts(df, ["a", "b", "c"], max_bins=16)
    assert list(a) == [0, 1, 2, 3, 4] and len(b) == 16 and b[0] <= 1 and list(c) == [0]
    assert all(abs(x - 1000 * k / 16) < 20 for k, x in enumerate(b))


def test_degenerate_labels_and_columns(spark):
    same = frame(spark, [(i, 0, 2.0, None, 1.0, float(i), 0.0) for i in range(5)])
    fitted = B.fit_ensembles(same, NAMES, "y", [B.Ensemble((0, 1, 2, 3), 3, 2)])
    assert {round(r.predictions[0], 9) for r in fitted.predict(same, [(0, 2)], ["id"]).collect()} == {2.0}
    with pytest.raises(ValueError, match="label"):
        B.fit_ensembles(frame(spark, rows()[-1:]), NAMES, "y", [B.Ensemble((0,), 1, 1)])


def test_searches_take_prefixes_of_one_ensemble(spark):
    df = frame(spark, rows())
    model, table = M.grid_search(df, NAMES, "y", grid={"maxIter": [2, 5], "maxDepth": [1, 3]}, folds=3, key=F.col("id"))
    got = {r.params: r.mae for r in table.collect()}
    assert set(got) == {f"maxDepth={d}, maxIter={n}" for d in (1, 3) for n in (2, 5)}
    one, single = M.grid_search(df, NAMES, "y", grid={"maxIter": [2], "maxDepth": [3]}, folds=3, key=F.col("id"))
    assert single.first().mae == pytest.approx(got["maxDepth=3, maxIter=2"], abs=1e-12) and single.first().n_dropped == 1
    ensemble, rounds = model.pick
    assert min(got, key=got.get).endswith(f"maxIter={rounds}") and ensemble in (3, 7)  # the refits on all rows
    result = M.predict_evaluate(model, df, NAMES, "y").first()
    assert result.n == 90 and result.n_dropped == 0 and result.mae < 1.0


def test_ablation_runs_every_round(spark):
    rnd = random.Random(5)
    data = [(i, rnd.random(), rnd.random(), rnd.random()) for i in range(120)]
    df = spark.createDataFrame([(i, a, b, c if i % 9 else None, 3 * a + b) for i, a, b, c in data], "id long, a double, b double, c double, y double")
    got = M.ablation(df, ["a", "b", "c"], "y", ["c", "b"], F.col("id"), grid={"maxIter": [3, 9], "maxDepth": [2, 4]}, folds=3).orderBy("round").collect()
    assert [(r.round, r.dropped, r.n_features) for r in got] == [(0, [], 3), (1, ["c"], 2), (2, ["c", "b"], 1)]
    assert all(0.5 < r.gbt_r <= 1 and r.gbt_mae < 0.8 for r in got)
    assert got[1].ridge_mae < got[2].ridge_mae and got[0].n_dropped > 0 and got[1].n_dropped == 0


def test_ridge_from_fold_sums_equals_refitting(spark):
    rnd = random.Random(8)
    data = [(i, rnd.gauss(0, 1), rnd.gauss(4, 2), rnd.gauss(0, 1)) for i in range(80)] + [(80, None, 1.0, 1.0)]
    df = spark.createDataFrame([(i, a, b, None if a is None else a - b + e) for i, a, b, e in data], "id long, a double, b double, y double")
    got = {(r.alpha, r.fold): (r.n, r.mae) for r in M.ridge_cv(df, ["a", "b"], "y", (0.5, 20.0), 4, F.col("id")).collect()}
    table = df.dropna().withColumn("fold", M.fold_column(F.col("id"), 4)).toPandas()
    for alpha in (0.5, 20.0):
        for f in range(4):
            train, test = table[table.fold != f], table[table.fold == f]
            x, y = train[["a", "b"]].to_numpy(), train.y.to_numpy()
            w = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + alpha * np.eye(2), (x - x.mean(0)).T @ (y - y.mean()))
            p = y.mean() + (test[["a", "b"]].to_numpy() - x.mean(0)) @ w
            assert got[alpha, f] == (len(test), pytest.approx(np.abs(p - test.y).mean(), abs=1e-9))
    sums = M.gram_by_fold(df, ["a", "b"], "y")[0]
    b, w = M.ridge_solve(sums, 1.0, [1])
    only = {r.term: r.coefficient for r in M.ridge_fit(df.dropna(), ["b"], "y").collect()}
    assert (b, w[0]) == (pytest.approx(only["intercept"]), pytest.approx(only["b"]))


def test_trees_stay_off_the_driver_and_predict_alike(spark, monkeypatch):
    from convlens.operators import boosting as G

    df = spark.range(400).selectExpr("id", "cast(id % 37 as double) as a", "if(id % 11 = 0, null, cast(id % 23 as double)) as b", "cast((id * id) % 101 as double) as y")
    plans = [G.Ensemble((0, 1), 8, 12), G.Ensemble((1,), 3, 7)]
    fitted = G.fit_ensembles(df, ["a", "b"], "y", plans)
    assert not isinstance(fitted.grown, list)  # written by the tasks
    pick = [(0, 12), (1, 5), (0, 4)]
    near = {r["id"]: r["predictions"] for r in fitted.predict(df, pick, ["id"]).collect()}
    monkeypatch.setattr(G, "BROADCAST", 4000)  # several shares of the rows
    far = {r["id"]: r["predictions"] for r in fitted.predict(df, pick, ["id"], nodes=10).collect()}
    assert near == far and len(far) == 400


def test_cells_added_in_place_equal_sorted_ones():
    import numpy as np

    from convlens.operators import boosting as G

    rng = np.random.default_rng(1)
    bins, node = rng.integers(-1, 9, (3000, 4)).astype(np.int16), rng.integers(5, 9, 3000)
    features, grad = np.array([0, 2, 3]), rng.integers(-(1 << 30), 1 << 30, 3000)
    near = G.cell_sums(bins, node, grad, features)
    far = G.cell_sums(bins, node, grad * (1 << 12), features)  # too large to be exact in doubles: sorted
    assert all((a == b).all() for a, b in zip(near[:3], far[:3])) and (near[3] * (1 << 12) == far[3]).all() and (near[4] == far[4]).all()
