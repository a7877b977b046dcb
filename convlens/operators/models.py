"""Model fitting and evaluation (inventory I1-I6, H10).

Folds and splits come from a hash of the row key, so they do not depend on
partitioning.  Boosted trees grow for all folds, grid points and feature
subsets together (``boosting``); rows with missing values stay.  Ridge
regression comes from sums: one aggregation of the Gram matrix by fold, a
training side is the total less its fold, a smaller feature set a sub-matrix,
and what is left is a d x d solve.  Any MLlib estimator can be searched too.
"""

from __future__ import annotations

import random
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.functions.common import md5_hex8
from convlens.functions.stats import safe_corr
from convlens.operators.boosting import Ensemble, Ensembles, fit_ensembles
from convlens.operators.prep import apply_minmax, fit_minmax, train_test_split
from convlens.session import cut_lineage

DEFAULT_GBT_GRID = {"maxIter": [20, 60, 120], "maxDepth": [5, 10, 20]}


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip").transform(df)


def incomplete(df: DataFrame, features: list[str]) -> DataFrame:
    """Number of rows that ``assemble`` leaves out, because a feature is null or NaN."""
    missing = F.lit(False)
    for f in features:
        missing = missing | F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
    return df.agg(F.count(F.when(missing, 1)).alias("n_dropped"))


def fold_column(key, k: int, seed: int = 42):
    """Deterministic fold id in [0, k) from md5 of the key."""
    return (F.conv(md5_hex8(key, f"fold{seed}"), 16, 10).cast("bigint") % F.lit(k)).cast("int")


def _mae():
    from pyspark.ml.evaluation import RegressionEvaluator

    return RegressionEvaluator(metricName="mae", labelCol="label", predictionCol="prediction")


def _prep(df: DataFrame, features: list[str], label: str, key=None, folds: int | None = None, seed: int = 42) -> DataFrame:
    d = assemble(df, features).withColumn("label", F.col(label).cast("double"))
    if folds:
        # without a key, hash the row's values (deterministic, unlike row ids)
        k = key if key is not None else F.to_json(F.struct(*[F.col(c) for c in [*features, label]]))
        d = d.withColumn("fold", fold_column(k, folds, seed))
    return d


class BoostedModel:
    """Boosted trees (see ``boosting``) with the transform of a fitted model: a column ``prediction`` for every row."""

    def __init__(self, ensembles: Ensembles, pick: tuple[int, int]):
        self.ensembles, self.pick = ensembles, pick

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.ensembles.predict(df, [self.pick], df.columns)
        return out.withColumn("prediction", F.col("predictions")[0]).drop("predictions")


def _fold(df: DataFrame, features: list[str], label: str, key, folds: int, seed: int):
    # without a key, hash the row's values (deterministic, unlike row ids)
    k = key if key is not None else F.to_json(F.struct(*[F.col(c) for c in [*features, label]]))
    return fold_column(k, folds, seed)


def _params(rounds: int, depth: int) -> str:
    return f"maxDepth={depth}, maxIter={rounds}"


def boosted_search(df: DataFrame, features: list[str], label: str, maps: list[tuple[int, int]], folds: int, key=None, seed: int = 42):
    """Every ``(rounds, depth)`` of ``maps`` by the mean absolute error over the folds; all folds, and the refits on all rows,
    grow together.  ``(best model, table(params, mae, n_dropped))``; only rows without a label are dropped."""
    depths = sorted({d for _, d in maps})
    most = {d: max(r for r, x in maps if x == d) for d in depths}
    every = tuple(range(len(features)))
    plans = [Ensemble(every, d, most[d], f) for d in depths for f in [*range(folds), -1]]
    fitted = fit_ensembles(df, features, label, plans, _fold(df, features, label, key, folds, seed), tuple(sorted({r for r, _ in maps})))
    dropped = df.where(F.col(label).isNull() | F.isnan(F.col(label).cast("double"))).count()
    rows, best = _scored(maps, depths, folds, fitted.errors, 0)
    table = df.sparkSession.createDataFrame([(_params(*m), e, dropped) for m, e in rows], "params string, mae double, n_dropped long")
    return BoostedModel(fitted, best), table


def _scored(maps, depths, folds: int, errors, first: int) -> tuple[list[tuple[tuple[int, int], float]], tuple[int, int]]:
    """Mean error of every map, and the refitted ensemble and rounds of the best (the first of equals)."""
    rows = []
    for rounds, depth in maps:
        at = first + depths.index(depth) * (folds + 1)
        known = [errors[at + f][rounds] for f in range(folds) if rounds in errors[at + f]]
        rows.append(((rounds, depth), sum(known) / len(known) if known else float("nan")))
    (rounds, depth), _ = min(rows, key=lambda r: (r[1] != r[1], r[1]))
    return rows, (first + depths.index(depth) * (folds + 1) + folds, rounds)


def grid_search(
    df: DataFrame,
    features: list[str],
    label: str,
    estimator=None,
    grid: dict | None = None,
    folds: int = 5,
    key=None,
    seed: int = 42,
    parallelism: int = 4,
    param_maps=None,
):
    """K-fold grid search by MAE; the best map is refit on all rows.

    Without an estimator: boosted trees over ``maxIter`` and ``maxDepth``.
    With one: any MLlib estimator, ``grid`` or ``param_maps`` over its parameters.

    Returns ``(best_model, table(params STRING, mae DOUBLE, n_dropped BIGINT))``.
    """
    if estimator is None:
        grid = grid or DEFAULT_GBT_GRID
        return boosted_search(df, features, label, list(product(grid["maxIter"], grid["maxDepth"])), folds, key, seed)
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    if param_maps is None:
        b = ParamGridBuilder()
        for name, values in (grid or {}).items():
            b = b.addGrid(estimator.getParam(name), values)
        param_maps = b.build()
    # the prepared rows are read once per fold and map: keep them cached for the search
    data = _prep(df, features, label, key, folds, seed).select("features", "label", "fold").cache()
    cv = CrossValidator(
        estimator=estimator, estimatorParamMaps=param_maps, evaluator=_mae(), numFolds=folds, foldCol="fold", parallelism=parallelism, seed=seed
    )
    model = cv.fit(data)
    data.unpersist()
    dropped = incomplete(df, features).first()[0]
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name)), float(metric), dropped)
        for m, metric in zip(param_maps, model.avgMetrics)
    ]
    table = df.sparkSession.createDataFrame(rows, "params string, mae double, n_dropped long")
    return model.bestModel, table


def random_search(df, features, label, space: dict, n_iter: int = 5, folds: int = 3, seed: int = 42, key=None):
    """``n_iter`` maps of boosted trees drawn without replacement from ``space`` (seeded), k-fold by MAE."""
    combos = list(product(space["maxIter"], space["maxDepth"]))
    chosen = random.Random(seed).sample(combos, min(n_iter, len(combos)))
    return boosted_search(df, features, label, chosen, folds, key, seed)


def gbt_default(df: DataFrame, features: list[str], label: str, rounds: int = 100, depth: int = 6) -> BoostedModel:
    """Boosted trees with default parameters."""
    return BoostedModel(fit_ensembles(df, features, label, [Ensemble(tuple(range(len(features))), depth, rounds)]), (0, rounds))


def ridge_mllib(df: DataFrame, features: list[str], label: str, alpha: float = 1.0):
    """I4 on MLlib: squared loss + ``alpha * ||w||^2`` (intercept not penalised).

    MLlib's objective is scaled by 1/(2n) and its penalty by the label's
    standard deviation, hence ``regParam = alpha * stddev_samp(y) / n``.
    """
    from pyspark.ml.regression import LinearRegression

    st = df.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(label).alias("sd")).first()
    reg = alpha * float(st["sd"] or 0.0) / max(int(st["n"]), 1)
    lr = LinearRegression(
        labelCol="label", featuresCol="features", elasticNetParam=0.0, regParam=reg, standardization=False, solver="l-bfgs", maxIter=1000, tol=1e-12
    )
    return lr.fit(_prep(df, features, label))


def gram(df: DataFrame, features: list[str], label: str, fold=None) -> DataFrame:
    """``fold, i, j, s``: by fold the sums of products of ``1, features, label`` (positions from 0, i <= j) over complete rows.

    One pass; partial sums per task.
    """
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in [*features, label]]]
    # taken once: of the rows, not inside every product
    flat = df.select((fold if fold is not None else F.lit(0)).cast("int").alias("fold"), *[c.alias(f"c{k}") for k, c in enumerate(cols)])
    flat = flat.dropna(subset=[f"c{k}" for k in range(len(cols))])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = flat.groupBy("fold").agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"s{i}_{j}").alias("s")) for i, j in pairs])
    return sums.select("fold", F.explode(rows).alias("e")).select("fold", "e.i", "e.j", "e.s")


def gram_by_fold(df: DataFrame, features: list[str], label: str, fold=None) -> dict:
    """``gram`` as one symmetric matrix per fold."""
    import numpy as np

    d, out = len(features) + 2, {}
    for r in gram(df, features, label, fold).collect():
        m = out.setdefault(r["fold"], np.zeros((d, d)))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    return out


def ridge_solve(m, alpha: float, keep: list[int] | None = None):
    """``(intercept, weights)`` of ``(Xc'Xc + alpha I) w = Xc'yc`` from a Gram matrix; ``keep``: positions of the features used."""
    import numpy as np

    at = [k + 1 for k in (keep if keep is not None else range(len(m) - 2))]
    n, mean, y = m[0, 0], m[0, at] / max(m[0, 0], 1.0), m[0, -1] / max(m[0, 0], 1.0)
    cov = m[np.ix_(at, at)] - n * np.outer(mean, mean)
    w = np.linalg.solve(cov + alpha * np.eye(len(at)), m[at, -1] - n * mean * y)
    return float(y - mean @ w), w


def ridge_fit(df: DataFrame, features: list[str], label: str, alpha: float = 1.0) -> DataFrame:
    """I4 exact: ``(term, coefficient)`` rows, 'intercept' first."""
    found = gram_by_fold(df, features, label)
    if not found:
        raise ValueError("no complete row")
    b, w = ridge_solve(found[0], alpha)
    rows = [("intercept", b)] + [(f, float(c)) for f, c in zip(features, w)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def linear(features: list[str], b: float, w):
    """The prediction of a linear model as a column; null where a feature is."""
    terms = [F.lit(float(b)), *[F.lit(float(c)) * F.col(f).cast("double") for f, c in zip(features, w)]]
    # added in pairs, so that long sums don't nest deeply
    while len(terms) > 1:
        terms = [sum(terms[k + 1 : k + 2], terms[k]) for k in range(0, len(terms), 2)]
    return terms[0]


def ridge_cv(df: DataFrame, features: list[str], label: str, alphas=(1.0,), folds: int = 5, key=None, seed: int = 42) -> DataFrame:
    """I5 for ridge: ``alpha, fold, n, mae`` of every fold's rows under the model of the others.

    All fits come from one aggregation (a training side is the total less its
    fold), all scores from a second pass.  Rows with a missing value take no part.
    """
    fold = _fold(df, features, label, key, folds, seed)
    sums = gram_by_fold(df, features, label, fold)
    total = sum(sums.values())
    scored = []
    for alpha in alphas:
        for f in sorted(sums):
            if (total - sums[f])[0, 0] > 0:
                b, w = ridge_solve(total - sums[f], alpha)
                error = F.abs(linear(features, b, w) - F.col(label).cast("double"))
                scored.append(F.when(F.col("__fold") == f, F.struct(F.lit(float(alpha)).alias("alpha"), error.alias("e"))))
    rows = df.dropna(subset=[*features, label]).withColumn("__fold", fold)
    each = rows.select("__fold", F.explode(F.filter(F.array(*scored), lambda x: x.isNotNull())).alias("s"))
    return each.groupBy("s.alpha", F.col("__fold").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.avg("s.e").alias("mae"))


def ridge_1d(df: DataFrame, x: str, y: str, alpha: float = 1.0) -> DataFrame:
    """I4 closed form for one feature as a single aggregation (SQL-checkable)."""
    agg = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        (F.covar_pop(x, y) * F.count(F.lit(1))).alias("sxy"),
        (F.var_pop(x) * F.count(F.lit(1))).alias("sxx"),
    )
    w = F.col("sxy") / (F.col("sxx") + F.lit(alpha))
    return agg.select(w.alias("coefficient"), (F.col("my") - w * F.col("mx")).alias("intercept"))


def cv_score(df: DataFrame, features: list[str], label: str, estimator, folds: int = 5, key=None, seed: int = 42) -> float:
    """Mean MAE over k hash folds for one fixed model."""
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    data = _prep(df, features, label, key, folds, seed).select("features", "label", "fold").cache()
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=ParamGridBuilder().build(), evaluator=_mae(), numFolds=folds, foldCol="fold")
    score = float(cv.fit(data).avgMetrics[0])
    data.unpersist()
    return score


def predict_evaluate(model, df: DataFrame, features: list[str], label: str) -> DataFrame:
    """``(n, n_dropped, r, mae)`` of a fitted model on ``df``; rows that an MLlib model can't predict, because a feature is
    null, are counted.  Boosted trees predict every row."""
    if isinstance(model, BoostedModel):
        pred = model.transform(df.withColumn("label", F.col(label).cast("double")).where(F.col("label").isNotNull()))
        missing = F.lit(0).cast("long")
    else:
        pred = model.transform(_prep(df, features, label))
        missing = incomplete(df, features).scalar()
    return pred.agg(
        F.count(F.lit(1)).alias("n"),
        missing.alias("n_dropped"),
        safe_corr("prediction", "label").alias("r"),
        F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("mae"),
    )


def ablation(
    df: DataFrame,
    features: list[str],
    label: str,
    drop_order: list[str],
    key,
    test_size: float = 0.5,
    seed: int = 42,
    grid: dict | None = None,
    folds: int = 5,
    alpha: float = 1.0,
) -> DataFrame:
    """Round r drops the first r columns of ``drop_order``; each round fits boosted trees (grid search) and ridge on the
    training side, scaled there, and scores both on the test side.  Same split every round.

    The trees of all rounds, folds and grid points grow together, and with them
    the refits; the ridge fits are sub-matrices of one Gram matrix; one pass
    over the test side scores all rounds.

    Returns ``(round, dropped ARRAY, n_features, gbt_r, gbt_mae, ridge_r, ridge_mae, n_dropped)``; ``n_dropped`` counts the
    test rows that ridge can't predict because a feature is null.
    """
    spark = df.sparkSession
    train, test = train_test_split(df, key, test_size=test_size, seed=seed)
    params = fit_minmax(train, features)
    # written once: every round reads the scaled columns many times
    train = cut_lineage(apply_minmax(train, params, features))
    test = cut_lineage(apply_minmax(test, params, features).where(F.col(label).isNotNull()))
    grid = grid or DEFAULT_GBT_GRID
    maps, depths = list(product(grid["maxIter"], grid["maxDepth"])), sorted(set(grid["maxDepth"]))
    left = [[k for k, c in enumerate(features) if c not in drop_order[:r]] for r in range(len(drop_order) + 1)]
    left = [x for x in left if x]
    plans = [Ensemble(tuple(x), d, max(grid["maxIter"]), f) for x in left for d in depths for f in [*range(folds), -1]]
    fitted = fit_ensembles(train, features, label, plans, _fold(train, features, label, key, folds, seed), tuple(sorted(set(grid["maxIter"]))))
    per = len(depths) * (folds + 1)
    picks = [_scored(maps, depths, folds, fitted.errors, r * per)[1] for r in range(len(left))]
    sums = gram_by_fold(train, features, label)
    if not sums:
        raise ValueError("no complete training row")
    named = test.withColumn("__y", F.col(label).cast("double"))
    ridge = []
    for x in left:
        b, w = ridge_solve(sums[0], alpha, x)
        ridge.append(linear([features[k] for k in x], b, w))
    # written, so that the optimizer doesn't infer constraints from the sums for every column renamed above them
    both = fitted.predict(cut_lineage(named.withColumn("__ridge", F.array(*ridge))), picks, ["__y", "__ridge"])
    rounds = both.select("__y", F.posexplode(F.arrays_zip(F.col("predictions").alias("g"), F.col("__ridge").alias("l"))).alias("round", "p"))
    scores = rounds.groupBy("round").agg(
        safe_corr("p.g", "__y").alias("gbt_r"),
        F.avg(F.abs(F.col("p.g") - F.col("__y"))).alias("gbt_mae"),
        safe_corr("p.l", "__y").alias("ridge_r"),
        F.avg(F.abs(F.col("p.l") - F.col("__y"))).alias("ridge_mae"),
        F.count(F.when(F.col("p.l").isNull(), 1)).alias("n_dropped"),
    )
    names = spark.createDataFrame([(r, list(drop_order[:r]), len(x)) for r, x in enumerate(left)], "round int, dropped array<string>, n_features int")
    return names.join(scores, "round", "left")
