"""Explanations (inventory I7-I11).

Binned additive model (I7-I9)
-----------------------------
A glass-box regressor ``y ~ intercept + sum_f score_f[bin_f] (+ pair terms)``
fitted by cyclic-free backfitting: each pass computes the mean residual of
every ``(feature, bin)`` cell in ONE grouped aggregation over the exploded bin
array (partial aggregation, output bounded by features x bins), shrinks it
by the learning rate and updates the residual row-locally from a literal
score table.  Lineage is cut every few passes with a reliable checkpoint.
Terms are centred to mean 0 (their mean goes into the intercept).

Permutation attributions (I10-I11)
----------------------------------
For each explained row x, background row z and permutation p, the vectors
v_0..v_d switch features from z to x in permutation order; the model scores
all of them in one ``transform`` and the difference f(v_k) - f(v_{k-1})
is the contribution of the k-th switched feature, so contributions of one
(x, z, p) sum exactly to f(x) - f(z).  The explained and background sets are
bounded samples chosen by hash order.
"""

from __future__ import annotations

import math
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlens.functions.common import md5_hex8
from convlens.session import cut_lineage

DEALS = 16  # explained rows meet every background row through an equi-join on a deal number


# ---------------------------------------------------------------- I7-I9 additive model
def bin_edges(df: DataFrame, features: list[str], max_bins: int = 256, method: str = "uniform") -> dict:
    """Bins per feature from one aggregation.

    ``uniform``: ``{f: (lo, hi, bins)}`` equal-width bins from min/max.
    ``quantile``: ``{f: ("quantile", cuts, bins)}`` with up to ``max_bins - 1``
    distinct cut points from approximate quantiles (mergeable sketches, one pass).
    """
    if method == "quantile":
        probs = [i / max_bins for i in range(1, max_bins)]
        row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), F.array(*[F.lit(p) for p in probs]), 10000).alias(f"q_{i}") for i, f in enumerate(features)]).first()
        return {f: ("quantile", sorted({float(v) for v in (row[f"q_{i}"] or [])}), max_bins) for i, f in enumerate(features)}
    row = df.agg(*[F.min(f).alias(f"lo_{i}") for i, f in enumerate(features)], *[F.max(f).alias(f"hi_{i}") for i, f in enumerate(features)]).first()
    return {f: (float(row[f"lo_{i}"] or 0.0), float(row[f"hi_{i}"] or 0.0), max_bins) for i, f in enumerate(features)}


def _bin_expr(f: str, a, b, bins: int):
    """Bin of feature ``f``; ``bins`` (the last slot) holds missing values."""
    if a == "quantile":
        # number of cut points <= x (cuts are few and sorted; JVM-side fold)
        cuts = F.from_json(F.lit(json.dumps(b)), "array<double>")
        x = F.col(f).cast("double")
        raw = F.aggregate(cuts, F.lit(0), lambda acc, c: acc + F.when(x >= c, 1).otherwise(0))
        return F.when(F.col(f).isNull(), F.lit(bins)).otherwise(raw)
    lo, hi = a, b
    width = (hi - lo) / bins if hi > lo else 1.0
    raw = F.floor((F.col(f).cast("double") - F.lit(lo)) / F.lit(width)).cast("int")
    return F.when(F.col(f).isNull(), F.lit(bins)).otherwise(F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1)))


def binned(df: DataFrame, features: list[str], edges: dict, label: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows with ``bins ARRAY<INT>`` (bin ``bins`` = missing value)."""
    cols = [F.array(*[_bin_expr(f, *edges[f]) for f in features]).alias("bins")]
    if label:
        cols.append(F.col(label).cast("double").alias("y"))
    return df.select(*(keep or []), *cols)


def _table(scores):
    """Nested lists of scores as one folded literal."""
    depth = 0
    x = scores
    while isinstance(x, list):
        depth, x = depth + 1, x[0] if x else None
    return F.from_json(F.lit(json.dumps(scores)), "array<" * depth + "double" + ">" * depth)


def _score(table):
    """Sum over features of ``table[f][bins[f]]`` (row-local)."""
    return F.aggregate(
        F.zip_with(F.col("bins"), F.sequence(F.lit(1), F.size("bins")), lambda b, i: F.element_at(F.element_at(table, i), b + 1)),
        F.lit(0.0),
        lambda acc, v: acc + F.coalesce(v, F.lit(0.0)),
    )


def _lookup(scores: list[list[float]]):
    return _score(_table(scores))


class AdditiveModel:
    """Fitted binned additive model (I7) with optional pair terms (I8)."""

    def __init__(self, features, edges, intercept, scores, counts, pairs=None):
        self.features = features
        self.edges = edges
        self.intercept = intercept
        self.scores = scores  # list per feature of per-bin scores (last slot = missing)
        self.counts = counts
        self.pairs = pairs or []  # (i, j, coarse, {(bi, bj): score})

    def predict(self, df: DataFrame, out: str = "prediction", keep: list[str] | None = None) -> DataFrame:
        keep = keep if keep is not None else df.columns
        b = binned(df, self.features, self.edges, keep=keep)
        pred = F.lit(self.intercept) + _lookup(self.scores)
        for i, j, coarse, table in self.pairs:
            key = F.floor(F.col("bins")[i] * coarse / self.edges[self.features[i]][2]) * 1000 + F.floor(F.col("bins")[j] * coarse / self.edges[self.features[j]][2])
            m = F.create_map(*[x for (bi, bj), v in table.items() for x in (F.lit(bi * 1000 + bj), F.lit(float(v)))]) if table else None
            if m is not None:
                pred = pred + F.coalesce(F.element_at(m, key.cast("int")), F.lit(0.0))
        return b.withColumn(out, pred).drop("bins")

    def term_table(self, spark) -> DataFrame:
        """``(term, bin, bin_lo, bin_hi, score, n)`` for every main-effect cell."""
        rows = []
        for f, s, c in zip(self.features, self.scores, self.counts):
            a, e, bins = self.edges[f]
            for b in range(bins + 1):
                if c[b] == 0:
                    continue
                if b == bins:
                    rows.append((f, b, None, None, float(s[b]), int(c[b])))
                elif a == "quantile":
                    lo_v = e[b - 1] if b >= 1 else None
                    hi_v = e[b] if b < len(e) else None
                    rows.append((f, b, lo_v, hi_v, float(s[b]), int(c[b])))
                else:
                    width = (e - a) / bins if e > a else 1.0
                    rows.append((f, b, a + b * width, a + (b + 1) * width, float(s[b]), int(c[b])))
        return spark.createDataFrame(rows, "term string, bin int, bin_lo double, bin_hi double, score double, n long")

    def importance(self, spark) -> DataFrame:
        """``(term, importance)`` = row-weighted mean |score|, descending."""
        t = self.term_table(spark)
        return (
            t.groupBy("term")
            .agg((F.sum(F.abs("score") * F.col("n")) / F.sum("n")).alias("importance"))
            .orderBy(F.desc("importance"), "term")
        )


def fit_additive(
    df: DataFrame,
    features: list[str],
    label: str,
    max_bins: int = 256,
    passes: int = 50,
    learning_rate: float | None = None,
    checkpoint_every: int = 2,
    interactions: int = 0,
    interaction_bins: int = 16,
    edges: dict | None = None,
    binning: str = "uniform",
) -> AdditiveModel:
    """I7 (+ I8 when ``interactions`` > 0): fit the binned additive model.

    All features are updated together each pass (Jacobi backfitting), so the
    default learning rate is ``1 / n_features``.  ``binning``: ``uniform``
    (equal width) or ``quantile`` (approximate quantile cut points).
    """
    d = len(features)
    edges = edges or bin_edges(df, features, max_bins, binning)
    data = binned(df, features, edges, label).where(F.col("y").isNotNull()).withColumn("m", F.array(F.lit(1)))
    models, cur = _fit_bags(data, features, edges, 1, max_bins, passes, learning_rate, checkpoint_every)
    if interactions > 0 and d >= 2:
        left = cut_lineage(cur.select("bins", F.col("r")[0].alias("r")))
        models[0].pairs = _fit_pairs(left, features, edges, interactions, interaction_bins)
    return models[0]


def _fit_bags(data: DataFrame, features, edges, bags: int, max_bins: int, passes: int, learning_rate, checkpoint_every: int):
    """One model per bag over rows ``bins, y, m`` (``m``: array of 0/1 memberships), all bags in one grouped
    aggregation a pass.  Returns the models and the rows with their residuals ``r`` (array by bag)."""
    d = len(features)
    lr = learning_rate if learning_rate is not None else 1.0 / d
    means = data.agg(*[F.try_divide(F.sum(F.col("m")[k] * F.col("y")), F.sum(F.col("m")[k])).alias(f"c{k}") for k in range(bags)]).first()
    intercepts = [float(means[k] or 0.0) for k in range(bags)]
    scores = [[[0.0] * (max_bins + 1) for _ in features] for _ in range(bags)]
    counts = [[[0] * (max_bins + 1) for _ in features] for _ in range(bags)]
    cur = data.withColumn("r", F.transform(_table(intercepts), lambda c: F.col("y") - c))
    if passes > 1 and checkpoint_every:
        cur = cut_lineage(cur)
    for p in range(passes):
        stats = (
            cur.select(F.posexplode("bins").alias("f", "b"), "m", "r")
            .groupBy("f", "b")
            .agg(*[x for k in range(bags) for x in (F.sum(F.col("m")[k] * F.col("r")[k]).alias(f"s{k}"), F.sum(F.col("m")[k]).alias(f"n{k}"))])
            .collect()  # bounded: features x (bins + 1) rows
        )
        delta = [[[0.0] * (max_bins + 1) for _ in features] for _ in range(bags)]
        for row in stats:
            f, b = row["f"], row["b"]
            for k in range(bags):
                if row[f"n{k}"]:
                    delta[k][f][b] = lr * row[f"s{k}"] / row[f"n{k}"]
                    scores[k][f][b] += delta[k][f][b]
                    counts[k][f][b] = row[f"n{k}"]
        moved = F.zip_with(F.col("r"), _table(delta), lambda r, t: r - _score(t))
        cur = cur.withColumn("r", moved)
        if checkpoint_every and (p + 1) % checkpoint_every == 0 and p + 1 < passes:
            cur = cut_lineage(cur)
    models = []
    for k in range(bags):
        # centre each term (row-weighted) and move its mean into the intercept
        for f in range(d):
            tot = sum(counts[k][f])
            mean = sum(s * c for s, c in zip(scores[k][f], counts[k][f])) / tot if tot else 0.0
            scores[k][f] = [s - mean for s in scores[k][f]]
            intercepts[k] += mean
        models.append(AdditiveModel(features, edges, intercepts[k], scores[k], counts[k]))
    return models, cur


def fit_additive_bagged(
    df: DataFrame,
    features: list[str],
    label: str,
    key,
    bags: int = 8,
    bag_fraction: float = 0.85,
    seed: int = 42,
    max_bins: int = 256,
    passes: int = 50,
    learning_rate: float | None = None,
    checkpoint_every: int = 2,
    binning: str = "uniform",
) -> AdditiveModel:
    """I7 with outer bags: ``bags`` hash subsamples of the rows (each a
    deterministic ``bag_fraction`` by md5 of seed, bag and key), fitted
    together, with intercepts and score tables averaged.  Bin edges are shared
    (fitted on all rows).
    """
    edges = bin_edges(df, features, max_bins, binning)
    threshold = "%08x" % min(int(bag_fraction * 2**32), 2**32 - 1)
    inside = F.array(*[(md5_hex8(key, f"{seed}:{b}") < F.lit(threshold)).cast("int") for b in range(bags)])
    data = binned(df.withColumn("m", inside), features, edges, label, keep=["m"]).where(F.col("y").isNotNull())
    models, _ = _fit_bags(data, features, edges, bags, max_bins, passes, learning_rate, checkpoint_every)
    scores = [[sum(m.scores[f][i] for m in models) / bags for i in range(max_bins + 1)] for f in range(len(features))]
    # rows of a bin as in one bag, not summed over the overlapping bags
    counts = [[round(sum(m.counts[f][i] for m in models) / bags) for i in range(max_bins + 1)] for f in range(len(features))]
    return AdditiveModel(features, edges, sum(m.intercept for m in models) / bags, scores, counts)


PAIR_ROUNDS = 4
PAIR_RATE = 0.5
PAIR_SHRINK = 5.0  # rows added to a cell's count, so that thin cells move little


def _pair_cell(i: int, j: int, features, edges, coarse: int):
    """Coarse cell of a pair of features as one number."""
    bi = F.floor(F.col("bins")[i] * coarse / edges[features[i]][2]).cast("int")
    bj = F.floor(F.col("bins")[j] * coarse / edges[features[j]][2]).cast("int")
    return bi * 1000 + bj


def _fit_pairs(cur: DataFrame, features, edges, top: int, coarse: int, rounds: int = PAIR_ROUNDS, rate: float = PAIR_RATE, shrink: float = PAIR_SHRINK):
    """I8: rank feature pairs by the residual variance their coarse cell means
    explain and keep ``top`` pairs, fitted one after another.

    Every step moves one pair's cells towards the mean of what all earlier
    steps left over, at most the whole way, so the training error never rises.
    """
    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), _pair_cell(i, j, features, edges, coarse).alias("c")) for i, j in pairs]
    stats = (
        cur.select(F.explode(F.array(*cells)).alias("e"), "r")
        .groupBy("e.i", "e.j", "e.c")
        .agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))
    )
    gain = stats.groupBy("i", "j").agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("gain"))
    best = [(r["i"], r["j"]) for r in gain.orderBy(F.desc("gain"), "i", "j").limit(top).collect()]
    tables: list[dict[int, float]] = [{} for _ in best]
    for _ in range(rounds):
        for k, (i, j) in enumerate(best):
            cell = _pair_cell(i, j, features, edges, coarse)
            # bounded: the cells of one pair
            found = cur.groupBy(cell.alias("c")).agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n")).collect()
            step = {r["c"]: rate * r["s"] / (r["n"] + shrink) for r in found}
            for c, v in step.items():
                tables[k][c] = tables[k].get(c, 0.0) + v
            if step:
                moved = F.create_map(*[x for c, v in step.items() for x in (F.lit(int(c)), F.lit(float(v)))])
                cur = cur.withColumn("r", F.col("r") - F.coalesce(F.element_at(moved, cell), F.lit(0.0)))
        cur = cut_lineage(cur)
    return [(i, j, coarse, {(c // 1000, c % 1000): v for c, v in t.items()}) for (i, j), t in zip(best, tables)]


# ---------------------------------------------------------------- I10-I11 attributions
MOST_FEATURES = 12


def sample_by_hash(df: DataFrame, key, n: int, seed: int) -> DataFrame:
    """Bounded deterministic sample: the ``n`` rows with the smallest md5(seed:key)."""
    return df.orderBy(md5_hex8(key, seed), F.col(key) if isinstance(key, str) else key).limit(n)


def permutation_attributions(
    explain: DataFrame,
    background: DataFrame,
    features: list[str],
    predict: Callable[[DataFrame], DataFrame],
    id_col: str = "id",
    permutations: int = 8,
    seed: int = 42,
) -> DataFrame:
    """``(id, feature, attribution)`` averaged over background rows and permutations.

    ``predict`` maps a DataFrame with the feature columns to one with a
    ``prediction`` column (any Spark ML model's ``transform`` or an
    expression).  Both sets are the caller's; every explained row meets every
    background row, so their product is the work.
    """
    import random

    d = len(features)
    rng = random.Random(seed)
    perms = [rng.sample(range(d), d) for _ in range(permutations)]
    perm_lit = F.array(*[F.array(*[F.lit(i) for i in perm]) for perm in perms])
    bg = cut_lineage(background.select(F.array(*[F.col(f).cast("double") for f in features]).alias("z")))
    bg = bg.withColumn("zid", F.monotonically_increasing_id()).withColumn("deal", F.pmod(F.col("zid"), F.lit(DEALS)))
    x = explain.select(F.col(id_col).alias("id"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    rows = (
        x.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
        .join(bg, "deal")
        .select("id", "x", "zid", "z", F.posexplode(perm_lit).alias("perm", "order"))
        .select("id", "x", "zid", "z", "perm", "order", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("k"))
    )
    # v_k: features order[0..k-1] from x, the rest from z
    switched = F.slice(F.col("order"), 1, F.col("k"))
    masked = rows.withColumn(
        "v", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(F.array_contains(switched, i), F.col("x")[i]).otherwise(F.col("z")[i]))
    )
    feats = masked.select("id", "zid", "perm", "order", "k", *[F.col("v")[i].alias(f) for i, f in enumerate(features)])
    scored = predict(feats).select("id", "zid", "perm", "order", "k", F.col("prediction").cast("double").alias("f"))
    w = Window.partitionBy("id", "zid", "perm").orderBy("k")  # d + 1 rows per group
    contrib = scored.withColumn("delta", F.col("f") - F.lag("f").over(w)).where(F.col("k") > 0)
    names = F.array(*[F.lit(f) for f in features])
    per = contrib.select(
        "id", F.element_at(names, F.element_at("order", F.col("k")) + 1).alias("feature"), "delta"
    )
    return per.groupBy("id", "feature").agg(F.avg("delta").alias("attribution"))


def shapley_attributions(
    explain: DataFrame,
    background: DataFrame,
    features: list[str],
    predict: Callable[[DataFrame], DataFrame],
    id_col: str = "id",
) -> DataFrame:
    """I10 exact: ``(id, feature, attribution)`` over all coalitions of at most ``MOST_FEATURES`` features.

    A coalition is a bit mask; its value is the mean prediction over the
    background rows with the coalition's features taken from the explained row.
    Different coalitions often give one vector (equal values, copies in the
    background), so every different vector is predicted once and counted.  A
    feature's attribution is the sum of the values, weighted by the size of the
    coalition, plus where it takes part and minus where it does not.
    """
    d = len(features)
    if d > MOST_FEATURES:
        raise ValueError(f"{d} features have 2**{d} coalitions; use permutation_attributions beyond {MOST_FEATURES}")
    vector = lambda df: F.array(*[F.col(f).cast("double") for f in features])
    bg = cut_lineage(background.select(vector(background).alias("z")).groupBy("z").agg(F.count(F.lit(1)).alias("times")))
    bg = bg.withColumn("deal", F.pmod(F.xxhash64("z"), F.lit(DEALS)))
    x = explain.select(F.col(id_col).alias("id"), vector(explain).alias("x"))
    masks = F.explode(F.sequence(F.lit(0), F.lit(2**d - 1)))
    rows = (
        x.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEALS - 1).cast("long"))))
        .join(bg, "deal")
        .select("id", "x", "z", "times", masks.alias("mask"))
    )
    taken = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(F.call_function("shiftright", F.col("mask"), i).bitwiseAND(1) == 1, F.get("x", i)).otherwise(F.get("z", i)))
    counted = cut_lineage(rows.select("id", "mask", "times", taken.alias("v")).groupBy("id", "mask", "v").agg(F.sum("times").alias("n")))
    different = counted.select("v").distinct().select("v", *[F.get("v", F.lit(i)).alias(f) for i, f in enumerate(features)])
    scored = cut_lineage(predict(different).select("v", F.col("prediction").cast("double").alias("f")))
    # a vector may hold nulls, which an equality would lose
    same = counted["v"].eqNullSafe(scored["v"])
    values = counted.join(scored, same).groupBy("id", "mask").agg((F.sum(F.col("f") * F.col("n")) / F.sum("n")).alias("value"))
    weight = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
    table = F.array(*[F.lit(w) for w in weight])
    size = F.bit_count("mask")

    def part(i: int):
        inside = F.shiftright("mask", i).bitwiseAND(1) == 1
        signed = F.when(inside, F.get(table, size - 1)).otherwise(-F.get(table, size))
        return F.struct(F.lit(features[i]).alias("feature"), (signed * F.col("value")).alias("a"))

    each = values.select("id", F.explode(F.array(*[part(i) for i in range(d)])).alias("e"))
    return each.groupBy("id", F.col("e.feature").alias("feature")).agg(F.sum("e.a").alias("attribution"))


def attribution_summary(attr: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, ranked."""
    return attr.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs_attribution")).orderBy(
        F.desc("mean_abs_attribution"), "feature"
    )


def linear_predictor(coefficients: dict, intercept: float = 0.0):
    """A ``predict`` function for a linear model given as coefficients (JVM-side expression)."""

    def predict(df: DataFrame) -> DataFrame:
        expr = F.lit(float(intercept))
        for f, b in coefficients.items():
            expr = expr + F.lit(float(b)) * F.col(f).cast("double")
        return df.withColumn("prediction", expr)

    return predict


def model_predictor(model, features: list[str]):
    """A ``predict`` function for a fitted Spark ML model on assembled features."""

    def predict(df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        return model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(df))

    return predict
