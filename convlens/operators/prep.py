"""Scaling, splitting and feature selection (inventory H).

Fitted statistics are one-row aggregates (min/max, mean/stddev, correlations)
applied as a projection after a one-row broadcast join, so fit and apply are
single passes with partial aggregation.  Splits are hash based: a row's side
depends only on its key and the seed, never on partitioning.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.functions.common import as_col, md5_hex8
from convlens.functions.stats import safe_corr
from convlens.operators import gram
from convlens.operators.align import cleanse_id_column, drop_columns, join_scores
from convlens.operators.sequence import global_rank

# The reference's drop list, in its order.
DEFAULT_DROP = [
    "interviewer_length",
    "interviewee_length",
    "cluster",
    "total_word_count",
    "similarity",
    "minimum_sentence_sentiment",
    "maximum_sentence_sentiment",
    "word_length_2",
    "word_length_3",
    "word_length_4",
    "word_length_5",
    "speaker_balance",
]


# ---------------------------------------------------------------- H1-H3 scaling
def fit_minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """One-row table of ``min_c``, ``max_c``."""
    return df.agg(*[F.min(c).alias(f"min_{c}") for c in cols], *[F.max(c).alias(f"max_{c}") for c in cols])


def apply_minmax(df: DataFrame, params: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """Scale to [0, 1] by fitted min/max (values outside the fit range leave it);
    a constant column maps to 0.  The one-row fit is a scalar subquery."""
    p = params.select(F.struct(*params.columns)).scalar()
    out = df
    for c in cols:
        lo, hi = p[f"min_{c}"], p[f"max_{c}"]
        out = out.withColumn(
            c + suffix,
            F.coalesce(F.try_divide(F.col(c).cast("double") - lo, F.nullif(hi - lo, F.lit(0))), F.when(F.col(c).isNotNull(), F.lit(0.0))),
        )
    return out


def minmax_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """H1/H2: min-max scale columns, fitted on ``fit_on`` (default: ``df`` itself)."""
    return apply_minmax(df, fit_minmax(fit_on if fit_on is not None else df, cols), cols, suffix)


def zscore(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """H3: ``(x - mean) / stddev_pop``; a constant column maps to 0."""
    src = fit_on if fit_on is not None else df
    p = src.agg(F.struct(*[F.avg(c).alias(f"mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"sd_{c}") for c in cols])).scalar()
    out = df
    for c in cols:
        out = out.withColumn(
            c + suffix,
            F.coalesce(
                F.try_divide(F.col(c).cast("double") - p[f"mu_{c}"], F.nullif(p[f"sd_{c}"], F.lit(0.0))),
                F.when(F.col(c).isNotNull(), F.lit(0.0)),
            ),
        )
    return out


# ---------------------------------------------------------------- H4 split
def split_flag(key, fraction: float, seed: int = 42) -> Column:
    """True for the ``fraction`` side: first 8 hex digits of md5(seed:key) below the threshold."""
    threshold = "%08x" % min(int(fraction * 2**32), 2**32 - 1)
    return md5_hex8(key, seed) < F.lit(threshold)


def train_test_split(df: DataFrame, key, test_size: float = 0.5, seed: int = 42, exact: bool = False):
    """H4: ``(train, test)`` by a hash of the key.

    Deterministic and independent of partitioning.  Sizes are approximate;
    ``exact=True`` ranks rows by the hash (distributed exact rank) and puts the
    first ``round(test_size * N)`` into the test side.
    """
    k = as_col(key)
    if not exact:
        flagged = df.withColumn("__test", split_flag(k, test_size, seed))
    else:
        n_test = int(round(test_size * df.count()))
        ranked = global_rank(df.withColumn("__h", md5_hex8(k, seed)).withColumn("__k", k.cast("string")), [F.col("__h"), F.col("__k")], "__r")
        flagged = ranked.withColumn("__test", F.col("__r") < F.lit(n_test)).drop("__h", "__k", "__r")
    return flagged.where(~F.col("__test")).drop("__test"), flagged.where(F.col("__test")).drop("__test")


# ---------------------------------------------------------------- H5 correlation
WIDE = 60  # columns up to which every pair is an expression of its own


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """H5: long ``(a, b, corr)`` Pearson matrix in one aggregation; nulls dropped pairwise,
    constant column -> null.  Over ``WIDE`` columns it comes from blocked sums (``gram``)."""
    if len(cols) > WIDE:
        return gram.correlations(df, cols)
    pairs = [(a, b) for a in cols for b in cols]
    uniq = list(combinations(cols, 2))
    # one aggregation: every pairwise correlation and every column's deviation
    agg = df.agg(*[safe_corr(a, b).alias(f"{a}\u0001{b}") for a, b in uniq], *[F.stddev_pop(c).alias(f"sd\u0001{c}") for c in cols])
    entries = []
    for a, b in pairs:
        if a == b:
            # diagonal: 1 unless the column is constant
            entries.append((a, b, None))
        else:
            name = f"{a}\u0001{b}" if (a, b) in uniq else f"{b}\u0001{a}"
            entries.append((a, b, name))
    both = agg
    structs = []
    for a, b, name in entries:
        v = F.col(name) if name else F.when(F.col(f"sd\u0001{a}") > 0, F.lit(1.0))
        structs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.cast("double").alias("corr")))
    return both.select(F.explode(F.array(*structs)).alias("e")).select("e.a", "e.b", "e.corr")


# ---------------------------------------------------------------- H6 importance
FOREST_ROWS = 100_000  # of a task


def _spread(data: DataFrame) -> DataFrame:
    """Every level of a forest reads all rows again: the rows of a task must not grow with the table."""
    tasks = -(-data.count() // FOREST_ROWS)
    return data.repartition(tasks) if tasks > data.rdd.getNumPartitions() else data


def rf_importance(df: DataFrame, features: list[str], label: str, num_trees: int = 100, seed: int = 42) -> DataFrame:
    """H6: random-forest feature importance ``(feature, importance)`` sorted descending."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    data = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df).select(label, "features")
    model = RandomForestRegressor(numTrees=num_trees, seed=seed, labelCol=label, featuresCol="features").fit(_spread(data))
    imp = model.featureImportances.toArray().tolist()
    rows = [(f, float(v)) for f, v in zip(features, imp)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


# ---------------------------------------------------------------- H7 univariate selection
def f_regression(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """H7 table form: ``(feature, r, f_score, rank)`` with ``F = r^2 / (1 - r^2) * (n - 2)``.

    One aggregation computes every correlation and the row count.
    """
    if len(features) > WIDE:
        rows = gram.label_correlations(df, features, label)
    else:
        agg = df.agg(F.count(F.lit(1)).alias("n"), *[safe_corr(f, label).alias(f) for f in features])
        rows = agg.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("r")) for f in features])).alias("e"))
        rows = rows.select("e.feature", "e.r", "n")
    score = F.try_divide(F.col("r") * F.col("r"), F.lit(1.0) - F.col("r") * F.col("r")) * (F.col("n") - 2)
    scored = rows.select("feature", "r", score.alias("f_score"))
    # k is tiny (number of features): a global window over one row per feature
    from pyspark.sql import Window

    w = Window.orderBy(F.desc_nulls_last("f_score"), F.asc("feature"))
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint"))


def select_k_best(df: DataFrame, features: list[str], label: str, k: int = 20) -> list[str]:
    """H7: names of the ``k`` best features by F score (k capped at the number of features)."""
    table = f_regression(df, features, label).where(F.col("rank") <= min(k, len(features)))
    return [r["feature"] for r in table.orderBy("rank").collect()]


# ---------------------------------------------------------------- H8/H9
def reduced_features(df: DataFrame, drop=DEFAULT_DROP, strict: bool = True) -> DataFrame:
    """H8: apply the fixed drop list."""
    return drop_columns(df, list(drop), strict)


def standardize_data(
    features: DataFrame,
    scores: DataFrame,
    key_from: str = "Participant",
    target: str = "Overall",
    drop=("Excited",),
    digits_only: bool = False,
):
    """H9: rename the score key to ``id``, join on it, drop ``drop`` and ``id``,
    and return ``(X, y)`` as two column selections of the same joined frame.

    ``digits_only`` reproduces the reference's digit-only key (merges id
    families, see G6); the default joins on the full id.
    """
    s = scores.withColumnRenamed(key_from, "id")
    f = features
    if digits_only:
        f, s = cleanse_id_column(f, "id"), cleanse_id_column(s, "id")
    merged = join_scores(f, s, "id").drop(*[c for c in drop if c in s.columns or c in f.columns]).drop("id")
    x_cols = [c for c in merged.columns if c != target]
    return merged.select(*x_cols), merged.select(target), merged
