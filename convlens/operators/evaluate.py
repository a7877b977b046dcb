"""Evaluation metrics (inventory J), computed in single aggregation passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.functions.stats import safe_corr, t_pvalue
from convlens.operators.align import rename_first_numeric

EPSILON = 1e-10


def pearson(df: DataFrame, a: str, b: str, by: list[str] | None = None, with_p: bool = True) -> DataFrame:
    """``(n, r, t, p)``; ``t = r * sqrt((n - 2) / (1 - r^2))``, p two-sided, null for n < 3."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    agg = pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), safe_corr(a, b).alias("r"))
    t = F.when(F.col("n") >= 3, F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, F.lit(1.0) - F.col("r") * F.col("r"))))
    out = agg.withColumn("t", t)
    if with_p:
        out = out.withColumn("p", F.when(F.col("n") >= 3, t_pvalue(F.col("t"), (F.col("n") - 2).cast("double"))))
    return out


def error_metrics(df: DataFrame, pred: str, actual: str, by: list[str] | None = None, epsilon: float = EPSILON) -> DataFrame:
    """J2-J5 in one pass: MAE, RMSE, mean absolute relative error and value ranges."""
    d = F.col(pred) - F.col(actual)
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.avg(F.abs(d) / (F.col(actual) + F.lit(epsilon))).alias("mean_are"),
        F.min(pred).alias("min_pred"),
        F.max(pred).alias("max_pred"),
        F.min(actual).alias("min_actual"),
        F.max(actual).alias("max_actual"),
    )


def mae(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """J2."""
    return df.agg(F.avg(F.abs(F.col(pred) - F.col(actual))).alias("mae"))


def rmse(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """J3."""
    d = F.col(pred) - F.col(actual)
    return df.agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def mean_relative_error(df: DataFrame, pred: str, actual: str, epsilon: float = EPSILON, robust: bool = False) -> DataFrame:
    """``mean(|pred - actual| / (actual + eps))``; ``robust`` skips rows with actual 0."""
    src = df.where(F.col(actual) != 0) if robust else df
    return src.agg(F.avg(F.abs(F.col(pred) - F.col(actual)) / (F.col(actual) + F.lit(epsilon))).alias("mean_are"))


def value_ranges(df: DataFrame, pred: str, actual: str) -> DataFrame:
    """J5."""
    return df.agg(F.min(pred).alias("min_pred"), F.max(pred).alias("max_pred"), F.min(actual).alias("min_actual"), F.max(actual).alias("max_actual"))


def evaluate_predictions(
    predictions: DataFrame,
    scores: DataFrame,
    key: str = "id",
    score_key: str = "Participant",
    pred_col: str = "predicted_score",
    valid_only: bool = True,
):
    """Join predictions with actual scores, scale both to [0, 1], and
    return ``(rows, metrics)``.

    ``rows`` adds ``predicted_score_norm, actual_score_norm, score_diff,
    rel_error``; ``metrics`` is one row with normalised and original MAE, RMSE,
    Pearson r / p, mean relative error, ranges and the dropped-row count.
    ``valid_only`` drops predictions of -1 ("no score") and null ones first;
    ``dropped_invalid`` counts both.
    """
    s = scores.withColumnRenamed(score_key, key) if score_key in scores.columns else scores
    s = rename_first_numeric(s, "actual_score", exclude=(key,)).select(key, "actual_score")
    p = predictions
    missing = F.col(pred_col).isNull() | (F.col(pred_col) == -1)
    dropped = p.agg(F.coalesce(F.sum(F.when(missing, 1).otherwise(0)), F.lit(0))).scalar()
    if valid_only:
        p = p.where(~missing)
    merged = p.join(s, key, "inner")
    mm = merged.agg(
        F.struct(
            F.min(pred_col).alias("pmin"), F.max(pred_col).alias("pmax"), F.min("actual_score").alias("amin"), F.max("actual_score").alias("amax")
        )
    ).scalar()  # one scalar subquery holding the four ranges

    def scale(c, lo, hi):
        scaled = F.coalesce(F.try_divide(F.col(c).cast("double") - mm[lo], F.nullif(mm[hi] - mm[lo], F.lit(0))), F.lit(0.0))
        return F.when(F.col(c).isNotNull(), scaled)  # a missing value stays missing and enters no mean

    rows = (
        merged.withColumn("predicted_score_norm", scale(pred_col, "pmin", "pmax"))
        .withColumn("actual_score_norm", scale("actual_score", "amin", "amax"))
        .withColumn("score_diff", F.abs(F.col("predicted_score_norm") - F.col("actual_score_norm")))
        .withColumn("rel_error", F.col("score_diff") / (F.col("actual_score_norm") + F.lit(EPSILON)))
    )
    dn = F.col("predicted_score_norm") - F.col("actual_score_norm")
    do = F.col(pred_col) - F.col("actual_score")
    metrics = rows.agg(
        F.count("*").alias("n"),
        F.avg("score_diff").alias("mae"),
        F.sqrt(F.avg(dn * dn)).alias("rmse"),
        safe_corr("predicted_score_norm", "actual_score_norm").alias("pearson_correlation"),
        F.avg("rel_error").alias("mean_are"),
        F.avg(F.abs(do)).alias("orig_mae"),
        F.sqrt(F.avg(do * do)).alias("orig_rmse"),
        safe_corr(pred_col, "actual_score").alias("orig_corr"),
        F.min(pred_col).alias("min_pred"),
        F.max(pred_col).alias("max_pred"),
        F.min("actual_score").alias("min_actual"),
        F.max("actual_score").alias("max_actual"),
    ).withColumn("dropped_invalid", dropped)
    t = F.col("pearson_correlation") * F.sqrt(F.try_divide(F.col("n") - 2, F.lit(1.0) - F.col("pearson_correlation") ** 2))
    metrics = metrics.withColumn("p_value", F.when(F.col("n") >= 3, t_pvalue(t, (F.col("n") - 2).cast("double"))))
    return rows, metrics


def comparison_table(rows: list[dict], spark) -> DataFrame:
    """Model comparison ``(Model, Pearson r, MAE, CV MAE)``; CV MAE nullable."""
    data = [(r["model"], r.get("r"), r.get("mae"), r.get("cv_mae")) for r in rows]
    return spark.createDataFrame(data, "model string, pearson_r double, mae double, cv_mae double")


def union_metrics(frames: list[DataFrame]) -> DataFrame:
    """J7 from one-row metric frames: ``unionByName`` (missing columns -> null)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
