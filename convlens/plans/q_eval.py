"""Driver queries for inventory J (evaluation) and K (scoring).

Binding: an order's line items give a predicted total (sum of discounted,
taxed prices) and ``orders.o_totalprice`` is the actual; score texts are
built from the order priority.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens.operators import evaluate as J
from convlens.operators import scoring as K
from convlens.plans.q_transcripts import conv_transcripts
from convlens.plans.registry import query, table
from convlens.plans.sqlparts import TURNS_CTE, ascii_word_view

PAIRS_SQL = """
pairs AS (
  SELECT o.o_orderkey, o.o_totalprice AS actual, sum(l.l_extendedprice * (1 - l.l_discount) * (1 + l.l_tax)) AS pred
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_totalprice
)
"""


def order_pairs(spark, sf):
    li = table(spark, sf, "lineitem")
    pred = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("pred")
    )
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("actual"))
    return o.join(pred.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query("j1_pearson", "WITH " + PAIRS_SQL + """
SELECT count(*) AS n, corr(pred, actual) AS r,
       corr(pred, actual) * sqrt((count(*) - 2) / (1 - corr(pred, actual) * corr(pred, actual))) AS t FROM pairs""")
def j1(spark, sf):
    return J.pearson(order_pairs(spark, sf), "pred", "actual", with_p=False)


# the tail of the t density by Simpson's rule, the gamma functions by their series for many degrees of freedom
@query("j1_pearson_pvalue", "WITH " + PAIRS_SQL + """,
c AS (SELECT count(*) AS n, corr(pred, actual) AS r FROM pairs WHERE pred IS NOT NULL AND actual IS NOT NULL),
s AS (SELECT n, r, r * sqrt((n - 2) / (1 - r * r)) AS t, (n - 2)::DOUBLE AS v FROM c),
w AS (SELECT *, abs(t) AS u, 60 / ((v + 1) * abs(t) / (v + t * t) + 4) AS reach, v / 2 AS a FROM s),
k AS (SELECT unnest(range(0, 4001)) AS k),
q AS (SELECT sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
                 * exp(-(v + 1) / 2 * ln(1 + pow(u + reach * k / 4000, 2) / v))) / 3 / 4000 AS i FROM w, k)
SELECT n, r, t, 2 * i * reach * exp(0.5 * ln(a) - 1 / (8 * a) + 1 / (192 * a * a * a)) / sqrt(pi() * v) AS p FROM w, q""")
def j1p(spark, sf):
    return J.pearson(order_pairs(spark, sf), "pred", "actual", with_p=True)


@query("j2_mae", "WITH " + PAIRS_SQL + "SELECT avg(abs(pred - actual)) AS mae FROM pairs")
def j2(spark, sf):
    return J.mae(order_pairs(spark, sf), "pred", "actual")


@query("j3_rmse", "WITH " + PAIRS_SQL + "SELECT sqrt(avg((pred - actual) * (pred - actual))) AS rmse FROM pairs")
def j3(spark, sf):
    return J.rmse(order_pairs(spark, sf), "pred", "actual")


@query("j4_mean_relative_error", "WITH " + PAIRS_SQL + "SELECT avg(abs(pred - actual) / (actual + 1e-10)) AS mean_are FROM pairs")
def j4(spark, sf):
    return J.mean_relative_error(order_pairs(spark, sf), "pred", "actual")


@query("j5_value_ranges", "WITH " + PAIRS_SQL + """
SELECT min(pred) AS min_pred, max(pred) AS max_pred, min(actual) AS min_actual, max(actual) AS max_actual FROM pairs""")
def j5(spark, sf):
    return J.value_ranges(order_pairs(spark, sf), "pred", "actual")


SCORE_TEXT_SQL = "(o_orderkey % 10)::VARCHAR || ' ' || o_orderpriority"


def _k3_sql(text: str) -> str:
    first = rf"nullif(regexp_extract(coalesce({text}, ''), '^\s*([1-7])[\s.,:]', 1), '')"
    fs = f"split_part(coalesce({text}, ''), '.', 1)"
    second = rf"nullif(regexp_extract({ascii_word_view(fs)}, '\b([1-7])\b', 1), '')"
    return f"coalesce({first}, {second}, '-1')::INTEGER"


def score_texts(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat((F.col("o_orderkey") % 10).cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("analysis"),
    )


@query("k3_extract_score", f"SELECT o_orderkey AS id, {_k3_sql(SCORE_TEXT_SQL)} AS predicted_score FROM orders")
def k3(spark, sf):
    return score_texts(spark, sf).select("id", K.extract_score("analysis").alias("predicted_score"))


J6_SQL = f"""
WITH p AS (SELECT o_orderkey AS id, {_k3_sql(SCORE_TEXT_SQL)} AS predicted_score FROM orders),
s AS (SELECT o_orderkey AS id, o_totalprice AS actual_score FROM orders),
m AS (SELECT p.id, p.predicted_score, s.actual_score FROM p JOIN s USING (id) WHERE p.predicted_score <> -1),
mm AS (SELECT min(predicted_score) AS pmin, max(predicted_score) AS pmax, min(actual_score) AS amin, max(actual_score) AS amax FROM m),
r AS (
  SELECT id, predicted_score, actual_score,
         coalesce((predicted_score - pmin)::DOUBLE / nullif(pmax - pmin, 0), 0.0) AS predicted_score_norm,
         coalesce((actual_score - amin) / nullif(amax - amin, 0), 0.0) AS actual_score_norm
  FROM m, mm
),
rows AS (
  SELECT *, abs(predicted_score_norm - actual_score_norm) AS score_diff,
         abs(predicted_score_norm - actual_score_norm) / (actual_score_norm + 1e-10) AS rel_error FROM r
)
"""


@query("j6_evaluation_rows", J6_SQL + "SELECT id, predicted_score, actual_score, predicted_score_norm, actual_score_norm, score_diff, rel_error FROM rows")
def j6_rows(spark, sf):
    preds = score_texts(spark, sf).select("id", K.extract_score("analysis").alias("predicted_score"))
    scores = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    rows, _ = J.evaluate_predictions(preds, scores, key="id")
    return rows.select("id", "predicted_score", "actual_score", "predicted_score_norm", "actual_score_norm", "score_diff", "rel_error")


@query("j6_evaluation_metrics", J6_SQL + """
SELECT count(*) AS n, avg(score_diff) AS mae,
       sqrt(avg((predicted_score_norm - actual_score_norm) * (predicted_score_norm - actual_score_norm))) AS rmse,
       corr(predicted_score_norm, actual_score_norm) AS pearson_correlation, avg(rel_error) AS mean_are,
       avg(abs(predicted_score - actual_score)) AS orig_mae,
       sqrt(avg((predicted_score - actual_score) * (predicted_score - actual_score))) AS orig_rmse,
       corr(predicted_score, actual_score) AS orig_corr,
       (SELECT count(*) FROM p WHERE predicted_score = -1) AS dropped_invalid
FROM rows""")
def j6_metrics(spark, sf):
    preds = score_texts(spark, sf).select("id", K.extract_score("analysis").alias("predicted_score"))
    scores = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    _, m = J.evaluate_predictions(preds, scores, key="id")
    return m.select("n", "mae", "rmse", "pearson_correlation", "mean_are", "orig_mae", "orig_rmse", "orig_corr", "dropped_invalid")


@query("j7_comparison_table", "WITH " + PAIRS_SQL + """
SELECT 'lines' AS model, count(*) AS n, avg(abs(pred - actual)) AS mae, sqrt(avg((pred - actual) * (pred - actual))) AS rmse FROM pairs
UNION ALL
SELECT 'scaled' AS model, count(*) AS n, avg(abs(pred * 1.01 - actual)) AS mae, sqrt(avg((pred * 1.01 - actual) * (pred * 1.01 - actual))) AS rmse FROM pairs""")
def j7(spark, sf):
    p = order_pairs(spark, sf)
    a = J.error_metrics(p, "pred", "actual").select(F.lit("lines").alias("model"), "n", "mae", "rmse")
    b = J.error_metrics(p.withColumn("pred", F.col("pred") * 1.01), "pred", "actual").select(F.lit("scaled").alias("model"), "n", "mae", "rmse")
    return J.union_metrics([a, b])


QUESTION_SQL = K.DEFAULT_QUESTION.replace("'", "''").replace("\n", "' || chr(10) || '")


@query("k1_build_prompt", "WITH " + TURNS_CTE + f"""
SELECT id, string_agg(raw, '|' ORDER BY turn) || '{QUESTION_SQL}' AS prompt FROM t GROUP BY id""")
def k1(spark, sf):
    return K.build_prompt(conv_transcripts(spark, sf), "transcript").select("id", "prompt")


def stub_scorer(texts):
    """Deterministic stand-in for a model: a score from the text length, then a reason."""
    return [f"{len(t) % 7 + 1}. The answers are {'long' if len(t) > 2000 else 'short'}." for t in texts]


_STUB_SQL = f"""
asked AS (SELECT id, string_agg(raw, '|' ORDER BY turn) || '{QUESTION_SQL}' AS prompt FROM t GROUP BY id),
rated AS (SELECT id, prompt, len(prompt) % 7 + 1 AS score, (len(prompt) % 7 + 1) || '. The answers are ' || CASE WHEN len(prompt) > 2000 THEN 'long' ELSE 'short' END || '.' AS analysis FROM asked)"""


@query("k2_score_text", "WITH " + TURNS_CTE + "," + _STUB_SQL + " SELECT id, analysis, NULL::VARCHAR AS error FROM rated")
def k2(spark, sf):
    prompts = K.build_prompt(conv_transcripts(spark, sf), "transcript")
    return K.score_text(prompts, "id", "prompt", stub_scorer)


@query("k4_run_rating", "WITH " + TURNS_CTE + "," + _STUB_SQL + " SELECT id, score::INTEGER AS predicted_score, analysis, NULL::VARCHAR AS error FROM rated")
def k4(spark, sf):
    return K.run_rating(conv_transcripts(spark, sf), stub_scorer)
