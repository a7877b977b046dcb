"""Driver queries for inventory A2-A8 (sources and sinks)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as TY

from convlens.operators import profile as P
from convlens.operators import vectors as VO
from convlens.sources import readers as R
from convlens.sources import writers as W
from convlens.plans.q_vectors import individual
from convlens.plans.registry import query, table
from convlens.plans.q_transcripts import conv_transcripts
from convlens.plans.sqlparts import INDIVIDUAL_CTE, TURNS_CTE
from convlens.session import checkpoint_dir


def _as_csv(spark, df, name: str) -> str:
    """Write rows as the CSV file that a reader expects, in the shared folder."""
    path = os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


@query("a1_read_transcript_file", "WITH " + TURNS_CTE + "SELECT id::VARCHAR AS id, string_agg(raw, '|' ORDER BY turn) AS transcript FROM t GROUP BY id")
def a1_file(spark, sf):
    """Write the transcripts as the reference's CSV file and read them back by position."""
    return R.read_transcripts(spark, _as_csv(spark, conv_transcripts(spark, sf), "transcripts"))


@query("a2_read_scores", "SELECT doc_id::VARCHAR AS id, quality::DOUBLE AS Overall, toxic::DOUBLE AS Excited FROM labels")
def a2(spark, sf):
    # the scores table shape (Participant, Overall, Excited) bound to labels
    s = table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("Participant"), F.col("quality").alias("Overall"), F.col("toxic").alias("Excited")
    )
    return R.read_scores(spark, _as_csv(spark, s, "scores"))


LI_SCHEMA = TY.StructType(
    [
        TY.StructField("l_orderkey", TY.LongType()),
        TY.StructField("l_quantity", TY.DoubleType()),
        TY.StructField("l_extendedprice", TY.DoubleType()),
        TY.StructField("l_discount", TY.DoubleType()),
    ]
)


@query("a3_read_features", "SELECT l_orderkey, l_quantity, l_extendedprice, l_discount FROM lineitem")
def a3(spark, sf):
    return R.read_features(spark, f"{sf}/lineitem.parquet", schema=LI_SCHEMA, fmt="parquet")


@query("a4_read_prosodic", """
SELECT 'P' || user_id::VARCHAR || 'Q' || event_id::VARCHAR AS participant_question, value FROM events""")
def a4(spark, sf):
    e = table(spark, sf, "events").select(
        F.concat(F.lit("P"), F.col("user_id").cast("string"), F.lit("Q"), F.col("event_id").cast("string")).alias("participant&question"),
        "value",
    )
    schema = TY.StructType([TY.StructField("participant&question", TY.StringType()), TY.StructField("value", TY.DoubleType())])
    return R.read_prosodic(spark, _as_csv(spark, e, "prosodic"), schema)


@query("a5_required_columns", "WITH " + INDIVIDUAL_CTE + """
SELECT count(*) AS n_rows, count(DISTINCT cluster) AS n_clusters, true AS has_clusters FROM ind""")
def a5(spark, sf):
    df, has = R.load_checked(individual(spark, sf))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cluster").alias("n_clusters")).withColumn("has_clusters", F.lit(has))


@query("a6_text_length", "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_characters FROM documents")
def a6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_characters"))


@query("a6_whole_text_roundtrip", None)
def a6_files(spark, sf):
    """Write the benchmark texts as text files into the shared folder, read them whole."""
    path = os.path.join(checkpoint_dir(spark), f"texts-{uuid.uuid4().hex}")
    table(spark, sf, "benchmark").select("text").repartition(4).write.text(path)
    return R.read_whole_text(spark, path).select(F.length("text").alias("n_characters"))


@query("a7_write_csv_roundtrip", "WITH " + INDIVIDUAL_CTE + """
SELECT id::BIGINT AS id, similarity, interviewer_length::BIGINT AS interviewer_length, interviewee_length::BIGINT AS interviewee_length,
       ratio, cluster::BIGINT AS cluster FROM ind""")
def a7(spark, sf):
    path = os.path.join(checkpoint_dir(spark), f"individual-{uuid.uuid4().hex}")
    W.write_csv(individual(spark, sf).select("id", "similarity", "interviewer_length", "interviewee_length", "ratio", "cluster"), path)
    kinds = "id long, similarity double, interviewer_length long, interviewee_length long, ratio double, cluster long"
    return spark.read.option("header", True).schema(kinds).csv(path)


def _report_sql() -> str:
    lines = []
    for metric, (label, dec, unit) in W.REPORT_FORMATS.items():
        lines.append(f"WHEN metric = '{metric}' THEN printf('  {label}: %.{dec}f{unit}', value)")
    return " ".join(lines)


@query("a8_report_lines", "WITH " + INDIVIDUAL_CTE + """,
s AS (SELECT count(*)::DOUBLE AS number_of_transcripts, avg(similarity) AS average_similarity, min(similarity) AS min_similarity,
             max(similarity) AS max_similarity, avg(interviewer_length) AS average_interviewer_length,
             avg(interviewee_length) AS average_interviewee_length, avg(ratio) AS average_ratio FROM ind),
summary AS (
  SELECT 'individual' AS section, metric, value FROM (UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE value)
  UNION ALL
  SELECT 'cluster' AS section, 'cluster_' || cluster::VARCHAR AS metric, count(*)::DOUBLE AS value FROM ind GROUP BY cluster
)
SELECT section, metric, CASE WHEN section = 'cluster' THEN printf('  Cluster %s: %.0f transcripts', substr(metric, 9), value) """
    + _report_sql() + " END AS line FROM summary")
def a8(spark, sf):
    return W.report_lines(VO.collection_summary(individual(spark, sf))).drop("ord")


@query("a8_top_bottom_lines", "WITH " + INDIVIDUAL_CTE + """,
n AS (SELECT count(*) AS total, greatest(floor(count(*) * 0.1)::BIGINT, 5) AS k FROM ind WHERE similarity IS NOT NULL),
r AS (SELECT id, similarity, row_number() OVER (ORDER BY similarity, id) - 1 AS position FROM ind WHERE similarity IS NOT NULL)
SELECT 'top' AS part, '  ID: ' || id || ', Similarity: ' || printf('%.4f', similarity) AS line FROM r, n WHERE position >= total - k
UNION ALL SELECT 'bottom', '  ID: ' || id || ', Similarity: ' || printf('%.4f', similarity) FROM r, n WHERE position < k
UNION ALL SELECT 'top', 'Top Interview IDs by Similarity:' UNION ALL SELECT 'top', '' UNION ALL SELECT 'bottom', 'Bottom Interview IDs by Similarity:'""")
def a8_top_bottom(spark, sf):
    lines = W.top_bottom_lines(P.top_bottom(individual(spark, sf)))
    return lines.select(F.when(F.col("ord") < 1e15, F.lit("top")).otherwise(F.lit("bottom")).alias("part"), "line")


@query("a8_profile_lines", "WITH " + INDIVIDUAL_CTE + """,
d AS (SELECT count(*) AS n, avg(similarity) AS s, min(similarity) AS lo, max(similarity) AS hi, avg(interviewer_length) AS er,
             avg(interviewee_length) AS ee, avg(ratio) AS r FROM ind),
c AS (SELECT cluster, count(*) AS n, avg(similarity) AS s, avg(ratio) AS r FROM ind GROUP BY cluster)
SELECT unnest(['Dataset Statistics:', '  Number of Interviews: ' || n, '  Average Similarity: ' || printf('%.4f', s),
               '  Similarity Range: ' || printf('%.4f', lo) || ' to ' || printf('%.4f', hi),
               '  Average Interviewer Length: ' || printf('%.1f', er) || ' characters',
               '  Average Interviewee Length: ' || printf('%.1f', ee) || ' characters',
               '  Average Length Ratio: ' || printf('%.2f', r), '', 'Cluster Information:']) AS line FROM d
UNION ALL
SELECT unnest(['  Cluster ' || cluster || ':', '    Size: ' || n || ' interviews', '    Average Similarity: ' || printf('%.4f', s),
               '    Average Ratio: ' || printf('%.2f', r)]) FROM c""")
def a8_profile(spark, sf):
    return W.profile_lines(P.summary_report(individual(spark, sf))).select("line")
