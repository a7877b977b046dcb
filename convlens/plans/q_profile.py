"""Driver queries for inventory F (profiling of the individual table)."""

from __future__ import annotations

from convlens.operators import profile as P
from convlens.plans import pipelines as PL
from convlens.plans.q_vectors import individual
from convlens.plans.registry import query, table, union_tables
from convlens.plans.sqlparts import INDIVIDUAL_CTE

IND = "WITH " + INDIVIDUAL_CTE


@query("f1_histogram", """
WITH mm AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT least(coalesce(floor((l_extendedprice - lo) / nullif(hi - lo, 0) * 19) + 1, 1), 19)::INTEGER AS bin
      FROM lineitem, mm WHERE l_extendedprice IS NOT NULL),
c AS (SELECT bin, count(*)::BIGINT AS n FROM b GROUP BY bin),
bins AS (SELECT range::INTEGER AS bin FROM range(1, 20))
SELECT bins.bin, lo + (bins.bin - 1) * (hi - lo) / 19 AS lower, lo + bins.bin * (hi - lo) / 19 AS upper, coalesce(c.n, 0)::BIGINT AS count
FROM bins CROSS JOIN mm LEFT JOIN c USING (bin)""")
def f1(spark, sf):
    return P.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 19)


@query("f2_percentile", """
SELECT l_returnflag, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag""")
def f2(spark, sf):
    return P.percentile(table(spark, sf, "lineitem"), "l_extendedprice", 0.95, by=["l_returnflag"])


@query("f2_ratio_p95", IND + "SELECT quantile_cont(ratio, 0.95) AS p95 FROM ind")
def f2_ratio(spark, sf):
    return P.percentile(individual(spark, sf), "ratio", 0.95)


@query("f3_winsorize", IND + """
SELECT id, least(ratio, (SELECT quantile_cont(ratio, 0.95) FROM ind)) AS ratio_capped FROM ind""")
def f3(spark, sf):
    return P.winsorize(individual(spark, sf), "ratio", 0.95, "ratio_capped").select("id", "ratio_capped")


@query("f4_linear_trend", IND + """,
c AS (SELECT similarity, least(ratio, (SELECT quantile_cont(ratio, 0.95) FROM ind)) AS x FROM ind)
SELECT regr_slope(similarity, x) AS slope, regr_intercept(similarity, x) AS intercept FROM c""")
def f4(spark, sf):
    capped = P.winsorize(individual(spark, sf), "ratio", 0.95, "ratio_capped")
    return P.linear_trend(capped, "similarity", "ratio_capped")


@query("f5_value_counts", IND + "SELECT cluster, count(*)::BIGINT AS count FROM ind GROUP BY cluster")
def f5(spark, sf):
    return P.value_counts(individual(spark, sf), "cluster")


@query("f6_box_stats", IND + """,
q AS (SELECT cluster, quantile_cont(similarity, 0.25) AS q1, quantile_cont(similarity, 0.5) AS median,
             quantile_cont(similarity, 0.75) AS q3 FROM ind GROUP BY cluster),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.cluster, q1, median, q3,
       min(similarity) FILTER (WHERE similarity BETWEEN lo AND hi) AS lower_whisker,
       max(similarity) FILTER (WHERE similarity BETWEEN lo AND hi) AS upper_whisker,
       count(*) FILTER (WHERE NOT (similarity BETWEEN lo AND hi))::BIGINT AS n_outliers
FROM f JOIN ind USING (cluster) GROUP BY f.cluster, q1, median, q3""")
def f6(spark, sf):
    return P.box_stats(individual(spark, sf), "similarity", "cluster")


PROFILE_SQL = """,
prof AS (SELECT cluster, avg(similarity) AS similarity, avg(interviewer_length) AS interviewer_length,
                avg(interviewee_length) AS interviewee_length, avg(ratio) AS ratio, count(id)::BIGINT AS count
         FROM ind GROUP BY cluster)
"""


@query("f7_cluster_profile", IND + PROFILE_SQL + "SELECT * FROM prof")
def f7(spark, sf):
    return P.cluster_profile(individual(spark, sf))


def _norm(c):
    return f"(prof.{c} - (SELECT min({c}) FROM prof))::DOUBLE / nullif((SELECT max({c}) FROM prof) - (SELECT min({c}) FROM prof), 0) AS {c}"


@query(
    "f8_normalized_profile",
    IND + PROFILE_SQL + "SELECT cluster, " + ", ".join(_norm(c) for c in ["similarity", "interviewer_length", "interviewee_length", "ratio", "count"]) + " FROM prof",
)
def f8(spark, sf):
    prof = P.cluster_profile(individual(spark, sf))
    return P.normalize_profile(prof, [*P.PROFILE_METRICS, "count"])


TOPBOTTOM_SQL = """,
n AS (SELECT count(*) AS total, greatest(floor(count(*) * 0.1)::BIGINT, 5) AS k FROM ind WHERE similarity IS NOT NULL),
r AS (SELECT id, similarity, interviewer_length, interviewee_length, ratio,
             row_number() OVER (ORDER BY similarity, id) - 1 AS position FROM ind WHERE similarity IS NOT NULL),
sl AS (SELECT 'bottom' AS slice, r.* FROM r, n WHERE position < k
       UNION ALL SELECT 'top' AS slice, r.* FROM r, n WHERE position >= total - k)
"""


@query("f9_top_bottom", IND + TOPBOTTOM_SQL + "SELECT slice, id, similarity, position::BIGINT AS position FROM sl")
def f9(spark, sf):
    return P.top_bottom(individual(spark, sf)).select("slice", "id", "similarity", "position")


@query("f10_slice_means", IND + TOPBOTTOM_SQL + """
SELECT slice, avg(similarity) AS similarity, avg(interviewer_length) / 100 AS interviewer_length_100,
       avg(interviewee_length) / 100 AS interviewee_length_100, avg(ratio) AS ratio FROM sl GROUP BY slice""")
def f10(spark, sf):
    return P.slice_means(P.top_bottom(individual(spark, sf)))


@query("f11_summary_report", IND + """
SELECT CASE WHEN grouping(cluster) = 1 THEN 'dataset' ELSE 'cluster' END AS level, cluster, count(*)::BIGINT AS size,
       avg(similarity) AS average_similarity, min(similarity) AS min_similarity, max(similarity) AS max_similarity,
       avg(interviewer_length) AS average_interviewer_length, avg(interviewee_length) AS average_interviewee_length,
       avg(ratio) AS average_ratio
FROM ind GROUP BY ROLLUP (cluster)""")
def f11(spark, sf):
    return P.summary_report(individual(spark, sf))


@query("f12_visualize_tables", None)
def f12(spark, sf):
    tables = PL.visualize_tables(individual(spark, sf))
    # all tables one after the other, a row of each as JSON
    return union_tables(tables)
