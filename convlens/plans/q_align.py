"""Driver queries for inventory G (alignment) and H (scaling, splitting, selection)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens.operators import align as G
from convlens.operators import prep as H
from convlens.plans.registry import query, table

def li_key():
    """Unique row key of lineitem ((order, line) alone repeats in the driver data)."""
    return F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])


LI_KEY_SQL = "l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR || '-' || l_suppkey::VARCHAR"


# ---------------------------------------------------------------- G
@query("g2_join_scores", """
SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)""")
def g2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return G.join_scores(docs, table(spark, sf, "labels"), "doc_id")


@query("g3_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def g3(spark, sf):
    return G.keep_matching(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id")


@query("g4_common_ids", """
SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier""")
def g4(spark, sf):
    return G.common_keys(
        [(table(spark, sf, "orders"), "o_custkey"), (table(spark, sf, "customer"), "c_custkey"), (table(spark, sf, "supplier"), "s_suppkey")]
    )


@query("g5_sort_by_id", "SELECT c_custkey, c_name FROM customer ORDER BY c_name")
def g5(spark, sf):
    return G.sort_by(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name")


@query("g6_cleanse_ids", r"""
SELECT c_custkey, TRY_CAST(nullif(regexp_replace(c_name, '\D', '', 'g'), '') AS BIGINT) AS id FROM customer ORDER BY id""")
def g6(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("id"))
    return G.cleanse_id_column(c, "id")


EVENT_KEY_SQL = "'P' || user_id::VARCHAR || 'Q' || event_id::VARCHAR"


def _events_keyed(spark, sf):
    e = table(spark, sf, "events")
    return e.withColumn("participant_question", F.concat(F.lit("P"), F.col("user_id").cast("string"), F.lit("Q"), F.col("event_id").cast("string")))


@query("g7_participant_key", rf"""
SELECT event_id, lower(nullif(regexp_extract({EVENT_KEY_SQL}, '^(PP?\d+)', 1), '')) AS participant FROM events""")
def g7(spark, sf):
    return _events_keyed(spark, sf).select("event_id", G.participant_key("participant_question").alias("participant"))


@query("g8_mean_by_key", rf"""
SELECT lower(nullif(regexp_extract({EVENT_KEY_SQL}, '^(PP?\d+)', 1), '')) AS participant,
       avg(event_id) AS event_id, avg(user_id) AS user_id, avg(value::DECIMAL(38, 10))::DOUBLE AS value
FROM events GROUP BY 1""")
def g8(spark, sf):
    e = _events_keyed(spark, sf).withColumn("participant", G.participant_key("participant_question")).drop("participant_question")
    return G.mean_by_key(e, "participant", decimal_scale=10)


@query("g9_numeric_columns", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem""")
def g9(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*G.numeric_columns(li))


@query("g10_first_numeric_rename", "SELECT doc_id, quality AS actual_score, toxic FROM labels")
def g10(spark, sf):
    return G.rename_first_numeric(table(spark, sf, "labels"), "actual_score", exclude=("doc_id",))


@query("g11_drop_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def g11(spark, sf):
    li = table(spark, sf, "lineitem")
    strict = G.drop_columns(li, ["l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus"], strict=True)
    return G.drop_columns(strict, ["l_shipdate", "no_such_column"], strict=False)


@query("g12_rename", "SELECT doc_id AS id, quality AS Overall, toxic AS Excited FROM labels")
def g12(spark, sf):
    return G.rename(table(spark, sf, "labels"), {"doc_id": "id", "quality": "Overall", "toxic": "Excited"})


# ---------------------------------------------------------------- H
@query("h1_minmax_column", """
SELECT l_orderkey, l_linenumber,
       coalesce((l_extendedprice - (SELECT min(l_extendedprice) FROM lineitem))
         / nullif((SELECT max(l_extendedprice) FROM lineitem) - (SELECT min(l_extendedprice) FROM lineitem), 0), 0.0) AS l_extendedprice
FROM lineitem""")
def h1(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return H.minmax_scale(li, ["l_extendedprice"])


H2_COLS = ["l_quantity", "l_discount", "l_tax"]


def _h2_sql():
    th = "%08x" % int(0.5 * 2**32)
    flag = f"substr(md5('42:' || {LI_KEY_SQL}), 1, 8) < '{th}'"
    fit = ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in H2_COLS)
    cols = ", ".join(
        f"CASE WHEN max_{c} - min_{c} = 0 THEN 0.0 ELSE ({c} - min_{c})::DOUBLE / (max_{c} - min_{c}) END AS {c}" for c in H2_COLS
    )
    return f"""
WITH s AS (SELECT *, {flag} AS is_test FROM lineitem),
fit AS (SELECT {fit} FROM s WHERE NOT is_test)
SELECT l_orderkey, l_linenumber, {cols} FROM s, fit WHERE is_test"""


@query("h2_minmax_fit_apply", _h2_sql())
def h2(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *H2_COLS)
    train, test = H.train_test_split(li, li_key(), test_size=0.5, seed=42)
    return H.minmax_scale(test, H2_COLS, fit_on=train).drop("l_partkey", "l_suppkey")


@query("h3_zscore", """
SELECT p_partkey,
       coalesce((p_size - (SELECT avg(p_size) FROM part)) / nullif((SELECT stddev_pop(p_size) FROM part), 0), 0.0) AS p_size,
       coalesce((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / nullif((SELECT stddev_pop(p_retailprice) FROM part), 0), 0.0) AS p_retailprice
FROM part""")
def h3(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return H.zscore(p, ["p_size", "p_retailprice"])


@query("h4_split", f"""
SELECT l_orderkey, l_linenumber, substr(md5('42:' || {LI_KEY_SQL}), 1, 8) < '{"%08x" % int(0.3 * 2**32)}' AS is_test FROM lineitem""")
def h4(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", li_key().alias("k"))
    train, test = H.train_test_split(li, "k", test_size=0.3, seed=42)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True))).drop("k")


@query("h4_split_exact", f"""
WITH r AS (SELECT l_orderkey, l_linenumber,
                  row_number() OVER (ORDER BY substr(md5('1:' || {LI_KEY_SQL}), 1, 8), {LI_KEY_SQL}) - 1 AS pos FROM lineitem)
SELECT l_orderkey, l_linenumber, pos < round(0.2 * (SELECT count(*) FROM lineitem)) AS is_test FROM r""")
def h4_exact(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", li_key().alias("k"))
    train, test = H.train_test_split(li, "k", test_size=0.2, seed=1, exact=True)
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True))).drop("k")


H5_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _h5_sql():
    rows = []
    for a in H5_COLS:
        for b in H5_COLS:
            v = f"corr({a}, {b})" if a != b else f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END"
            rows.append(f"SELECT '{a}' AS a, '{b}' AS b, ({v})::DOUBLE AS corr FROM lineitem")
    return "\nUNION ALL\n".join(rows)


@query("h5_correlation_matrix", _h5_sql())
def h5(spark, sf):
    return H.correlation_matrix(table(spark, sf, "lineitem"), H5_COLS)


@query("h6_rf_importance", None)
def h6(spark, sf):
    p = table(spark, sf, "part")
    return H.rf_importance(p, ["p_size", "p_partkey"], "p_retailprice", num_trees=100, seed=42)


H7_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _h7_sql():
    rows = "\nUNION ALL\n".join(
        f"SELECT '{f}' AS feature, corr({f}, l_extendedprice) AS r, count(*) AS n FROM lineitem" for f in H7_FEATURES
    )
    return f"""
WITH c AS ({rows}),
s AS (SELECT feature, r, r * r / (1 - r * r) * (n - 2) AS f_score FROM c)
SELECT feature, r, f_score, row_number() OVER (ORDER BY f_score DESC NULLS LAST, feature)::BIGINT AS rank FROM s"""


@query("h7_f_regression", _h7_sql())
def h7(spark, sf):
    return H.f_regression(table(spark, sf, "lineitem"), H7_FEATURES, "l_extendedprice")


@query("h9_standardize", """
SELECT d.n_chars, l.quality AS Overall FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def h9(spark, sf):
    feats = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    scores = table(spark, sf, "labels").select(
        F.col("doc_id").alias("Participant"), F.col("quality").alias("Overall"), F.col("toxic").alias("Excited")
    )
    _, _, merged = H.standardize_data(feats, scores)
    return merged
