"""Driver queries for inventory H10 and I (models and explanations).

Binding: documents with a label are the rows, their word-length shares
(C11) and character count are the features, ``labels.quality`` the target;
lineitem gives a larger numeric matrix for the additive model and the
attribution checks; the ablation (H10) runs over the conversations' feature
table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens.functions.stats import safe_corr
from convlens.operators import bow as B
from convlens.operators import explain as X
from convlens.operators import models as M
from convlens.operators import prep as H
from convlens.plans import pipelines as PL
from convlens.plans.q_align import LI_KEY_SQL, li_key
from convlens.plans.q_features import DRIVER_FILLERS, DRIVER_LEXICON, conv_parts
from convlens.plans.registry import query, table
from convlens.session import cut_lineage

DOC_FEATURES = ["n_chars", "word_length_2", "word_length_3", "word_length_4", "word_length_5", "word_length_6", "word_length_7", "word_length_8_plus"]


def doc_features(spark, sf):
    docs = table(spark, sf, "documents")
    counts, _ = B.count_vectors(docs, "doc_id", "text")
    wl = B.word_length_features(counts, docs, "doc_id").withColumnRenamed("id", "doc_id")
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    feats = docs.select("doc_id", F.col("n_chars").cast("double").alias("n_chars")).join(wl, "doc_id").join(lab, "doc_id")
    # one short row per document, written once: splits, fits and scores all read it, none counts the words again
    return cut_lineage(feats.fillna(0.0, subset=DOC_FEATURES))


def _split(spark, sf):
    return H.train_test_split(doc_features(spark, sf), F.col("doc_id"), test_size=0.5, seed=42)


def scored_features(spark, sf):
    """The whole feature table (G1 with clusters) with ``labels.quality`` of the same number as score, and its feature columns."""
    parts = conv_parts(spark, sf)
    members, _, _ = PL.transcript_analysis(parts, k=5, seed=42, dim=64)
    feats = PL.feature_table(parts, DRIVER_LEXICON, DRIVER_FILLERS, clusters=members.select("id", "cluster"))
    features = [c for c in feats.columns if c != "id"]
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("quality"))
    # written once: every round reads all of it
    return cut_lineage(feats.join(lab, "id").fillna(0.0, subset=features)), features


@query("h10_ablation", None)
def h10(spark, sf):
    df, features = scored_features(spark, sf)
    return M.ablation(df, features, "quality", H.DEFAULT_DROP, key=F.col("id"))


@query("i1_gbt_grid_search", None)
def i1(spark, sf):
    train, _ = _split(spark, sf)
    _, t = M.grid_search(train, DOC_FEATURES, "quality", folds=5, key=F.col("doc_id"))
    return t


@query("i2_gbt_default", None)
def i2(spark, sf):
    train, test = _split(spark, sf)
    model = M.gbt_default(train, DOC_FEATURES, "quality")
    return M.predict_evaluate(model, test, DOC_FEATURES, "quality")


#: Rows of the test side, and whether the errors lie in what the labels allow.
_BOUNDS_SQL = f"""
SELECT count(*) AS n, true AS within FROM documents JOIN labels USING (doc_id)
WHERE substr(md5('42:' || doc_id), 1, 8) < '{"%08x" % int(0.5 * 2**32)}' AND quality IS NOT NULL"""


def _bounds(scores):
    return scores.select("n", ((F.col("mae") >= 0) & (F.col("mae") <= 1) & (F.coalesce(F.abs("r"), F.lit(0.0)) <= 1 + 1e-9) & (F.col("n_dropped") == 0)).alias("within"))


@query("i2_bounds", _BOUNDS_SQL)
def i2_bounds(spark, sf):
    return _bounds(i2(spark, sf))


@query("i6_bounds", _BOUNDS_SQL)
def i6_bounds(spark, sf):
    return _bounds(i6(spark, sf))


@query("h6_bounds", "SELECT unnest([" + ", ".join(f"'{f}'" for f in DOC_FEATURES) + "]) AS feature, true AS within FROM (SELECT count(*) FROM documents)")
def h6_bounds(spark, sf):
    """Every feature has an importance from 0 to 1; together they are 1."""
    rows = cut_lineage(H.rf_importance(doc_features(spark, sf), DOC_FEATURES, "quality", num_trees=100, seed=42))
    whole = rows.agg(F.sum("importance")).scalar()
    return rows.select("feature", (F.col("importance").between(0, 1) & (F.abs(whole - 1) < 1e-9)).alias("within"))


#: The space of the reference's first search (its second stops at depth 5).
RANDOM_SPACE = {"maxIter": [30, 50, 70], "maxDepth": [2, 3, 4, 5, 6]}


@query("i3_random_search", None)
def i3(spark, sf):
    train, _ = _split(spark, sf)
    _, t = M.random_search(train, DOC_FEATURES, "quality", RANDOM_SPACE, n_iter=5, folds=3, key=F.col("doc_id"))
    return t


@query("i4_ridge", None)
def i4(spark, sf):
    train, _ = _split(spark, sf)
    return M.ridge_fit(train, DOC_FEATURES, "quality", alpha=1.0)


@query("i4_ridge_1d", """
WITH s AS (SELECT avg(p_size) AS mx, avg(p_retailprice) AS my, covar_pop(p_size, p_retailprice) * count(*) AS sxy,
                  var_pop(p_size) * count(*) AS sxx FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL)
SELECT sxy / (sxx + 1.0) AS coefficient, my - sxy / (sxx + 1.0) * mx AS intercept FROM s""")
def i4_1d(spark, sf):
    return M.ridge_1d(table(spark, sf, "part"), "p_size", "p_retailprice", alpha=1.0)


@query("i5_cv_score", None)
def i5(spark, sf):
    from pyspark.ml.regression import GBTRegressor

    train, _ = _split(spark, sf)
    est = GBTRegressor(seed=42, maxIter=10, maxDepth=3, labelCol="label", featuresCol="features")
    score = M.cv_score(train, DOC_FEATURES, "quality", est, folds=5, key=F.col("doc_id"))
    return spark.createDataFrame([(score,)], "cv_mae double")


AM_FEATURES = ["l_quantity", "l_discount", "l_tax"]
_LI_FOLD_SQL = f"('0x' || substr(md5('fold42:' || ({LI_KEY_SQL})), 1, 8))::BIGINT % 5"


def _fold_sums_sql() -> str:
    cols = ["1.0", *[f"{c}::DOUBLE" for c in AM_FEATURES], "l_extendedprice::DOUBLE"]
    parts = [f"SELECT fold, {i} AS i, {j} AS j, sum(c{i} * c{j}) AS s FROM li GROUP BY fold" for i in range(len(cols)) for j in range(i, len(cols))]
    named = ", ".join(f"{c} AS c{k}" for k, c in enumerate(cols))
    present = " AND ".join(f"{c} IS NOT NULL" for c in [*AM_FEATURES, "l_extendedprice"])
    return f"WITH li AS (SELECT ({_LI_FOLD_SQL})::INTEGER AS fold, {named} FROM lineitem WHERE {present}) " + " UNION ALL ".join(parts)


@query("i5_fold_sums", _fold_sums_sql())
def i5_sums(spark, sf):
    li = table(spark, sf, "lineitem")
    return M.gram(li, AM_FEATURES, "l_extendedprice", M.fold_column(li_key(), 5))


@query("i5_ridge_cv", f"""
WITH li AS (SELECT {_LI_FOLD_SQL} AS fold, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem
            WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
fits AS (SELECT f.fold, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) * count(*) AS sxy, var_pop(x) * count(*) AS sxx
         FROM (SELECT DISTINCT fold FROM li) f JOIN li ON li.fold <> f.fold GROUP BY f.fold),
w AS (SELECT alpha, fold, mx, my, sxy / (sxx + alpha) AS b FROM fits, (SELECT unnest([0.1, 1.0, 1000000.0])::DOUBLE AS alpha))
SELECT alpha, li.fold::INTEGER AS fold, count(*) AS n, avg(abs(my + b * (x - mx) - y)) AS mae FROM li JOIN w ON w.fold = li.fold GROUP BY alpha, li.fold""")
def i5_ridge(spark, sf):
    return M.ridge_cv(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", alphas=(0.1, 1.0, 1e6), folds=5, key=li_key())


@query("i6_predict_evaluate", None)
def i6(spark, sf):
    train, test = _split(spark, sf)
    model = M.ridge_mllib(train, DOC_FEATURES, "quality", alpha=1.0)
    return M.predict_evaluate(model, test, DOC_FEATURES, "quality")


AM_BINS = 32


def _one_pass(spark, sf):
    li = table(spark, sf, "lineitem")
    return X.fit_additive(li, AM_FEATURES, "l_extendedprice", max_bins=AM_BINS, passes=1, checkpoint_every=0)


def _one_pass_sql() -> str:
    lr = 1.0 / len(AM_FEATURES)
    parts = []
    for f in AM_FEATURES:
        b = f"least(greatest(floor(({f} - lo_{f}) / w_{f})::INTEGER, 0), {AM_BINS - 1})"
        parts.append(f"SELECT '{f}' AS term, CASE WHEN {f} IS NULL THEN {AM_BINS} ELSE {b} END AS bin, l_extendedprice AS y FROM lineitem, mm")
    edges = ", ".join(
        f"min({f})::DOUBLE AS lo_{f}, CASE WHEN max({f}) > min({f}) THEN (max({f})::DOUBLE - min({f})) / {AM_BINS} ELSE 1.0 END AS w_{f}"
        for f in AM_FEATURES
    )
    return f"""
WITH mm AS (SELECT {edges} FROM lineitem),
ybar AS (SELECT avg(l_extendedprice) AS m FROM lineitem WHERE l_extendedprice IS NOT NULL),
cells AS ({" UNION ALL ".join(parts)}),
terms AS (SELECT term, bin, {lr} * (avg(y) - (SELECT m FROM ybar)) AS score, count(*)::BIGINT AS n FROM cells WHERE y IS NOT NULL GROUP BY term, bin)
"""


@query("i7_additive_one_pass", "WITH " + _one_pass_sql()[6:] + "SELECT term, bin, score, n FROM terms")
def i7_one(spark, sf):
    return _one_pass(spark, sf).term_table(spark).select("term", "bin", "score", "n")


@query("i7_additive_model", None)
def i7(spark, sf):
    train, _ = _split(spark, sf)
    m = X.fit_additive(train, DOC_FEATURES, "quality", max_bins=256, passes=30, binning="quantile")
    return m.term_table(spark)


@query("i7_additive_bagged", None)
def i7_bagged(spark, sf):
    train, _ = _split(spark, sf)
    m = X.fit_additive_bagged(train, DOC_FEATURES, "quality", key="doc_id", bags=8, max_bins=256, passes=30)
    return m.importance(spark)


@query("i8_interactions", None)
def i8(spark, sf):
    train, test = _split(spark, sf)
    m = X.fit_additive(train, DOC_FEATURES, "quality", max_bins=256, passes=30, interactions=10)
    pred = m.predict(test, keep=["doc_id", "quality"])
    return pred.agg(F.count(F.lit(1)).alias("n"), safe_corr("prediction", "quality").alias("r"), F.avg(F.abs(F.col("prediction") - F.col("quality"))).alias("mae"))


@query("i9_importance", "WITH " + _one_pass_sql()[6:] + """
SELECT term, sum(abs(score) * n) / sum(n) AS importance FROM terms GROUP BY term""")
def i9(spark, sf):
    return _one_pass(spark, sf).importance(spark)


LINEAR = {"l_quantity": 1.5, "l_discount": -20.0, "l_tax": 7.0}


def _attr_sets(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("k", li_key()).select("k", *AM_FEATURES)
    explain = X.sample_by_hash(li, "k", 10, seed=3)
    background = X.sample_by_hash(li, "k", 50, seed=4)
    return explain, background


def _attr_linear(spark, sf):
    explain, background = _attr_sets(spark, sf)
    return X.permutation_attributions(explain, background, AM_FEATURES, X.linear_predictor(LINEAR), id_col="k", permutations=4, seed=42)


ATTR_SQL = f"""
WITH li AS (SELECT {LI_KEY_SQL} AS k, {", ".join(AM_FEATURES)} FROM lineitem),
ex AS (SELECT * FROM li ORDER BY substr(md5('3:' || k), 1, 8), k LIMIT 10),
bg AS (SELECT * FROM li ORDER BY substr(md5('4:' || k), 1, 8), k LIMIT 50),
zm AS (SELECT {", ".join(f"avg({f}::DOUBLE) AS m_{f}" for f in AM_FEATURES)} FROM bg),
attr AS ({" UNION ALL ".join(f"SELECT ex.k AS id, '{f}' AS feature, {b} * (ex.{f} - zm.m_{f}) AS attribution FROM ex, zm" for f, b in LINEAR.items())})
"""


@query("i10_attributions_linear", ATTR_SQL + "SELECT id, feature, attribution FROM attr")
def i10(spark, sf):
    return _attr_linear(spark, sf)


def _curved(df):
    """A prediction that is not linear: products, a square and a threshold."""
    q, d, t = (F.col(c).cast("double") for c in AM_FEATURES)
    return df.withColumn("prediction", q * d + 100 * t * t + F.when(q > 25, 3 * d).otherwise(q * t))


def _shapley_sql() -> str:
    f = lambda q, d, t: f"({q} * {d} + 100 * {t} * {t} + CASE WHEN {q} > 25 THEN 3 * {d} ELSE {q} * {t} END)"
    named = ", ".join(f"{c}::DOUBLE AS f{k}" for k, c in enumerate(AM_FEATURES))
    values = ", ".join(
        f"avg({f(*[('ex' if m >> k & 1 else 'bg') + f'.f{k}' for k in range(3)])}) AS v{m}" for m in range(8)
    )
    weight = {0: "1.0 / 3", 1: "1.0 / 6", 2: "1.0 / 3"}
    parts = []
    for k, c in enumerate(AM_FEATURES):
        terms = " + ".join(f"{weight[bin(m).count('1')]} * (v{m | 1 << k} - v{m})" for m in range(8) if not m >> k & 1)
        parts.append(f"SELECT id, '{c}' AS feature, ({terms})::DOUBLE AS attribution FROM val")
    return f"""
WITH li AS (SELECT {LI_KEY_SQL} AS k, {named} FROM lineitem),
ex AS (SELECT * FROM li ORDER BY substr(md5('3:' || k), 1, 8), k LIMIT 10),
bg AS (SELECT * FROM li ORDER BY substr(md5('4:' || k), 1, 8), k LIMIT 50),
val AS (SELECT ex.k AS id, {values} FROM ex, bg GROUP BY ex.k)
""" + " UNION ALL ".join(parts)


@query("i10_shapley", _shapley_sql())
def i10_shapley(spark, sf):
    explain, background = _attr_sets(spark, sf)
    return X.shapley_attributions(explain, background, AM_FEATURES, _curved, id_col="k")


@query("i10_attributions_model", None)
def i10_model(spark, sf):
    li = table(spark, sf, "lineitem")
    model = M.ridge_mllib(li, AM_FEATURES, "l_extendedprice", 1.0)
    explain, background = _attr_sets(spark, sf)
    return X.permutation_attributions(explain, background, AM_FEATURES, X.model_predictor(model, AM_FEATURES), id_col="k", permutations=4)


@query("i11_attribution_summary", ATTR_SQL + """
SELECT feature, avg(abs(attribution)) AS mean_abs_attribution FROM attr GROUP BY feature""")
def i11(spark, sf):
    return X.attribution_summary(_attr_linear(spark, sf))


@query("h6_rf_importance_docs", None)
def h6_docs(spark, sf):
    return H.rf_importance(doc_features(spark, sf), DOC_FEATURES, "quality", num_trees=100, seed=42)
