"""Unit tests for alignment, scaling, vectors, scoring, char sequences and stats."""

import math

import pytest
from pyspark.sql import functions as F

from convlens.functions import vectors as V
from convlens.operators import align as G
from convlens.operators import charseq as L
from convlens.operators import evaluate as J
from convlens.operators import explain as X
from convlens.operators import models as M
from convlens.operators import prep as H
from convlens.operators import scoring as K
from convlens.operators import sentiment as S
from convlens.operators.sequence import exclusive_prefix_sum, global_rank


def test_id_families_stay_distinct_and_digit_key_fans_out(spark):
    feats = spark.createDataFrame([("p5", 1.0), ("pp5", 2.0)], "id string, x double")
    scores = spark.createDataFrame([("p5", 3.0, 0.0), ("pp5", 4.0, 0.0)], "Participant string, Overall double, Excited double")
    _, _, merged = H.standardize_data(feats, scores)
    assert merged.count() == 2
    _, _, merged_digits = H.standardize_data(feats, scores, digits_only=True)
    assert merged_digits.count() == 4


def test_constant_column(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)], "c double, x double")
    assert [r["c"] for r in H.minmax_scale(df, ["c"]).collect()] == [0.0, 0.0, 0.0]
    assert [r["c"] for r in H.zscore(df, ["c"]).collect()] == [0.0, 0.0, 0.0]
    corr = {(r["a"], r["b"]): r["corr"] for r in H.correlation_matrix(df, ["c", "x"]).collect()}
    assert corr[("c", "x")] is None and corr[("c", "c")] is None and corr[("x", "x")] == 1.0


def test_zero_vector_cosine(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [1.0, 1.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine("a", "b")).collect()]
    assert got[0] == 0.0 and abs(got[1] - 1.0) < 1e-12 and got[2] is None


def test_score_text_extraction(spark):
    df = spark.createDataFrame([("6. Good",), ("I rate it 5",), ("10 of 10",), ("none",), (" 3: fine",), ("Score 9. then 4",)], "t string")
    assert [r[0] for r in df.select(K.extract_score("t")).collect()] == [6, 5, -1, -1, 3, -1]


def test_scorer_failures_are_kept(spark):
    def scorer(texts):
        out = []
        for t in texts:
            if "bad" in t:
                raise RuntimeError("boom")
            out.append("4. ok")
        return out

    df = spark.createDataFrame([("a", "good"), ("b", "bad")], "id string, transcript string")
    rows = {r["id"]: r for r in K.run_rating(df, scorer).collect()}
    assert rows["a"]["predicted_score"] == 4 and rows["a"]["error"] is None
    assert rows["b"]["predicted_score"] is None and "boom" in rows["b"]["error"]


def test_windows_short_text_has_none(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, list(range(12)))], "id int, ids array<int>")
    w = L.windows(df, ["id"], "ids", block_size=8, stride=1).collect()
    assert {r["id"] for r in w} == {2}
    assert [r["pos"] for r in w] == [0, 1, 2, 3]
    assert w[0]["x"] == list(range(8)) and w[0]["y"] == list(range(1, 9))


def test_encode_decode_roundtrip(spark):
    df = spark.createDataFrame([("héllo wörld",), ("abc",)], "t string")
    vocab = L.char_vocabulary(df, "t")
    enc = L.encode(df, "t", vocab)
    dec = L.decode(enc, "ids", vocab).select("t", "text").collect()
    assert all(r["t"] == r["text"] for r in dec)
    assert [r["ch"] for r in vocab.orderBy("idx").collect()] == sorted(set("héllo wörldabc"))


def test_sample_prompt(spark):
    df = spark.createDataFrame([("x" * 25,), ("abcdef",), ("",)], "t string")
    assert [r[0] for r in df.select(L.sample_prompt(F.col("t"))).collect()] == ["x" * 20, "abc", ""]


def test_prefix_sum_matches_running_sum(spark):
    rows = [(g, i, (i * 7) % 5) for g in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, o long, v long")
    out = exclusive_prefix_sum(df, ["g"], ["o"], "v", "p", bucket_size=7).collect()
    expect = {}
    for g in range(3):
        acc = 0
        for i in range(50):
            expect[(g, i)] = acc
            acc += (i * 7) % 5
    assert all(r["p"] == expect[(r["g"], r["o"])] for r in out)


def test_global_rank_is_dense_and_ordered(spark):
    df = spark.range(0, 500).select(((F.col("id") * 37) % 500).alias("v")).repartition(7)
    r = sorted((row["rank"], row["v"]) for row in global_rank(df, [F.col("v")], "rank").collect())
    assert [x[0] for x in r] == list(range(500)) and [x[1] for x in r] == list(range(500))


def test_split_is_deterministic_under_repartition(spark):
    df = spark.range(0, 2000).withColumn("k", F.col("id").cast("string"))
    _, t1 = H.train_test_split(df, "k", 0.3, seed=5)
    _, t2 = H.train_test_split(df.repartition(13), "k", 0.3, seed=5)
    a = {r["k"] for r in t1.collect()}
    assert a == {r["k"] for r in t2.collect()} and 450 < len(a) < 750
    _, exact = H.train_test_split(df.repartition(5), "k", 0.3, seed=5, exact=True)
    assert exact.count() == 600


def test_pearson_small_n(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5)], "a double, b double")
    r = J.pearson(df, "a", "b").first()
    assert r["n"] == 2 and r["t"] is None and r["p"] is None


def test_ridge_exact_equals_closed_form_and_mllib(spark):
    rows = [(float(i), float(i % 7), 3.0 * i - 2.0 * (i % 7) + (i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, y double")
    exact = {r["term"]: r["coefficient"] for r in M.ridge_fit(df, ["x1"], "y", alpha=1.0).collect()}
    one = M.ridge_1d(df, "x1", "y", alpha=1.0).first()
    assert abs(exact["x1"] - one["coefficient"]) < 1e-9 and abs(exact["intercept"] - one["intercept"]) < 1e-9
    both = {r["term"]: r["coefficient"] for r in M.ridge_fit(df, ["x1", "x2"], "y", alpha=1.0).collect()}
    ml = M.ridge_mllib(df, ["x1", "x2"], "y", alpha=1.0)
    assert abs(ml.coefficients[0] - both["x1"]) < 1e-4 and abs(ml.coefficients[1] - both["x2"]) < 1e-4


def test_attributions_sum_to_prediction_difference(spark):
    rows = [(f"r{i}", float(i), float(i % 4), float((i * 3) % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, a double, b double, c double")
    ex, bg = df.limit(5), df.orderBy(F.desc("id")).limit(10)

    def predict(d):
        return d.withColumn("prediction", F.col("a") * F.col("b") + 2 * F.col("c"))

    attr = X.permutation_attributions(ex, bg, ["a", "b", "c"], predict, permutations=3)
    sums = {r["id"]: r["s"] for r in attr.groupBy("id").agg(F.sum("attribution").alias("s")).collect()}
    fx = {r["id"]: r["prediction"] for r in predict(ex).collect()}
    mean_bg = predict(bg).agg(F.avg("prediction")).first()[0]
    for k, v in sums.items():
        assert abs(v - (fx[k] - mean_bg)) < 1e-9


def test_additive_model_learns_step(spark):
    rows = [(float(i % 10), float(i % 3), 5.0 if i % 10 >= 5 else 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, z double, y double")
    m = X.fit_additive(df, ["x", "z"], "y", max_bins=10, passes=30, checkpoint_every=10)
    pred = m.predict(df, keep=["y"])
    mae = pred.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert mae < 0.05
    imp = m.importance(spark).collect()
    assert imp[0]["term"] == "x"


def test_sentiment_base_form(spark):
    sents = spark.createDataFrame([(1, 0, "Good day"), (1, 1, "bad bad"), (1, 2, "nothing here")], "id int, sentence_no int, sentence string")
    lex = {"good": 1.9, "bad": -2.5}
    got = {r["sentence_no"]: r for r in S.score_sentences(sents, lex).collect()}
    assert abs(got[0]["compound"] - 1.9 / math.sqrt(1.9**2 + 15)) < 1e-12
    assert abs(got[0]["pos"] - 2.9 / 3.9) < 1e-12 and abs(got[0]["neu"] - 1 / 3.9) < 1e-12
    assert got[2]["compound"] == 0.0 and got[2]["neu"] == 1.0
    neg = spark.createDataFrame([(1, 0, "not good")], "id int, sentence_no int, sentence string")
    r = S.score_sentences(neg, lex, modifiers="negation").first()
    assert r["compound"] < 0


def test_strict_drop_raises(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(KeyError):
        G.drop_columns(df, ["a", "zz"], strict=True)
    assert G.drop_columns(df, ["a", "zz"], strict=False).columns == ["b"]


def test_participant_key(spark):
    df = spark.createDataFrame([("P5Q1",), ("PP5Q1",), ("x",)], "k string")
    assert [r[0] for r in df.select(G.participant_key("k")).collect()] == ["p5", "pp5", None]


def test_piece_scores_equal_sentence_scores(spark):
    from tests.test_longform_equivalence import rand_transcript
    import random

    from convlens.operators import transcripts as TR

    rng = random.Random(3)
    df = spark.createDataFrame([(f"t{i}", rand_transcript(rng, 12)) for i in range(120)], "id string, transcript string")
    parts = TR.parts_from_transcripts(df)
    lex = {"you": 1.2, "know": -0.7, "like": 2.0, "um": -1.5, "élan": 0.4}
    a = {(r["id"], r["sentence_no"]): r for r in S.score_sentences(TR.sentence_table(parts, 3), lex).collect()}
    b = {(r["id"], r["sentence_no"]): r for r in S.score_pieces(TR.sentence_pieces(parts, 3), lex).collect()}
    assert set(a) == set(b) and len(a) > 100
    for k in a:
        for c in ("compound", "pos", "neu", "neg"):
            assert abs(a[k][c] - b[k][c]) < 1e-12, (k, c)


def test_additive_bagging_averages(spark):
    rows = [(f"r{i}", float(i % 10), 5.0 if i % 10 >= 5 else 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    m = X.fit_additive_bagged(df, ["x"], "y", key="k", bags=3, max_bins=10, passes=20, checkpoint_every=0)
    pred = m.predict(df, keep=["y"])
    assert pred.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.1


def test_exact_percentiles_match_numpy(spark):
    import numpy as np

    from convlens.operators import profile as P

    rng = np.random.default_rng(1)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 4, 300), np.round(rng.normal(size=300), 1))]
    rows += [(9, 5.0), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {(r["g"], r["q"]): r["value"] for r in P.exact_percentiles(df, "v", [0.0, 0.25, 0.5, 0.95, 1.0], ["g"]).collect()}
    for g in {r[0] for r in rows}:
        vals = np.array([v for k, v in rows if k == g])
        for q in (0.0, 0.25, 0.5, 0.95, 1.0):
            assert abs(got[(g, q)] - np.percentile(vals, q * 100)) < 1e-12, (g, q)


def test_additive_quantile_bins(spark):
    rows = [(float(i) ** 2, 5.0 if i >= 30 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double")
    m = X.fit_additive(df, ["x"], "y", max_bins=8, passes=10, checkpoint_every=0, learning_rate=1.0, binning="quantile")
    t = m.term_table(spark).collect()
    assert len(t) >= 6 and abs(sum(r["n"] for r in t) - 60) == 0
    pred = m.predict(df, keep=["y"])
    assert pred.agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0] < 0.3


def test_embedder_plug_point_chunks_and_mean_pools(spark):
    import numpy as np

    from convlens.functions import text as T
    from convlens.operators import transcripts as TR
    from convlens.operators import vectors as VO

    def embed(texts):
        return np.array([[len(t), t.count("a"), 1.0] for t in texts], dtype=float)

    long_text = ". ".join(["a b c d e f"] * 40)  # 240 tokens -> several chunks
    df = spark.createDataFrame([(1, long_text), (2, "short a text"), (3, "")], "id int, text string")
    chunks = TR.chunk_text(df, "text", max_length=128).select("id", F.posexplode("chunks").alias("k", "chunk"))
    pooled = {r["id"]: r["embedding"] for r in VO.mean_pool(VO.embed_with(chunks, "id", "chunk", embed, 3), ["id"], "embedding", "embedding").collect()}
    parts = spark.createDataFrame([(long_text,)], "t string").select(T.split_sentences_runs("t").alias("s")).first()["s"]
    assert len(parts) == 40
    got_chunks = [r["chunk"] for r in chunks.where("id = 1").orderBy("k").collect()]
    assert len(got_chunks) == 2 and all(len(c.split()) <= 126 for c in got_chunks)
    assert np.allclose(pooled[1], embed(got_chunks).mean(axis=0))
    assert np.allclose(pooled[2], embed(["short a text"])[0])
    assert 3 not in pooled  # an empty text has no chunk ...
    full = {r["id"]: r["embedding"] for r in VO.embed_texts(df, "id", "text", embed, 3).collect()}
    assert full[3] == [0.0, 0.0, 0.0] and np.allclose(full[1], pooled[1])  # ... and gets the zero vector


def test_scorer_factory_called_once_per_task(spark):
    import os

    calls_dir = __import__("tempfile").mkdtemp(prefix="convlens-calls-")

    def factory():
        open(os.path.join(calls_dir, f"{os.getpid()}-{id(object())}"), "w").close()
        return lambda texts: ["3. fine" for _ in texts]

    df = spark.createDataFrame([(str(i), "t") for i in range(200)], "id string, transcript string").repartition(4)
    rows = K.run_rating(df, scorer_factory=factory).collect()
    assert len(rows) == 200 and all(r["predicted_score"] == 3 for r in rows)
    assert 1 <= len(os.listdir(calls_dir)) <= 4
