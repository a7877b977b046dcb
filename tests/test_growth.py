"""What keeps the work of a query in proportion to its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens.plans import q_models

SMOKE = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_document_features_are_counted_once(spark):
    train, test = q_models._split(spark, SMOKE)
    for side in (train, test):
        plan = plan_of(side)
        assert "Exchange" not in plan and "Join" not in plan
    assert train.count() + test.count() == spark.read.parquet(f"{SMOKE}/labels.parquet").join(
        spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id"), "doc_id"
    ).where(F.col("doc_id").isNotNull()).count()


def test_modifiers_neither_sort_nor_shuffle_tokens(spark):
    from convlens.operators import sentiment as S

    rows = [(1, 0, "NOT the best but the very GOOD one"), (2, 0, "never good!"), (2, 0, "never good!"), (None, 0, "good"), (3, 0, None), (4, 0, "")]
    df = spark.createDataFrame(rows, "id long, sentence_no long, sentence string")
    for modifiers in (True, "negation"):
        out = S.score_sentences(df, {"good": 1.9, "best": 3.2}, modifiers=modifiers)
        assert "Window" not in plan_of(out)
        got = sorted(((r["id"] or 0, r["compound"], r["neu"]) for r in out.collect()))
        assert [g[0] for g in got] == [0, 1, 2, 2, 3, 4]
        assert got[0][1:] == (0.0, 1.0) and got[4][1:] == (0.0, 1.0) and got[5][1:] == (0.0, 1.0)
        assert got[2] == got[3] and got[2][1] > 0  # one sentence: never never good good


def test_short_word_lists_are_broadcast(spark):
    from convlens.operators import bow as B

    tokens = spark.range(1000).selectExpr("id", "cast(id as string) as term")
    assert "Exchange hashpartitioning" not in plan_of(B.remove_stop_words(tokens))


def test_forest_rows_of_a_task_are_bounded(spark, monkeypatch):
    from convlens.operators import prep as H

    monkeypatch.setattr(H, "FOREST_ROWS", 100)
    df = spark.range(1000).selectExpr("cast(id as double) as x", "cast(id % 7 as double) as z", "cast(id * 2 as double) as y").coalesce(1)
    assert H._spread(df).rdd.getNumPartitions() == 10
    assert abs(sum(r["importance"] for r in H.rf_importance(df, ["x", "z"], "y", num_trees=5).collect()) - 1) < 1e-9


def test_hashed_embedding_deals_texts_by_id_only(spark):
    from convlens.plans import q_vectors

    plan = plan_of(q_vectors.e1(spark, SMOKE))
    assert "hashpartitioning(term" not in plan and ", b#" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def test_cuts_are_decided_once_and_chunks_are_packed_in_one_pass(spark):
    from convlens.operators import boundaries as BO
    from convlens.operators import subwords as W

    df = spark.createDataFrame([(1, "Dr. Who is in. He left! Why? No."), (2, None), (3, " "), (4, "one two. three four. five")], "doc_id long, text string")
    cut = BO.split(df, BO.train(df), "doc_id")
    assert "Generate" not in plan_of(cut)  # reads the written cuts
    vocabulary = {"one", "two", "three", "four", "five"}
    out = W.chunk_subwords(df, "text", vocabulary, max_length=6)
    assert "aggregate(" not in plan_of(out)
    got = {r["doc_id"]: [tuple(c) for c in r["chunks"]] for r in out.collect()}
    assert got[2] == [] and got[3] == []
    assert got[4] == [("one two three four", 4), ("five", 1)]


def test_stub_model_counts_letters():
    from convlens.plans import q_vectors

    text = "Ab zÄKKİ {`9"
    want = [sum(ch == chr(97 + k) for ch in text.lower()) for k in range(26)]
    assert q_vectors._stub_embedder([text, ""]).tolist() == [want, [0] * 26]
