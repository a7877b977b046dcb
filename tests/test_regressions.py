"""Cases that once went wrong: imports, skew, dropped rows, entries across parts, pair terms."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from convlens.operators import align as G
from convlens.operators import bow as B
from convlens.operators import charseq as L
from convlens.operators import evaluate as J
from convlens.operators import explain as X
from convlens.operators import models as M
from convlens.operators import profile as P
from convlens.operators import transcripts as TR
from convlens.plans import pipelines as PL
from tests.conftest import ROOT, SF_SMALL


def test_entry_imports_without_jars_or_data(tmp_path):
    code = (
        "import sys, pyspark; pyspark.__file__ = '/nowhere/pyspark/__init__.py'; import glob, zipfile; "
        "glob.glob = zipfile.ZipFile = None; "
        f"sys.path.insert(0, {ROOT!r}); import __spark_entry__ as e; assert len(e.queries()) > 100; print('fine')"
    )
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_HOME", "PYTHONPATH")}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("fine"), out.stderr


def test_checkpoint_folder_must_be_set_off_local_mode(spark):
    from convlens import session

    class Cluster:
        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError):
        session.checkpoint_dir(Cluster)


def test_wide_counts_keep_every_document_and_any_number_of_terms(spark):
    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "cc"), (3, None)], "doc_id long, text string")
    terms = [f"t{k}" for k in range(1200)] + ["aa"]
    counts = B.term_counts(B.tokenize(docs, "doc_id", "text"))
    rows = {r["document_id"]: r for r in B.wide_counts(counts, terms, docs, "doc_id").collect()}
    assert {k: r["aa"] for k, r in rows.items()} == {1: 2, 2: 0, 3: 0} and len(rows[1]) == 1202


def test_count_vectors_read_texts_once(spark):
    docs = spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet"))
    counts, _ = B.count_vectors(docs, "doc_id", "text")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in plan  # only the written counts and a row count are read again


def test_long_ids_keep_their_digits(spark):
    df = spark.createDataFrame([("u3000000000",), ("p7",), ("x",)], "id string")
    assert [r[0] for r in df.select(G.digits_of("id")).collect()] == [3000000000, 7, None]


@pytest.mark.parametrize("valid_only", [True, False])
def test_missing_prediction_is_no_zero(spark, valid_only):
    pred = spark.createDataFrame([("a", 2), ("b", None), ("c", 6), ("d", -1)], "id string, predicted_score int")
    score = spark.createDataFrame([("a", 2.0), ("b", 3.0), ("c", 6.0), ("d", 4.0)], "Participant string, Overall double")
    rows, metrics = J.evaluate_predictions(pred, score, valid_only=valid_only)
    got = {r["id"]: r["predicted_score_norm"] for r in rows.collect()}
    assert got.get("b") is None and ("b" in got) is not valid_only
    assert metrics.first()["dropped_invalid"] == 2


def test_rows_without_prediction_are_counted(spark):
    df = spark.createDataFrame([(float(k), None if k % 2 else float(k), float(k)) for k in range(40)], "a double, b double, y double")
    model = M.ridge_mllib(df, ["a", "b"], "y")
    got = M.predict_evaluate(model, df, ["a", "b"], "y").first()
    assert (got["n"], got["n_dropped"]) == (20, 20)


def test_percentiles_with_a_hot_value_and_null_group(spark):
    rnd = random.Random(3)
    rows = [("a", 5.0)] * 600 + [("a", rnd.random() * 10) for _ in range(400)] + [("b", 1.0)] + [(None, float(k)) for k in range(7)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {(r["g"], r["q"]): r["value"] for r in P.exact_percentiles(df, "v", [0.0, 0.25, 0.5, 0.95, 1.0], ["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted(v for x, v in rows if x == g)
        for q in (0.0, 0.25, 0.5, 0.95, 1.0):
            pos = q * (len(own) - 1)
            lo, hi = own[int(pos)], own[-int(-pos // 1)]
            assert got[(g, q)] == pytest.approx(lo + (pos - int(pos)) * (hi - lo))
    assert P.exact_percentiles(df, "v", [0.5]).first()["value"] == 5.0


def test_offsets_of_string_and_sparse_ids(spark):
    rnd = random.Random(4)
    rows = [(f"id{rnd.randrange(10**12)}", "x" * rnd.randrange(9)) for _ in range(300)] + [("zz", None)]
    df = spark.createDataFrame(rows, "id string, text string").repartition(5)
    joined = " ".join(t or "" for _, t in sorted(rows))
    at = 0
    for r in L.joined_texts(df, "id", "text").orderBy("id").collect():
        assert r["offset"] == at and joined[at : at + len(r["text"])] == r["text"]
        at += len(r["text"]) + 1
    offsets = {r["id"]: r["offset"] for r in L.char_offsets(df, "id", "text").collect()}
    assert offsets["zz"] == len(joined)


DICTIONARIES = [
    [("no no", None), ("uh", r"\buh+\b"), ("a b c", None)],
    [("b c", r"\bb\s+c\b"), ("no", None)],
    [("a a", None), ("a b", None), ("b a", None)],
    [("no no no", None), ("c", None), ("a  b", None)],
]


@pytest.mark.parametrize("fillers", DICTIONARIES)
@pytest.mark.parametrize("bucket_size", [4096, 2])
def test_entries_across_parts_equal_the_row_form(spark, fillers, bucket_size):
    rnd = random.Random(5)
    rows = []
    for k in range(80):
        turns = []
        for _ in range(rnd.randint(0, 12)):
            label = rnd.choice(["Interviewee: ", "Interviewee: ", "Interviewer: ", ""])
            turns.append(label + " ".join(rnd.choice(["no", "a", "b", "c", "uh", "é", "no.", "A"]) for _ in range(rnd.randint(0, 3))))
        rows.append((f"t{k}", "|".join(turns)))
    df = spark.createDataFrame(rows, "id string, transcript string")
    long = {r["id"]: r["filler_hits"] for r in TR.transcript_features(TR.parts_from_transcripts(df), fillers, bucket_size=bucket_size).collect()}
    row = {r["id"]: r["filler_hits"] for r in TR.transcript_features_rowwise(df, fillers=fillers).collect()}
    assert long == row
    counts = TR.filler_counts(TR.label_parts(TR.parts_from_transcripts(df)), fillers=fillers, bucket_size=bucket_size)
    assert {r["id"]: r["s"] for r in counts.groupBy("id").agg(F.sum("n").alias("s")).collect()} == {k: v for k, v in long.items() if k in {r["id"] for r in counts.collect()}}


@pytest.fixture(scope="module")
def curved(spark):
    rnd = random.Random(6)
    rows = []
    for _ in range(500):
        a, b, c = rnd.random(), rnd.random(), rnd.random()
        rows.append((a, b, c, 2 * a + (1.0 if (a > 0.5) != (b > 0.5) else 0.0) + (0.5 if (b > 0.3) == (c > 0.3) else 0.0) + rnd.gauss(0, 0.1)))
    return spark.createDataFrame(rows, "a double, b double, c double, y double").coalesce(2)


def test_pair_terms_never_raise_the_training_error(spark, curved):
    errors = []
    for pairs in (0, 1, 2, 3):
        m = X.fit_additive(curved, ["a", "b", "c"], "y", max_bins=16, passes=6, checkpoint_every=3, interactions=pairs, interaction_bins=8)
        p = m.predict(curved)
        errors.append(p.agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0])
    assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:])) and errors[1] < 0.7 * errors[0], errors


def test_bagged_counts_are_those_of_a_bag(spark, curved):
    df = curved.withColumn("k", F.monotonically_increasing_id())
    m = X.fit_additive_bagged(df, ["a"], "y", key="k", bags=4, max_bins=8, passes=3)
    assert 380 <= sum(m.counts[0]) <= 470


def test_analysis_with_a_users_embedder(spark):
    rows = [(f"t{k}", f"Interviewer: a {'b' * (k % 3)}|Interviewee: a {'b' * (k % 2)} c") for k in range(12)] + [("e", ""), ("n", None)]
    parts = TR.parts_from_transcripts(spark.createDataFrame(rows, "id string, transcript string"))

    def embed(texts):
        return [[float(t.count("a")), float(t.count("b")), float(t.count("c"))] for t in texts]

    ind, clusters, summary = PL.transcript_analysis(parts, k=3, dim=3, embedder=embed)
    got = {r["id"]: r for r in ind.collect()}
    assert len(got) == 14 and got["t0"]["similarity"] == pytest.approx(1 / 2**0.5) and got["e"]["similarity"] == 0.0
    assert all(r["cluster"] is not None for r in got.values())
    assert sum(r["size"] for r in clusters.collect()) == 14
    assert {r["metric"]: r["value"] for r in summary.collect()}["number_of_transcripts"] == 14


def test_feature_table_carries_the_cluster(spark):
    parts = TR.parts_from_transcripts(spark.createDataFrame([("a", "Interviewee: x y"), ("b", "Interviewer: x")], "id string, transcript string"))
    member = spark.createDataFrame([("a", 1)], "id string, cluster int")
    got = {r["id"]: r["cluster"] for r in PL.feature_table(parts, {"x": 1.0}, clusters=member).collect()}
    assert got == {"a": 1, "b": None}


def test_windows_over_the_joined_corpus(spark):
    rnd = random.Random(9)
    rows = [(k * 7, "".join(rnd.choice("abc") for _ in range(rnd.choice([0, 1, 2, 5, 40])))) for k in range(40)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), (" ", 3)], "ch string, idx int")
    joined = [" abc".index(c) - 1 if c != " " else 3 for c in " ".join(t or "" for _, t in rows)]
    for block, stride, chunk in ((8, 1, 16), (8, 4, 1 << 16), (30, 3, 31), (len(joined), 1, 64)):
        got = sorted((r["pos"], list(r["x"]), list(r["y"])) for r in L.corpus_windows(df, "id", "text", vocab, block, stride, chunk=chunk).collect())
        want = [(p, joined[p : p + block], joined[p + 1 : p + block + 1]) for p in range(0, len(joined) - block, stride)]
        assert got == want, (block, stride, chunk)


def test_random_search_draws_from_the_references_space(spark, monkeypatch):
    from convlens.plans import q_models as Q

    monkeypatch.setattr(M, "boosted_search", lambda df, features, label, maps, folds, key, seed: (folds, maps))
    monkeypatch.setattr(Q, "_split", lambda spark, sf: (None, None))
    search = M.random_search
    got = []
    monkeypatch.setattr(M, "random_search", lambda *a, **kw: got.append((a[3], *search(*a, **kw))) or (None, None))
    Q.i3(spark, SF_SMALL)
    [(space, folds, maps)] = got
    assert space == {"maxIter": [30, 50, 70], "maxDepth": [2, 3, 4, 5, 6]}
    assert folds == 3 and len(set(maps)) == 5
    assert all(n in (30, 50, 70) and 2 <= d <= 6 for n, d in maps)


def test_ablation_query_asks_for_the_whole_drop_order(spark, monkeypatch):
    from convlens.operators import prep as H
    from convlens.plans import q_models as Q

    asked = []
    monkeypatch.setattr(M, "ablation", lambda *a, **kw: asked.append((a, kw)))
    Q.h10(spark, SF_SMALL)
    [((df, features, label, order), kw)] = asked
    assert order == H.DEFAULT_DROP and len(order) == 12 and set(order) < set(features) < set(df.columns)
    assert set(kw) == {"key"}  # the default grid, 5 folds
    rows = df.collect()
    assert rows and all(r[c] is not None for r in rows for c in [*features, label])
