import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlens.llm import jaccard_join, langid, quality
from convlens.llm.components import connected_components

SF = "/root/testdata/sf0.01"


def near_rows():
    rnd = random.Random(8)
    vocab = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows = []
    for _ in range(60):
        rows.append([rnd.choice(vocab) for _ in range(rnd.randint(3, 120))])
    base = [rnd.choice(vocab) for _ in range(100)]
    for _ in range(90):  # a large group of near copies
        x = list(base)
        for _ in range(rnd.randint(0, 3)):
            x[rnd.randrange(100)] = rnd.choice(vocab)
        rows.append(x)
    for _ in range(30):  # chains at various similarities, and passages that texts share
        x = list(rnd.choice(rows))
        for _ in range(rnd.randint(1, 8)):
            x[rnd.randrange(len(x))] = rnd.choice(vocab)
        rows.append(x)
    texts = [" ".join(x) for x in rows]
    texts += ["", None, "one two three", "One, two three!", "one two three four", "!!! ...", texts[3], texts[70], "w " * 30000, "w " * 29990]
    return list(enumerate(texts))


def brute_near(rows):
    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        k = min(5, len(w))
        return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}
    links = {i: 0 for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and len(s & t) >= 0.8 * len(s | t) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (find(i), links[i]) for i, _ in rows}


@pytest.mark.parametrize("block,texts", [(2048, 512), (16, 7)])
def test_near_copies_against_brute_force(spark, block, texts):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, copies int, h string")
    got = jaccard_join.near_copies(df, block=block, texts=texts).collect()
    assert len(got) == len(rows)
    want = brute_near(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    kept = jaccard_join.drop_near_copies(df, block=block, texts=texts)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (c, _) in want.items() if c == i)


def test_near_copies_null_ids_repeats_and_empty(spark):
    text = "a b c d e f g h i j"
    rows = [(None, text), (4, text), (4, text), (2, text + " k"), (None, "z y x"), (2, "other words than that one here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in jaccard_join.near_copies(df).collect())
    assert got == [(-1, -1, 0), (-1, 2, 3), (2, 2, 0), (2, 2, 3), (4, 2, 3), (4, 2, 3)]
    assert jaccard_join.near_copies(df.limit(0)).count() == 0
    assert jaccard_join.drop_near_copies(df.limit(0)).count() == 0
    kept = sorted(((r.doc_id or -1, r.text) for r in jaccard_join.drop_near_copies(df).collect()))
    assert kept == [(-1, "z y x"), (2, text + " k"), (2, "other words than that one here")]


def test_near_copies_that_only_null_ids_hold(spark):
    words = [f"w{k}" for k in range(60)]
    text, near, far = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(words[::-1])
    rows = [(None, near, 1), (None, near, 2), (7, text, 3), (None, far, 4), (None, far + " tail", 5), (7, "a different text under the same id", 6), (3, near, 7), (3, near, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th int")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_copies(df).collect())
    assert got == Counter({(None, 3, 4): 2, (7, 3, 4): 1, (3, 3, 4): 2, (None, None, 1): 2, (7, 7, 0): 1})
    only = df.where("th in (1, 3)")  # no known id holds the near copy
    assert {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_copies(only).collect()} == {(None, 7, 1), (7, 7, 1)}
    kept = jaccard_join.drop_near_copies(df)
    assert kept.columns == df.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(kept, key=str) == sorted([(3, near), (7, "a different text under the same id"), (None, min(far, far + " tail", key=lambda t: hashlib.md5(t.encode()).hexdigest()))], key=str)


def test_prefix_depth_meets_the_recall():
    d = jaccard_join.prefix_depth(0.8, 20, 8, 0.999)
    assert 1 - (1 - 0.8**d) ** 20 >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** 20


def test_components(spark):
    rnd = random.Random(2)
    chain = [(k, k + 1) for k in range(100, 160)]
    edges = chain + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(500, 500), (7, 7)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"), quality.rating())
    assert (np.diff(model.theta) > 0).all()
    out = quality.score(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r for r in out if r.quality == 1 and r.toxic == 0]
    poor = [r for r in out if r.quality == 0 and r.toxic == 0]
    toxic = [r for r in out if r.toxic == 1]
    kept, grade = (lambda rows: np.mean([r.kept for r in rows])), (lambda rows: np.mean([r.expected_grade for r in rows]))
    assert kept(good) > 0.95 and kept(poor) < 0.3 and kept(toxic) < 0.3
    assert grade(good) > grade(poor) + 0.4 > grade(toxic) + 0.4
    again = quality.fit(docs.repartition(7), labels.where("doc_id % 2 = 0").repartition(3), quality.rating())
    assert (model.weights == again.weights).all() and (model.theta == again.theta).all() and model.cut == again.cut


def test_ordinal_fit_is_a_minimum_of_the_penalised_likelihood():
    rng = np.random.default_rng(3)
    index = rng.integers(0, 30, 5000)
    starts = np.arange(0, 5000, 5)
    score = np.add.reduceat(np.where(index < 8, -2.0, np.where(index < 14, 1.5, 0.0)), starts) + rng.logistic(size=1000)
    grade = (score > -2).astype(int) + (score > 1)
    counts = np.full(1000, 5)
    model = quality.fit_ordinal(index, counts, grade, 3, rounds=1500)

    def loss(weights, theta):
        p = quality.Model(weights, theta, 0.5).probabilities(np.add.reduceat(weights[index].astype(float), starts))
        return -np.log(p[np.arange(1000), grade]).mean() + quality.DECAY / 2 * (weights.astype(float) ** 2).sum()

    best = loss(model.weights, model.theta)
    assert (np.diff(model.theta) > 0).all() and np.count_nonzero(model.weights) >= 10
    for j in np.flatnonzero(model.weights):
        for step in (-0.05, 0.05):
            w = model.weights.copy()
            w[j] += step
            assert loss(w, model.theta) > best - 1e-6
    for k in range(2):
        for step in (-0.05, 0.05):
            t = model.theta.copy()
            t[k] += step
            assert loss(model.weights, t) > best - 1e-6


def test_quality_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (3, "!!!", None, None), (4, "good words " * 20000, "x", 1), (4, "good words", "x", 1)], "doc_id long, text string, kept string, tail int")
    labels = spark.createDataFrame([(4, 1, 0), (1, 0, None), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels, quality.rating())
    got = quality.score(df, model).collect()
    assert len(got) == 5 and all(not r.kept and r.expected_grade == 0 for r in got if r.doc_id < 4)
    out = quality.drop_rejected(df, model)
    assert out.columns == df.columns and out.count() == sum(r.kept for r in got)
    assert quality.fit(df, labels.limit(0), quality.rating()) is None
    assert quality.drop_rejected(df, None).count() == 5
    assert quality.score(df.limit(0), model).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.fit(docs, ~out)
    got = langid.identify(docs, model).join(docs.where(out).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_rare_languages_are_learned_at_any_size(spark):
    rows = [(i, f"the cat and dog number {i} went home", "en") for i in range(2000)]
    rows += [(3000 + i, "le chat et le chien sont rentres", "fr") for i in range(3)] + [(None, "die katze und der hund", "de")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), rows=60)
    assert model.langs == ["de", "en", "fr"]
    got = {r.text: r.lang_pred for r in langid.identify(docs, model).join(docs, "doc_id").where("doc_id >= 3000").collect()}
    assert set(got.values()) == {"fr"}
    assert langid.fit(docs, F.lit(True), rows=1).langs == ["de", "en", "fr"]
    assert langid.level([2000, 3, 2], 60) == 55 and langid.level([5, 5], 10) == float("inf")


def brute_viterbi(score, penalty):
    n, m = score.shape
    best, back = score[0].astype(float), []
    for t in range(1, n):
        step = best[:, None] - penalty * (1 - np.eye(m))
        back.append(step.argmax(0))
        best = step.max(0) + score[t]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return best.max(), path[::-1]


def test_viterbi_is_optimal():
    rng = np.random.default_rng(9)
    counts = np.array([0, 5, 1, 40, 0, 17, 17, 0])
    score = rng.normal(size=(counts.sum(), 3)) * 4
    state = langid.viterbi(score, counts, 3.0)
    at = 0
    for n in counts:
        if n:
            s, x = score[at : at + n], state[at : at + n]
            value = s[np.arange(n), x].sum() - 3.0 * (np.diff(x) != 0).sum()
            assert abs(value - brute_viterbi(s, 3.0)[0]) < 1e-9
        at += n


def test_language_spans_scripts_and_edge_rows(spark):
    train = [(k, "the house and the garden with trees " * 3, "en") for k in range(30)]
    train += [(100 + k, "дом и сад с деревьями у реки " * 3, "ru") for k in range(30)]
    train += [(200 + k, "das haus und der garten mit bäumen " * 3, "de") for k in range(30)] + [(300, None, "de"), (301, "x", None)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), F.lit(True))
    assert model.langs == ["de", "en", "ru"]
    mixed = "the house and the garden with trees, дом и сад с деревьями. das haus und der garten mit bäumen"
    rows = [(1, mixed, "x"), (2, None, "x"), (3, "", "x"), (4, "12 !?", "x"), (5, "日本語", "x"), (6, "дом " * 40000, "x"), (None, "garden", "x"), (1, mixed, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = langid.identify(df, model, spans=True).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [s.lang for s in by[1].spans] == ["en", "ru", "de"]
    assert mixed[by[1].spans[1].begin : by[1].spans[1].end] == "дом и сад с деревьями"
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (2, 3, 4))
    assert by[5].lang_pred in model.langs and by[6].lang_pred == "ru"
    assert langid.identify(df.limit(0), model).count() == 0
    assert langid.fit(df.select("doc_id", "text", F.lit(None).cast("string").alias("lang")), F.lit(True)) is None
    assert langid.identify(df, None).where("lang_pred = 'und'").count() == len(rows)


def test_quality_counts_whole_texts_and_bounds_rows_not_words(spark, monkeypatch):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(9000)]
    rows, labels = [], []
    for i in range(120):
        text = rnd.sample(words, 4000 if i % 4 == 0 else 60)
        poor = i % 2 == 0
        if poor:
            text[len(text) - 1] = f"mark{i % 3}"
        rows.append((i, " ".join(text)))
        labels += [(i, 0 if poor else 1, 0)] * 3
    rows += [(500, rows[2][1])] * 40 + [(501, "x " + "!" * 5000), (502, "x " + "!" * 5001)]
    labels += [(500, 0, 0)] * 20 + [(None, 1, 1), (501, None, 0)]
    docs = spark.createDataFrame([(i, t, "g") for i, t in rows], "doc_id long, text string, grade string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    texts = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t"))
    given = table.select(F.col("doc_id").alias("i"), quality.rating().cast("int").alias("grade")).where("grade >= 0")
    rated = texts.join(given, "i")
    index, counts, grade, fold, worded = quality.sample_features(texts, given)
    assert len(grade) == 121 and worded.all()  # repeats count once
    # what stays is what chi-square over whole texts leaves, in all rows or without a fold
    sets = {(i, t): np.unique(quality.hashed(t, {})) for i, t in rows}
    known = sorted({(r.i, r.t, r.grade) for r in rated.collect()}, key=lambda r: r[0])
    h = {(r.i, r.grade): r.k for r in rated.select("i", "grade", F.pmod(F.xxhash64(F.xxhash64("i", "t"), "grade"), F.lit(quality.FOLDS)).alias("k")).collect()}
    used = set()
    for left_out in (None, 0, 1, 2):
        some = [r for r in known if h[r[0], r[2]] != left_out]
        for f in {x for i, t, _ in some for x in sets[i, t].tolist()}:
            n, chi = np.zeros((2, 3)), 0.0
            for i, t, g in some:
                n[int(f in sets[i, t]), g] += 1
            for a in range(2):
                for g in range(3):
                    e = n[a].sum() * n[:, g].sum() / n.sum()
                    chi += (n[a, g] - e) ** 2 / e if e else 0
            if n[1].sum() >= quality.LEAST_DF and chi >= quality.CHI:
                used.add(f)
    assert used and set(index.tolist()) == used
    assert sorted(counts.tolist()) == sorted(int(np.isin(quality.hashed(t, {}), list(used)).sum()) for _, t, _ in known)
    few = quality.sample_features(texts, given, sample=40)
    assert 15 < len(few[2]) < 70
    assert quality.features("x " + "!" * 5000) != quality.features("x " + "!" * 5001)


def test_language_of_texts_without_letters_and_of_marked_letters(spark):
    rows = [(1, "the of and that is", "en"), (2, "der die das und ist", "de"), (3, "हिन्दी में लिखा हुआ पाठ", "hi"), (4, "తెలుగు లో రాసిన పాఠం", "te")] * 3
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(train, F.lit(True))
    texts = ["½ ² Ⅳ", "²³¹", "\u0301\u0308", "१२३", "ha\u0308tte der", "में लिखा", "లో రాసిన", "½ the and", None, "", "12 !!"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, model, spans=True).collect()}
    assert [got[k].lang_pred for k in range(len(texts))] == ["und"] * 4 + ["de", "hi", "te", "en", "und", "und", "und"]
    assert all(got[k].score == 0 and got[k].spans == [] for k in (0, 1, 2, 3, 8, 9, 10))
    assert [(s.begin, s.end) for s in got[5].spans] == [(0, len(texts[5]))]  # vowel signs don't cut words
    assert langid._WORD.findall("ha\u0308tte में") == ["ha\u0308tte", "में"]
    assert langid.NAMES[langid.scripts_of(np.array([0x0C24]))[0]] == "telugu"


def test_near_copies_of_the_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_copies(docs).collect()}
    assert got == brute_near(rows)
    assert sum(n > 0 for _, n in got.values()) > 20


def test_language_of_held_out_documents(spark):
    from convlens.llm.queries import held_out

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, ~held_out())
    found = langid.identify(docs, model).join(docs.where(held_out() & F.col("lang").isNotNull()).select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.97
