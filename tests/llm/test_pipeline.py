"""Every stage of the pipeline against a brute-force version, on rows of its own."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from convlens.llm import mixing, quality
from tests.llm.test_exact_and_mixing import water
from tests.llm.test_near_and_models import brute_near

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "kept"]


def corpus():
    rnd = random.Random(12)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    rows, labels = [], []
    for i in range(500):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(15, 90))]
        kind = i % 10
        if kind == 0:
            text, label = " ".join(w.upper() + "!!" for w in words), (0, 0)
        elif kind == 1:
            words[rnd.randrange(len(words))] = rnd.choice(["vilestuff", "meanword"])
            text, label = " ".join(words), (1, 1)
        else:
            text, label = " ".join(words), (1, 0)
        rows.append((i, text, "en", f"s{i % 4}" if i % 3 else "hot", len(text), True))
        if i < 350:
            labels.append((i, *label))
    good = [r for r in rows if r[0] % 10 > 1]
    for k in range(60):  # exact and near copies
        r = rnd.choice(good)
        w = r[1].split()
        if k % 2:
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((1000 + k, " ".join(w), None, r[3], None, False))
    rows += [(2000, None, None, None, None, None), (2001, "", "en", None, 0, True), (2002, "word " * 20000, "en", "s1", 100000, True)]
    return rows, labels


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_against_brute_force(spark, sf_dir):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "mixing", "byte_level_bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = rows_of(docs)

    out = stages["quality_classifier"](spark, docs, sf_dir)
    assert out.columns == COLUMNS
    after = rows_of(out)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.rating())

    def selected(text):
        h = quality.hashed(text, {})
        f = model.weights[h].astype(float).sum()
        return len(h) > 0 and 1 - 1 / (1 + np.exp(-(model.theta[-1] - f))) >= model.cut

    assert sorted(after, key=str) == sorted((r for r in before if selected(r[1])), key=str)
    ids = {r[0] for r in after}
    good = [r[0] for r in before if r[0] < 500 and r[0] % 10 > 1]
    assert sum(i in ids for i in good) > 0.98 * len(good)
    assert sum(i in ids for i in range(0, 500, 10)) < 3 and sum(i in ids for i in range(1, 500, 10)) < 5

    docs, before = spark.createDataFrame(after, out.schema), after
    out = stages["exact_dedup"](spark, docs, sf_dir)
    after = rows_of(out)
    first = {}
    for r in sorted(before, key=lambda r: r[0]):
        first.setdefault(r[1] or "", r)
    assert out.columns == COLUMNS and sorted(after, key=str) == sorted(first.values(), key=str)

    docs, before = spark.createDataFrame(after, out.schema), after
    out = stages["ngram_jaccard_join"](spark, docs, sf_dir)
    after = rows_of(out)
    classes = brute_near([(r[0], r[1]) for r in sorted(before)])
    assert out.columns == COLUMNS and sorted(after, key=str) == sorted((r for r in before if classes[r[0]][0] == r[0]), key=str)
    assert len(after) < len(before)

    docs, before = spark.createDataFrame(after, out.schema), after
    out = stages["mixing"](spark, docs, sf_dir)
    after = rows_of(out)
    times, total, members = Counter(r[0] for r in after), defaultdict(int), defaultdict(list)
    for r in before:
        total[r[3]] += len((r[1] or "").split())
        members[r[3]].append((hashlib.md5(f"7:{r[0]}".encode()).hexdigest(), r[0], len((r[1] or "").split())))
    names = sorted(s for s in total if s is not None) + ([None] if None in total else [])
    target = water(dict(total), {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}, 1.5, 2)
    for s, own in members.items():
        whole = int(target[s] / total[s]) if total[s] else 0
        budget, start = target[s] - whole * total[s], 0
        for _, i, n in sorted(own):
            assert times[i] == whole + (budget > 1e-9 and start + n / 2 <= budget + 1e-9), (s, i)
            start += n
    assert out.columns == COLUMNS and {r[0]: r for r in after}.items() <= {r[0]: r for r in before}.items()

    docs = spark.createDataFrame(after, out.schema)
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = stages["byte_level_bpe"](spark, docs, sf_dir).collect()
    text = {r[0]: r[1] or "" for r in after}
    assert Counter(r.doc_id for r in got) == times
    assert all(list(r.ids) == enc.encode_ordinary(text[r.doc_id]) for r in got)


def test_run_is_the_chain_and_repeats(spark, sf_dir):
    a, b = (sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert a == b and len(a) > 100


def test_empty_documents(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
