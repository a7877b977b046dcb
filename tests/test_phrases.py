"""Many phrases counted by tokens, against regular expressions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convlens.operators import phrases as P
from convlens.operators import transcripts as TR
from tests.test_longform_equivalence import py_parse, rand_transcript

WORDS = ["you", "know", "uh", "like", "so", "kind", "of", "élan", "x", "i", "mean"]


def dictionary(n, seed=3):
    rnd = random.Random(seed)
    out = {"so so", "so so so", "uh uh", "You Know", "kind-of", "x. y", "of", "élan x"}
    while len(out) < n:
        out.add(rnd.choice([" ", " ", " ", "  ", ". "]).join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 4))))
    return sorted(out)


def regex_counts(text, names):
    out = Counter()
    for n in names:
        k = len(re.findall(r"\b" + re.escape(n.lower()) + r"\b", text.lower()))
        if k:
            out[n] = k
    return out


def test_phrase_counts_equal_regular_expressions(spark):
    rnd = random.Random(9)
    names = [n.lower() for n in dictionary(150)]
    texts = ["".join(rnd.choice([*WORDS, "so", "so", "uh"]) + rnd.choice([" ", " ", " ", ". ", "  ", "-", "\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    texts += [None, "", " ", "...", "so so so so so", "SO So sO"]
    df = spark.createDataFrame([(k, 7, t) for k, t in enumerate(texts)], "id long, other int, text string")
    got = {k: Counter() for k in range(len(texts))}
    for r in P.phrase_counts(df, ["id"], "text", names).collect():
        got[r.id][r.phrase] = r.n
    for k, t in enumerate(texts):
        assert got[k] == regex_counts(t or "", names), t
    assert P.phrase_counts(df, ["id"], "text", []).count() == 0
    with pytest.raises(ValueError, match="word character"):
        P.phrase_counts(df, ["id"], "text", ["ok", "no!"])


@pytest.mark.parametrize("bucket_size", [4096, 2])
def test_large_dictionary_equals_the_joined_text(spark, bucket_size):
    rng = random.Random(11)
    names = dictionary(120)
    fillers = [(n, None) for n in names]
    assert len(fillers) > TR.MANY_FILLERS
    rows = [(f"t{k}", rand_transcript(rng, 12)) for k in range(150)]
    labelled = TR.label_parts(TR.parts_from_transcripts(spark.createDataFrame(rows, "id string, transcript string")))
    got = {}
    for r in TR.filler_counts(labelled, "interviewee", fillers, bucket_size).collect():
        got.setdefault(r.id, {})[r.filler] = r.n
    assert all(set(x) == set(names) for x in got.values())
    for i, t in rows:
        text = py_parse(t)[1]
        want = regex_counts(text, names)
        assert {n: k for n, k in got.get(i, {}).items() if k} == dict(want), text
