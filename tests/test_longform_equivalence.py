"""Property test: the long-form (parts) features equal brute force on whole strings.

Random transcripts are built from labels, bars, fillers, punctuation and
whitespace; a plain-Python implementation of the semantics (split on '|',
label test after strip, replace the label everywhere, join by one space)
is the brute-force reference.
"""

import random
import re

import pytest

from convlens.functions import text as T
from convlens.operators import transcripts as TR

WORDS = ["you", "know", "uh", "uhh", "um", "like", "i", "mean", "so", "kind", "of", "Élan", "x.", "y!", "z?", "Interviewer:", "Interviewee:"]
SEPS = [" ", "  ", "\n", " . ", "! ", "? "]


def rand_transcript(rng: random.Random, max_turns: int = 6) -> str:
    turns = []
    for _ in range(rng.randint(0, max_turns)):
        label = rng.choice(["Interviewer: ", "Interviewee: ", "", "  Interviewee:", " "])
        body = "".join(rng.choice(WORDS) + rng.choice(SEPS) for _ in range(rng.randint(0, 8)))
        turns.append(label + body)
    return "|".join(turns)


def py_parse(t: str):
    er, ee = [], []
    for part in t.split("|"):
        s = part.strip()
        if s.startswith("Interviewer:"):
            er.append(part.replace("Interviewer:", "").strip())
        elif s.startswith("Interviewee:"):
            ee.append(part.replace("Interviewee:", "").strip())
    return " ".join(er), " ".join(ee)


def py_fillers(text: str) -> int:
    low = text.lower()
    total = 0
    for name, pattern in T.DEFAULT_FILLERS:
        rx = pattern if pattern is not None else r"\b" + re.escape(name) + r"\b"
        total += len(re.findall(rx, low))
    return total


def py_sentences(t: str):
    cleaned = [re.sub(r"Interviewee:\s*", "", re.sub(r"Interviewer:\s*", "", p)) for p in t.split("|")]
    full = " ".join(cleaned)
    pieces = re.sub(r"([.!?])\s+", "\\1\u0001", full).split("\u0001")
    return [(i, p.strip()) for i, p in enumerate(pieces) if p.strip()]


@pytest.mark.parametrize("bucket_size,n_turns", [(4096, 6), (2, 40)])
def test_parts_features_equal_brute_force(spark, bucket_size, n_turns):
    """bucket_size=2 with long transcripts spreads every transcript over many
    buckets, the path a very large conversation takes."""
    rng = random.Random(7 + bucket_size)
    rows = [(f"t{i}", rand_transcript(rng, n_turns)) for i in range(300 if n_turns < 10 else 60)]
    df = spark.createDataFrame(rows, "id string, transcript string")
    parts = TR.parts_from_transcripts(df)
    feats = {r["id"]: r for r in TR.transcript_features(parts, bucket_size=bucket_size).collect()}
    texts = {r["id"]: r for r in TR.speaker_texts(TR.label_parts(parts)).collect()}
    rowwise = {r["id"]: r for r in TR.parse_transcript(df).collect()}
    rowfeats = {r["id"]: r for r in TR.transcript_features_rowwise(df).collect()}
    sents: dict = {}
    for r in TR.sentence_table(parts, bucket_size).collect():
        sents.setdefault(r["id"], []).append((r["sentence_no"], r["sentence"]))
    for rid, t in rows:
        er, ee = py_parse(t)
        f = feats[rid]
        assert (texts[rid]["interviewer_text"], texts[rid]["interviewee_text"]) == (er, ee), t
        assert (rowwise[rid]["interviewer_text"], rowwise[rid]["interviewee_text"]) == (er, ee), t
        assert f["interviewer_length"] == len(er) and f["interviewee_length"] == len(ee), t
        assert f["interviewer_words"] == len(er.split()) and f["interviewee_words"] == len(ee.split()), t
        assert f["filler_hits"] == py_fillers(ee), (t, ee)
        assert rowfeats[rid].asDict() == f.asDict(), t
        assert sorted(sents.get(rid, [])) == py_sentences(t), t
