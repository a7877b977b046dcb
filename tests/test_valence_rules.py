"""The ordered valence rules (D2) against hand-computed values and a plain walk over token lists."""

import math
import random
import re

import pytest

from convlens.operators import sentiment as S

LEXICON = {"good": 1.9, "bad": -2.5, "great": 3.1, "no": -1.2, "kind": 2.4, "heart": 1.6, "death": -2.9, "die": -2.9, "like": 1.5}

# sentence, and the sum of its valences by the published rules
TABLE = [
    ("it is good", 1.9),
    ("it is not good", 1.9 * -0.74),
    ("it is very good", 1.9 + 0.293),
    ("it is very very good", 1.9 + 0.293 + 0.293 * 0.95),
    ("it is not very good", (1.9 + 0.293) * -0.74),  # the booster first, then the negation before it
    ("very not good", 1.9 * -0.74 - 0.293 * 0.95),  # the other way round, on a sum below zero
    ("it was kind of good", 1.9 - 0.293),
    ("it is sort of bad", -2.5 - 0.293),
    ("good great", 5.0),
    ("not good great", 1.9 * -0.74 + 3.1 * -0.74),  # a lexicon word between does not shield
    ("very great good", 3.1 + 0.293 + 1.9 + 0.293 * 0.95),
    ("good but bad", 1.9 * 0.5 - 2.5 * 1.5),
    ("never so good", (1.9 + 0.293) * 1.25),  # so boosts as well
    ("without doubt good", 1.9),
    ("without any good", 1.9 * -0.74),
    ("the least good", 1.9 * -0.74),
    ("at least good", 1.9),
    ("no good", 1.9 * -0.74),
    ("I say no", -1.2),
    ("it is GOOD now", 1.9 + 0.733),
    ("IT IS GOOD", 1.9),
    ("it is VERY good", 1.9 + 0.293 + 0.733),
    ("it was the kiss of death", -1.5),
    ("she has a broken heart", -2.9),
    ("a cake to die for you", -2.9),  # an idiom counts where its valenced word stands first or last but one
    ("what a bus stop", 0.0),
    ("it isn't good", 1.9 * -0.74),
]


@pytest.mark.parametrize("sentence,total", TABLE)
def test_table_by_the_plain_walk(sentence, total):
    assert plain(sentence)[0] == pytest.approx(total, abs=1e-9)


def plain(sentence, lexicon=LEXICON, negations=S.NEGATIONS):
    """Sum of valences, and the valences."""
    words = re.findall(r"[\w']+", sentence)
    low = [w.lower() for w in words]
    booster = {w: 0.293 for w in S.BOOST_UP} | {w: -0.293 for w in S.BOOST_DOWN}
    caps = [any(c.isalpha() for c in w) and w == w.upper() for w in words]
    mixed = any(caps) and not all(caps)
    out = []
    for i, w in enumerate(low):
        if w not in lexicon or w in booster or (w == "kind" and low[i + 1 : i + 2] == ["of"]):
            out.append(0.0)
            continue
        at = lambda k: low[i - k] if i >= k else None  # noqa: B023, E731
        v = lexicon[w]
        if w == "no" and i + 1 < len(low) and low[i + 1] in lexicon:
            v = 0.0
        if at(1) == "no" or at(2) == "no" or (at(3) == "no" and at(1) in ("or", "nor")):
            v = lexicon[w] * -0.74
        if caps[i] and mixed:
            v += 0.733 if v > 0 else -0.733
        for k in (1, 2, 3):
            if i < k or at(k) in lexicon:
                continue
            if at(k) in booster:
                b = booster[at(k)] * (-1 if v < 0 else 1)
                if caps[i - k] and mixed:
                    b += 0.733 if v > 0 else -0.733
                v += b * {1: 1.0, 2: 0.95, 3: 0.9}[k]
            so = ("so", "this")
            negated = at(k) in negations or "n't" in at(k)
            if k > 1 and at(k) == "never" and any(at(j) in so for j in range(1, k)):
                v *= 1.25
            elif k > 1 and at(k) == "without" and any(at(j) == "doubt" for j in range(1, k)):
                pass
            elif negated:
                v *= -0.74
            if k == 3:
                grams = [low[i - 1 : i + 1], low[i - 2 : i + 1], low[i - 2 : i], low[i - 3 : i], low[i - 3 : i - 1]]
                found = next((S.IDIOMS[" ".join(g)] for g in grams if " ".join(g) in S.IDIOMS), None)
                for n in (2, 3):
                    g = " ".join(low[i : i + n])
                    found = S.IDIOMS[g] if len(low) >= i + n and g in S.IDIOMS else found
                v = v if found is None else found
                v += sum(booster.get(" ".join(g), 0) for g in (low[i - 3 : i - 1], low[i - 2 : i]))
        if at(1) == "least" and "least" not in lexicon and at(2) not in ("at", "very"):
            v *= -0.74
        out.append(v)
    if "but" in low:
        b = low.index("but")
        out = [v * (0.5 if i < b else 1.5 if i > b else 1) for i, v in enumerate(out)]
    return sum(out), out


def shares(sentence):
    total, values = plain(sentence)
    marks = min(sentence.count("!"), 4) * 0.292
    q = sentence.count("?")
    marks += 0 if q <= 1 else q * 0.18 if q <= 3 else 0.96
    pos = sum(v + 1 for v in values if v > 0)
    neg = sum(v - 1 for v in values if v < 0)
    n = sum(v == 0 for v in values)
    total += marks if total > 0 else -marks if total < 0 else 0
    if pos > -neg:
        pos += marks
    elif pos < -neg:
        neg -= marks
    every = pos - neg + n
    return total / math.sqrt(total * total + 15), pos / every, n / every, -neg / every


def test_rules_on_spark_equal_the_plain_walk(spark):
    rnd = random.Random(7)
    vocab = [*LEXICON, "very", "not", "never", "so", "this", "without", "doubt", "least", "at", "but", "kind", "of", "sort", "GOOD", "VERY", "a", "the", "bomb", "or", "hardly", "can't", "to", "for", "broken", "kiss", "NOT", "2", "least"]
    sentences = [s for s, _ in TABLE] + [s + "!!" for s, _ in TABLE[:5]] + ["good???", "good?? bad????"]
    sentences += [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 9))) + rnd.choice(["", "", "!", "?!?"]) for _ in range(1500)]
    df = spark.createDataFrame([(1, k, s) for k, s in enumerate(sentences)], "id long, sentence_no long, sentence string")
    got = {r.sentence_no: r for r in S.score_sentences(df, LEXICON, modifiers=True).collect()}
    for k, s in enumerate(sentences):
        assert (got[k].compound, got[k].pos, got[k].neu, got[k].neg) == pytest.approx(shares(s), abs=1e-9), s
