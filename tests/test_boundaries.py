"""Learned sentence boundaries against a plain version of the same method."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from convlens.operators import boundaries as B

CLOSE = "\"')]"


def plain_type(t):
    bare = re.sub(r"^[\W_]+|[\W_]+$", "", t.lower())
    return B.NUMBER if re.match(r"^-?[.,]?[0-9][0-9,.\-]*$", bare) else bare


def marks(t):
    t = t.rstrip(CLOSE)
    return t.endswith("."), t[-1:] in "!?" and bool(t), bool(re.match(r"^[\"'(\[]*[^\W\d_]\.$", t))


def case(t):
    m = re.match(r"^[\"'(\[]*([^\W\d_])", t)
    c = m[1] if m else ""
    return bool(c) and c == c.upper() != c.lower(), bool(c) and c == c.lower() != c.upper(), bool(c)


def log(x):
    return math.log(max(x, 1e-300))


def association(a, b, ab, n):
    p, p1, p2 = b / n, ab / a, 1.0 if n == a else (b - ab) / (n - a)
    one = ab * log(p) + (a - ab) * log(1 - p)
    two = (b - ab) * log(p) + (n - a - b + ab) * log(1 - p)
    three = 0 if a == ab else ab * log(p1) + (a - ab) * log(1 - p1)
    four = 0 if b == ab else (b - ab) * log(p2) + (n - a - b + ab) * log(1 - p2)
    return -2 * (one + two - three - four)


def plain_train(texts):
    tokens = [t.split() for t in texts if t]
    with_p, without = Counter(), Counter()
    for ts in tokens:
        for t in ts:
            if plain_type(t):
                (with_p if marks(t)[0] else without)[plain_type(t)] += 1
    every = set(with_p) | set(without)
    n, p = sum(with_p.values()) + sum(without.values()), sum(with_p.values())
    abbr = set()
    for t in every:
        if not with_p[t] or t == B.NUMBER or not re.search(r"[^\W\d_]", t):
            continue
        a, ab = with_p[t] + without[t], with_p[t]
        ll = -2 * (ab * log(p / n) + (a - ab) * log(1 - p / n) - ab * math.log(0.99) - (a - ab) * math.log(0.01))
        inner = len(t.replace(".", ""))
        if ll * math.exp(-inner) * (len(t) - inner + 1) * inner ** -float(without[t]) >= B.ABBREVIATION:
            abbr.add(t)
    cases, at_break, pairs, breaks_n = defaultdict(set), Counter(), Counter(), 0
    for ts in tokens:
        for k, t in enumerate(ts):
            a = ts[k - 1] if k else ""
            period, other, initial = marks(a)
            first, second, (up, low, alpha) = plain_type(a) if period else None, plain_type(t), case(t)
            breaks = k > 0 and ((other and not period) or (period and first not in abbr))
            place = "first" if breaks or not k else "unknown" if period else "inside"
            breaks_n += breaks
            if second:
                cases[second] |= {x for x, y in (("lower", low), ("upper_inside", up and place == "inside"), ("upper", up), ("lower_first", low and place == "first")) if y}
            special = (period and initial) or first == B.NUMBER
            if breaks and not special and alpha:
                at_break[second] += 1
            if breaks and special and second:
                pairs[first, second] += 1
    count = lambda t: with_p[t] + without[t]
    starters = {t for t, ab in at_break.items() if t in every and association(breaks_n, count(t), ab, n) >= B.STARTER and n / breaks_n > count(t) / ab}
    joined = {
        (a, b) for (a, b), ab in pairs.items()
        if ab > 1 and a in every and b in every and association(count(a), count(b), ab, n) >= B.COLLOCATION and n / count(a) > count(b) / ab
    }
    return abbr, starters, joined, cases


def plain_split(text, model):
    abbr, starters, joined, cases = model
    pieces = re.sub(r"([.!?][\"')\]]*)(\s+)", "\\1\u0001\\2", text).split("\u0001")
    out, now = [], ""
    for k, piece in enumerate(pieces):
        now += piece
        a = (piece.split() or [""])[-1]
        b = (pieces[k + 1].split() or [""])[0] if k + 1 < len(pieces) else ""
        period, other, initial = marks(a)
        first, second, (up, low, _) = plain_type(a), plain_type(b), case(b)
        c = cases.get(second, set())
        starts = None
        if not re.search(r"[^\W_]", b):
            starts = False
        elif up and "lower" in c and "upper_inside" not in c:
            starts = True
        elif low and ("upper" in c or "lower_first" not in c):
            starts = False
        counted = initial or first == B.NUMBER
        if other and not period:
            ends = True
        elif (first, second) in joined:
            ends = False
        elif first in abbr and not initial:
            ends = bool(starts) or (up and second in starters)
        elif counted and starts is False:
            ends = False
        elif counted and initial and starts is None and up and "lower" not in c:
            ends = False
        elif first in abbr:
            ends = bool(starts)
        else:
            ends = True
        if ends:
            out.append(now)
            now = ""
    out.append(now)
    return [(k, s.strip()) for k, s in enumerate(out) if s.strip()]


def corpus():
    rnd = random.Random(4)
    names = ["Smith", "Jones", "Meyer", "Okoro"]
    nouns = ["house", "river", "paper", "music", "train", "garden", "letter"]
    verbs = ["saw", "left", "wrote", "found", "heard"]

    def sentence():
        who = rnd.choice([f"Dr. {rnd.choice(names)}", f"Prof. {rnd.choice(names)}", f"J. {rnd.choice(names)}", "The man", "She", "Yesterday she"])
        what = rnd.choice([f"the {rnd.choice(nouns)}", f"a {rnd.choice(nouns)}, i.e. the {rnd.choice(nouns)}", f"No. {rnd.randint(1, 90)}", f"the {rnd.choice(nouns)} on the 3. {rnd.choice(['May', 'June'])}"])
        return f"{who} {rnd.choice(verbs)} {what}{rnd.choice(['.', '.', '.', '!', '?'])}"

    texts = [" ".join(sentence() for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    return texts + [None, "", "   ", "no end here", 'He said "Go." Then she left.\nThe   man wrote.', "... and so on. . ."]


@pytest.fixture(scope="module")
def learned(spark):
    df = spark.createDataFrame(list(enumerate(corpus())), "id long, text string")
    return df, B.train(df)


def test_model_equals_the_plain_version(learned):
    _, model = learned
    abbr, starters, joined, cases = plain_train(corpus())
    assert {r.type for r in model.abbreviations.collect()} == abbr
    assert {"dr", "prof", "i.e"} <= abbr and not abbr & {"house", "river", "garden"}
    assert {r.type for r in model.starters.collect()} == starters and starters
    assert {(r.first, r.second) for r in model.collocations.collect()} == joined
    got = {r.type: {c for c in ("lower", "upper_inside", "upper", "lower_first") if r[c]} for r in model.cases.collect()}
    assert got == dict(cases)


def test_split_equals_the_plain_version(learned):
    df, model = learned
    want = plain_train(corpus())
    got = defaultdict(list)
    for r in B.split(df, model).collect():
        got[r.id].append((r.sentence_no, r.sentence))
    for k, text in enumerate(corpus()):
        assert sorted(got[k]) == (plain_split(text, want) if text else []), text


def test_abbreviations_and_initials_do_not_split(spark, learned):
    _, model = learned
    texts = ["Dr. Smith saw the house. She left.", "J. Meyer wrote the paper, i.e. the letter. The man left!", "Prof. Okoro heard No. 7. The train left."]
    rows = B.split(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), model).orderBy("id", "sentence_no").collect()
    by = {k: [r.sentence for r in rows if r.id == k] for k in range(3)}
    assert by[0] == ["Dr. Smith saw the house.", "She left."]
    assert by[1] == ["J. Meyer wrote the paper, i.e. the letter.", "The man left!"]
    assert by[2][0].startswith("Prof. Okoro") and by[2][-1] == "The train left."


def test_empty_corpus(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "id long, text string")
    assert B.split(df, B.train(df)).count() == 0
