import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from convlens.llm import periodic, pii, whitening

SF = "/root/testdata/sf0.01"


# ---- whitening


def vector_rows():
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(150, 6)) * [1, 2, 3, 0.5, 0.2, 0.7])]
    rows += [(200 + k, rows[7][1]) for k in range(40)] + [(5, rows[9][1]), (None, rows[3][1])]
    rows += [(300, None), (301, [1.0, None] * 3), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (304, [])]
    return rows


SCHEMA = "vec_id long, embedding array<double>, y string, i int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "z") for i, v in rows], SCHEMA)


def whole_vectors(rows):
    ok = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    return [(i, tuple(math.floor(64 * Fraction(x)) + 1_000_000 for x in v)) for i, v in ok]


def check_whitening(got, x, atol=1e-9):
    different = sorted({v for _, v in x})
    n, d = len(different), len(x[0][1])
    sums = [sum(v[j] for v in different) for j in range(d)]
    m = [[float(Fraction(sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in different), n**3)) for b in range(d)] for a in range(d)]
    values, vectors = np.linalg.eigh(np.array(m))
    values, vectors = values[::-1], vectors[:, ::-1]
    want = {}
    for i, v in x:
        middle = np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums)])
        deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
        want.setdefault((i, deviation), []).append(middle @ vectors / np.sqrt(np.maximum(values, 1e-300)))
    rows = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert r.deviation == (int(r.deviation_digits) if int(r.deviation_digits) < 1 << 63 else None)
        rows.setdefault((r.vec_id, int(r.deviation_digits)), []).append((r.component, r.whitened))
    assert rows.keys() == want.keys()
    for key, found in rows.items():
        for c, w in found:
            assert abs(w) == pytest.approx(abs(want[key][0][c - 1]), abs=atol)
        assert len(found) == len(want[key]) * max(c for c, _ in found)


def test_whitening_against_exact_sums_and_an_eigensolver(spark):
    rows = vector_rows()
    got = whitening.whiten(frame(spark, rows), components=4).collect()
    check_whitening(got, whole_vectors(rows))
    assert {r.component for r in got} == {1, 2, 3, 4}
    sign = {}
    for r in got:  # equal vectors get equal values, so one sign serves all rows
        sign.setdefault((r.deviation_digits, r.component), set()).add(r.whitened)
    assert all(len(s) == 1 for s in sign.values())


def test_whitening_of_large_entries_stays_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 3)) * [1e30, 3e29, 1e12])]
    x = whole_vectors(rows)
    got = whitening.whiten(frame(spark, rows)).collect()
    assert all(r.deviation is None for r in got)
    check_whitening([r for r in got if r.component < 3], x, 1e-6)


def test_whitening_ranks_lengths_and_empty_tables(spark):
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(6)]  # rank one
    assert {(r.vec_id, r.component) for r in whitening.whiten(frame(spark, flat)).collect()} == {(i, 1) for i in range(6)}
    mixed = flat + [(i, [float(i % 3), float(i)]) for i in range(10, 20)]
    got = whitening.whiten(frame(spark, mixed)).collect()
    assert {r.n for r in got if r.vec_id < 10} == {6} and {r.n for r in got if r.vec_id >= 10} == {10}
    assert max(r.component for r in got if r.vec_id >= 10) == 2
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    assert whitening.whiten(frame(spark, []).limit(0)).count() == 0


def test_repeated_roots_keep_orthonormal_components(spark):
    points = [(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-2, 2)]  # roots 2 and twice 1
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(points)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert [round(r.explained, 12) for r in got if r.vec_id == 0] == [round(x, 12) for x in (4 / 6, 1 / 6, 1 / 6)]
    assert all(r.identity_error < 1e-12 for r in got)


def test_characteristic_polynomial_and_roots(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(-9, 9, (12, 5))
    m = np.array([[int(x) for x in row] for row in y.T @ y], object)
    e = whitening.characteristic(spark, m)
    want = np.poly(m.astype(float))
    assert [round(float((-1) ** k * want[k]) / max(e[k], 1), 6) for k in range(6)] == [1.0] * 6
    zero = np.zeros((3, 3), object)
    assert whitening.characteristic(spark, zero) == [1, 0, 0, 0]
    roots = [whitening.narrow(e, *x) for x in whitening.isolate(e, 5)]
    assert np.allclose([float(r) for r in roots], np.linalg.eigvalsh(m.astype(float))[::-1], rtol=1e-12)
    # (x - 3)**2 (x - 5): a double root is one interval of two
    found = whitening.isolate([1, 11, 39, 45], 3)
    assert [x[3] for x in found] == [1, 2]
    assert float(whitening.narrow([1, 11, 39, 45], *found[1])) == pytest.approx(3, abs=1e-25)


# ---- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_matches(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(reversed(digits)))
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and doubled % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_patterns_equal_plain_regular_expressions():
    rnd = random.Random(3)
    parts = ["a", "b.c", "@", "@@", "x@y", ".", "..", "-", "1", "25", "999", "0.0.0.255", "1.2.3.4.5", "+", "+1 ", "(2", ") ", " ", "\n", "4539 ", "é", "%", "_", "00", "4111111111111111", "-7"]
    for _ in range(20_000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert pii.matches(text)[0] == plain_matches(text), text


def pii_docs():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    filler = lambda: " ".join(word() for _ in range(rnd.randint(2, 9)))

    def card():
        head = "4" + "".join(rnd.choice("0123456789") for _ in range(14))
        return next(head + c for c in "0123456789" if pii.luhn(head + c))

    phone = lambda: f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}"
    rows = []
    for i in range(300):
        kind = rnd.choice([card, phone, lambda: f"{word()}.{rnd.randint(10, 99)}@m.example.com", lambda: f"10.{rnd.randint(0, 255)}.3.{rnd.randint(0, 9)}", lambda: f"v{rnd.randint(1, 9)} {rnd.randint(1, 2000)}"])
        rows.append((i, f"{filler()} {kind()} {filler()}"))
    return rows, card, phone, filler


def test_field_adds_what_patterns_drop_and_leaves_clean_texts(spark):
    rows, card, phone, filler = pii_docs()
    a, b, c = phone(), card(), card()
    number = re.sub("[^0-9]", "", a)[1:]
    rows += [(1000, f"{filler()} {a} {b} {filler()}"), (1001, f"{b} {a} {c}"), (1002, f"{filler()} 2024 items, page 17 of 300\n"), (1003, None), (1004, ""), (1005, "no digits at all " * 50_000)]
    rows += [(1006, f"{filler()} {a} {filler()} {number} {filler()}"), (1006, rows[0][1]), (1007, "1 " * 40_000), (1008, "7" * 200_000 + "a" * 200_000 + "@")]
    df = spark.createDataFrame([(i, t, "k", 5) for i, t in rows], "doc_id long, text string, kind string, spans int")
    field = pii.fit(df)
    found = pii.find(df, field).collect()
    got = {(r.doc_id, tuple(map(tuple, r.base))): r for r in found}
    assert len(found) == len(rows)
    for i, t in rows:
        want = plain_matches(t or "") if i not in (1007, 1008) else []
        r = got[i, tuple(want)]
        assert set(want) <= {tuple(s) for s in r.spans}
        for s in r.spans:
            assert pii.valid(s.kind, t[s.begin : s.end])
        if i < 300:
            assert [tuple(s) for s in r.spans] == want  # nothing to add
    by = {r.doc_id: [(s.kind, dict(rows)[r.doc_id][s.begin : s.end]) for s in r.spans] for r in found if r.doc_id in (1000, 1001, 1002)}
    assert by[1000] == [("card", b), ("phone", a)] and sorted(by[1001]) == sorted([("card", b), ("card", c), ("phone", a)]) and by[1002] == []


def test_skip_factors_carry_a_label_to_a_resembling_token(spark):
    rows, _, phone, filler = pii_docs()
    field = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    a = phone()
    number = re.sub("[^0-9]", "", a)[1:]
    text = f"abc {a} efg hij {number} klm"
    t = pii.tokens(text)
    lens = np.array([y - x for x, y in pii._chains(t.joined)])
    features = np.array(t.features)
    groups = pii._groups(t.keys)
    assert [[text[slice(*t.places[k])] for k in g] for g in groups] == [[a.split()[-1], number]]
    alone = field.beliefs(features, lens, [])
    joined = field.beliefs(features, lens, groups)
    at = groups[0][1]
    of_phone = lambda b: b[at, pii.KIND_OF == 4].sum()
    assert of_phone(alone) < 0.5 < of_phone(joined)
    spans = pii.find(spark.createDataFrame([(1, text), (2, text.replace(a, "none"))], "doc_id long, text string"), field).orderBy("doc_id").collect()
    assert [[text[s.begin : s.end] for s in r.spans] for r in spans] == [[a, number], []]


def test_beliefs_equal_sums_over_all_labellings():
    rng = np.random.default_rng(5)
    n = len(pii.LABELS)
    move, begin = pii._allowed()
    move = np.where(move < 0, move, rng.normal(size=(n, n)))
    names = np.arange(6)
    field = pii.Field(names, np.concatenate([rng.normal(size=(6, n)), np.zeros((1, n))]), move, begin, 1.7)
    features = rng.integers(0, 7, (4, 2))  # 6 is unknown
    # one chain of three and one of a single token, a group across them: without a loop the result is exact
    got = field.beliefs(features, np.array([3, 1]), [[1, 3]])
    own, want = field.own(features), np.zeros((4, n))
    kinds = pii.KIND_OF
    for y in np.ndindex(n, n, n, n):
        s = sum(own[k, y[k]] for k in range(4)) + begin[y[0]] + begin[y[3]] + move[y[0], y[1]] + move[y[1], y[2]]
        weight = sum(np.exp(1.7 * (kinds[y[1]] == g) + 1.7 * (kinds[y[3]] == g)) for g in range(5))
        want[np.arange(4), y] += np.exp(s) * weight
    assert np.allclose(got, want / want.sum(1, keepdims=True), atol=1e-9)


def test_pii_without_a_match_or_a_row(spark):
    df = spark.createDataFrame([(1, "nothing 12 here"), (2, None)], "doc_id long, text string")
    assert pii.fit(df) is None
    assert [len(r.spans) for r in pii.find(df, None).collect()] == [0, 0]
    empty = df.limit(0)
    assert pii.fit(empty) is None and pii.find(empty, None).count() == 0
    r = pii.digest(pii.find(df, None)).first()
    assert r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == "" and r.n_card == 0


# ---- periodic runs


def brute_runs(w, least):
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= 2 * q:
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items() if e - s >= least)


def sequences():
    rnd = random.Random(1)
    a, b = "a", "ab"
    while len(b) < 500:
        a, b = b, b + a
    out = [list(b), [], ["a"], list("ab" * 30), list((("ab" * 20 + "a") * 4 + "c") + ("ab" * 9 + "a") * 5), list((("aab" * 10 + "aa") * 2 + "b") * 3)]
    out += [list(("ab" * k + "a") * 2) for k in range(14)]
    out += [list(((("a" * k + "b") * 4 + "a") * 3 + "b") * 2) for k in range(1, 9)]
    for _ in range(500):
        n, letters = rnd.choice([1, 5, 20, 60, 150, 300]), rnd.choice([1, 2, 2, 3, 5])
        w = [rnd.choice("abcde"[:letters]) for _ in range(n)]
        for _ in range(rnd.randint(0, 4)):
            s, p = rnd.randrange(n), rnd.randint(1, max(1, n // 3))
            for i in range(s + p, min(n, s + rnd.randint(1, n))):
                w[i] = w[i - p]
        out.append(w)
    return out


@pytest.mark.parametrize("least", [2, 12])
def test_runs_against_brute_force(least):
    words = sequences()
    for got, w in zip(periodic.find_runs(words, least), words, strict=True):
        assert [tuple(map(int, r)) for r in got] == brute_runs(w, least), "".join(w)


def test_runs_survive_colliding_hashes(monkeypatch):
    words = sequences()[:40]
    want = periodic.find_runs(words)
    search, equal, seeds = periodic._search, periodic._Prefixes.equal, []

    def watched(ids, begin, lens, seed):
        seeds.append(seed)
        return search(ids, begin, lens, seed)

    # with the first seed, every two stretches of three or six words collide
    monkeypatch.setattr(periodic, "_search", watched)
    monkeypatch.setattr(periodic._Prefixes, "equal", lambda self, i, j, n: equal(self, i, j, n) | ((n % 3 == 0) & (n < 9) & (seeds[-1] == 0)))
    got = periodic.find_runs(words)
    assert seeds == [0, 1] and all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def repeat(doc_id, words):
    """The repetition that the query plants."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_digests_against_brute_force(spark):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice("abcd") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 150))) for _ in range(150)]
    texts += [None, "", " \t\n ", "x " * 40, "é ñ " * 20, "p q r s t " * 300]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[3]), (5, texts[9]), (5, texts[9])]
    df = spark.createDataFrame([(i, t, 1, [2], "c") for i, t in rows], "doc_id long, text string, n_words int, runs array<int>, collapsed string")
    got = sorted((tuple(r) for r in periodic.digest(periodic.periodic_runs(periodic.planted(df))).collect()), key=str)
    want = []
    for i, t in rows:
        w = repeat(i, re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        runs = brute_runs(w, 12)
        keep = [not any(s + q <= k < s + n for s, n, q in runs) for k in range(len(w))]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        listing = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = " ".join(x for x, k in zip(w, keep) if k)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listing), sha(kept)))
    assert got == sorted(want, key=str)
    assert periodic.periodic_runs(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    text = " ".join(str(k * k % 1009) for k in range(60_000))  # period 1009, found at a high scale
    r = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] and max(x.length for x in r.runs) == 60_000 and r.n_words == 60_000
    assert {x.period for x in r.runs if x.length == 60_000} == {1009}
