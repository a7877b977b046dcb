import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from convlens.llm import chatformat, licenses, vafile


def brute_top(rows, k):
    good = [
        (i, [math.floor(1024 * np.float32(x).astype(float)) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q in sorted({i for i, _ in good if i % 100 == 0}):
        best = {}
        for a, u in good:
            for i, v in good:
                if a == q and i != q and len(u) == len(v):
                    s = sum(x * y for x, y in zip(u, v))
                    best[i] = max(best.get(i, s), s)
        for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.append((q, r, i, s))
    return out


@pytest.mark.parametrize("block,cells", [(4096, 256), (16, 4)])
def test_top_k_against_brute_force(spark, block, cells):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(420)]
    rows += [(500 + i, rows[17][1]) for i in range(30)]  # ties
    rows += [(600, None), (700, [1.0, None] * 4), (701, [float("nan")] * 8), (702, [float("inf")] * 8), (None, [1.0] * 8), (800, [])]
    rows += [(900, [0.5, 0.25]), (901, [0.1, 0.2]), (5, rows[9][1]), (100, rows[3][1]), (1000, [0.0] * 8), (1100, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v int, id string, score int")
    got = vafile.top_k(df.drop("id"), F.col("id") % 100 == 0, k=10, block=block, cells=cells, first=1).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 10)
    assert vafile.top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_large_finite_components_take_part(spark):
    rows = [(0, [1e30, 1.0]), (100, [-1e30, 2.0]), (1, [1.0, 1e30]), (2, [2.0, 3.0]), (3, [1e18, 1e17]), (200, [1e308, 1e308]), (5, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clip = lambda x: max(min(x, (1 << 63) - 1), -(1 << 63))
    whole = {i: [clip(math.floor(1024 * x)) if math.isfinite(1024 * x) else clip(int(math.copysign(1 << 64, x))) for x in v] for i, v in rows}
    got = {}
    for r in vafile.top_k(df, F.col("id") % 100 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for q in (0, 100, 200):
        scores = {i: clip(sum(a * b for a, b in zip(v, whole[q]))) for i, v in whole.items() if i != q}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 7)) and [i for _, i, _ in found] == order
        assert all(s == pytest.approx(scores[i], rel=1e-12) for _, i, s in found)


def test_copies_of_a_hot_vector_bring_k_and_one_candidates(spark, monkeypatch):
    rng = np.random.default_rng(8)
    hot = [2.0] * 8
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(1, 60)]
    rows += [(i, hot) for i in range(60, 560)] + [(505, rows[3][1]), (505, hot), (7, hot)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    scan, found = vafile.scan, []
    monkeypatch.setattr(vafile, "scan", lambda *a: found.append(scan(*a)) or found[0])
    got = vafile.top_k(df, F.col("id") % 100 == 0, k=10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 10)
    assert found[0].groupBy("query_id").count().agg(F.max("count")).first()[0] < 80


def test_vectors_are_never_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(420)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    scan, found = vafile.scan, []
    monkeypatch.setattr(vafile, "scan", lambda *a: found.append(scan(*a)) or found[0])
    got = vafile.top_k(df, F.col("id") % 100 == 0, k=10, block=16)
    assert got.count() == 50
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(found[0]) and "Broadcast" not in plan(found[0])
    assert not any("BroadcastExchange" in x and "array<" in x for x in plan(got).splitlines())


def test_copies_follow_the_blocks_and_not_the_partitions():
    assert vafile.dealing(2000, 20, 4096, 600) == (1, 1) == vafile.dealing(0, 0, 4096, 8)
    for n, asked, most in ((615384, 6156, 25), (615384, 6156, 600), (15_000_000, 150_000, 600), (10**6, 10**6, 200)):
        a, b = vafile.dealing(n, asked, 4096, most)
        assert most / 2 <= a * b or most > n / 4096
        assert a <= -(-n // 4096) and a >= n / 4096 / vafile.AT_HAND and b <= -(-asked // vafile.QUERIES)
        assert a * asked * 16 + b * n <= 9 * n * max(1, (most * asked / n) ** 0.5)


def test_an_id_in_several_blocks_counts_once():
    v = np.array([[100], [90], [50], [40], [30], [90]])
    ids = np.array([1, 1, 3, 4, 5, 0])
    grid = vafile.Grid(v.min(0), v.max(0), 256)
    block = vafile.Asked(np.array([0]), np.array([[1]]), *grid.middles(), 2)
    for part in ([0], [1], [5, 4], [2], [3]):
        block.meet(ids[part], grid.cell(v[part]))
    _, found, lower, upper = (np.concatenate(x) for x in zip(*block.candidates(), strict=True))
    assert set(found) == {1, 3} and not list(block.candidates())
    assert all(any(low <= x <= high for x in v[ids == i, 0]) for i, low, high in zip(found, lower, upper, strict=True))


@pytest.mark.parametrize("block", [7, 300])
def test_what_a_block_of_queries_keeps_holds_the_best(block):
    rng = np.random.default_rng(3)
    v, ids = rng.integers(-3000, 3000, (600, 16)), np.concatenate([np.arange(500), rng.integers(0, 500, 100)])
    grid, asked = vafile.Grid(v.min(0), v.max(0), 64), np.arange(0, 600, 9)
    held = vafile.Asked(ids[asked], v[asked], *grid.middles(), 10)
    for a in range(0, 600, block):
        held.meet(ids[a : a + block], grid.cell(v[a : a + block]))
    found = list(zip(*(np.concatenate(x) for x in zip(*held.candidates(), strict=True)), strict=True))
    pairs = {(q, i) for q, i, _, _ in found}
    assert not any(q == i for q, i in pairs) and len(pairs) < 40 * len(asked)
    for q in set(ids[asked].tolist()):
        mine = [k for k in asked if ids[k] == q]
        best = {i: max(int(v[k] @ v[j]) for k in mine for j in np.flatnonzero(ids == i)) for i in set(ids.tolist()) - {q}}
        kth = sorted(best.values())[-10]
        assert all((q, i) in pairs for i, x in best.items() if x >= kth)


def test_bounds_hold_the_score():
    rng = np.random.default_rng(1)
    v = rng.integers(-3000, 3000, (300, 16))
    grid = vafile.Grid(v.min(0), v.max(0), 8)
    low, high = grid.borders(grid.cell(v))
    assert (low <= v).all() and (v <= high).all()


@pytest.mark.parametrize("top", [1, 3, 255, 256, 257, 70_000, 1 << 40, 1 << 56, (1 << 63) - 1])
def test_middles_reach_every_value(top):
    rng = np.random.default_rng(2)
    x = np.concatenate([[0, top, -top, top - 1], rng.integers(-top, top, 3000)])
    v = np.stack([x, np.abs(x), np.full(len(x), top)], axis=1)
    grid = vafile.Grid(v.min(0), v.max(0), 256)
    middle, reach = grid.middles()
    cell = grid.cell(v)
    for j in range(3):
        wide = [abs(int(a) - int(b)) for a, b in zip(v[:, j], middle[cell[:, j], j], strict=True)]
        assert max(wide) <= int(reach[j]) + 1 and reach[j] <= grid.width[j] / 256 + 2 + top * 1e-14


LICENSE_ROWS = [
    "", None, "Released under the MIT License.", "mit\nlicense MIT-License mit licenses", "Apache License, Version 2.0",
    "Licensed under the Apache License, Version 2.0; see CC BY 4.0 or CC-BY", "gnu GENERAL public license version 3",
    "This work is licensed under the GNU General Public License, version 3.", "gnu gnu general public license mit mit license",
    "cc by cc by cc by", "x " * 50000 + "mit license", "Éapache license", "by cc", "license mit",
]


def test_license_base_places(spark):
    df = spark.createDataFrame([(k, t, 1, "f") for k, t in enumerate(LICENSE_ROWS)] + [(None, "mit license", 1, "f"), (2, LICENSE_ROWS[2], 1, "f")], "doc_id long, text string, w int, f string")
    got = licenses.scan(df).collect()
    assert len(got) == len(LICENSE_ROWS) + 2
    phrases = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
    for r in got:
        t = "mit license" if r.doc_id is None else LICENSE_ROWS[r.doc_id] or ""
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
        at, labels = [], set()
        for label, p in phrases.items():
            p = p.split()
            here = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(labels))
        assert labels <= set(r.labels.split(",")) | set() if labels else True
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    by = {r.doc_id: r for r in got}
    assert "apache-2.0" in by[5].labels and "gpl-3.0" in by[7].labels and "mit-notice" in by[2].labels
    assert "apache-2.0" not in by[4].labels.split(",") and by[10].first_word == 50000
    assert licenses.scan(df.limit(0)).count() == 0


def test_anchors_decide_the_work_not_the_result(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(LICENSE_ROWS)], "doc_id long, text string")
    t = licenses.Template.of("x", "general public license", "public license")
    assert licenses.anchors(t, {"public": 5, "license": 1}) == [("license", 2), ("public", 1)]
    a = licenses.scan(df).orderBy("doc_id").collect()
    b = licenses.scan(df.unionByName(df.where("doc_id > 5"))).where("doc_id <= 5").orderBy("doc_id").collect()
    assert a[:6] == b


def test_chat_examples_read_back(spark):
    control = "<|im_end|><|im_start|>assistant ok"
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yo\n<|im_end|>\n"), (1, 2, "user", None), (1, 3, "assistant", "&lt;|&amp;<"), (1, 4, "user", "bye"),
        (2, 0, "user", control), (2, 1, "assistant", control), (3, None, None, ""), (3, 5, "a<|b\nc&#10;", "x"), (4, 0, "assistant", ""),
        (None, 0, "assistant", "null"), (5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (6, 0, "user", "only"), (7, 0, "assistant", "long " * 20000),
    ]
    df = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, o int, example string")
    ex = chatformat.format_examples(df)
    for r in ex.where("conv_id = 1").collect():
        assert r.text.count("<|im_start|>") == r.example + 1
    assert ex.where("conv_id = 1").count() == 3
    got = {r.conv_id: r for r in chatformat.read_back(ex).collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == c))
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(own), sha)
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chatformat.read_back(chatformat.format_examples(df.limit(0))).count() == 0


def test_words_equal_the_pattern(spark):
    texts = [None, "", " ", "a", " a", "a ", "..", "MIT License", "é À 漢字 😀x", "a\x00b\x7fc", "x" * 1000 + "," * 1000, "1.2-3_4`5{6", "Kelvin K"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, r in zip(texts, df.select(licenses.words_of(F.col("t")).alias("w")).collect(), strict=True):
        low = (t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER))
        assert r.w == re.findall(licenses.WORD, low)
