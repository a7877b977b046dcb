import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from convlens.llm import exact_dedup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, row int, size int, hash string, n int"


def docs(spark, rows):
    full = [(i, t, None, s, None, "x", 1, 5, "y", 9) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


ROWS = [
    (1, "a b", "s1"), (2, "a b", "s1"), (3, "a  b", "s2"), (4, None, None), (5, "", "s2"), (6, "word " * 30000, "s1"),
    (7, "word " * 30000, None), (8, "é", "S"), (9, "é", "S"), (10, "a b", "s1"), (10, "a b", "s1"),
]


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("largest", [False, True])
def test_mark_copies_brute_force(spark, weak, largest):
    # a weak hash makes every text of a length collide, which the byte comparison has to undo
    fn = (lambda t: F.unhex(F.md5(F.length(t).cast("string")))) if weak else exact_dedup.content_hash
    got = exact_dedup.mark_copies(docs(spark, ROWS), hash_fn=fn, largest=largest).collect()
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    pick = max if largest else min
    assert len(got) == len(ROWS)
    kept = defaultdict(int)
    text = {i: t or "" for i, t, _ in ROWS}
    for r in got:
        t = text[r.doc_id]
        assert (r.keep_id, r.group_size) == (pick(groups[t]), len(groups[t]))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
        kept[t] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert all(kept[t] == 1 for t in groups)


def test_drop_copies_keeps_columns_and_one_row_per_text(spark):
    d = docs(spark, ROWS)
    out = exact_dedup.drop_copies(d)
    assert out.columns == d.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t, _ in ROWS})


def test_exact_dedup_null_ids_and_empty(spark):
    d = docs(spark, [(None, "x", "s"), (None, "x", "s"), (3, "x", "s"), (None, "y", "s")])
    got = sorted((r.doc_id or -1, r.keep_id or -1, r.kept) for r in exact_dedup.mark_copies(d).collect())
    assert got == [(-1, -1, True), (-1, 3, False), (-1, 3, False), (3, 3, True)]
    assert exact_dedup.mark_copies(docs(spark, [])).count() == 0
    assert exact_dedup.drop_copies(docs(spark, [])).count() == 0


def water(total, weights, share, cap):
    """The procedure itself: clamp, re-share the excess, until none is above."""
    target = {s: 0.0 for s in total}
    open_, left = set(total), share * sum(total.values())
    while open_:
        w = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > cap * total[s]}
        if not over:
            for s in open_:
                target[s] = left * weights[s] / w
            break
        for s in over:
            target[s] = cap * total[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_targets_and_taken(spark):
    rows = [(i, "w " * (1 + i * 7 % 23), f"s{i % 5}" if i % 11 else None) for i in range(3000)]
    rows += [(10_000 + i, "w", "tiny") for i in range(3)] + [(20_000, None, "none"), (None, "w w", "s1"), (7, "w", "s2")]
    d = docs(spark, rows)
    got = mixing.mix_sizes(d).collect()
    assert len(got) == len(rows)
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += len((t or "").split())
    names = sorted((s for s in total if s is not None)) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want = water(dict(total), weights, 1.5, 2)
    taken, source = defaultdict(int), {}
    by_id = {i: s for i, _, s in rows}
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == total[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken <= 2 * r.size
        taken[s] += r.taken
        source[s] = r.target
    for s, t in source.items():
        assert abs(taken[s] - t) <= 24, (s, taken[s], t)
    assert sorted(map(tuple, mixing.mix_sizes(d).collect()), key=str) == sorted(map(tuple, got), key=str)
    # the rows of the mix are the documents as often as the sizes say
    times = {r.doc_id: r.taken // r.size for r in got if r.size and r.doc_id is not None and r.doc_id != 7}
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns
    count = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert all(count.get(i, 0) == n for i, n in times.items())


def test_mix_empty_and_without_words(spark):
    assert mixing.mix_sizes(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [])).count() == 0
    got = mixing.mix_sizes(docs(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.size, r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 2


def test_rows_of_one_id_are_mixed_one_by_one(spark):
    text = "w " * 10
    rows = [(7, text, "a")] * 15 + [(None, text, "b")] * 30 + [(None, text + "x", "b")] * 30 + [(i, "v " * 10, "c") for i in range(100, 130)] + [(8, "u " * (k + 1), "d") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sizes = [(i, len(t.split()), s) for i, t, s in rows]
    total = {s: sum(n for _, n, x in sizes if x == s) for s in "abcd"}
    target = water(total, {s: mixing.WEIGHTS[k % 3] for k, s in enumerate("abcd")}, 0.6, 2)
    got = mixing.mix_sizes(df, share=0.6).collect()
    taken = {s: 0 for s in "abcd"}
    source = {7: "a", None: "b", 8: "d"}
    for r in got:
        s = source.get(r.doc_id, "c")
        taken[s] += r.taken
        assert r.source_size == total[s] and r.target == pytest.approx(target[s]) and r.taken in (0, r.size, 2 * r.size)
    assert all(abs(taken[s] - target[s]) <= 41 for s in "abcd"), (taken, target)
    assert any(0 < target[s] < total[s] for s in "ab")
    again = mixing.mix_sizes(df.repartition(2), share=0.6).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix(df, share=0.6)
    assert mixed.columns == df.columns
    words = {s: 0 for s in "abcd"}
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    assert words == taken
