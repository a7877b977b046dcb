"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

``P(grade <= k) = sigmoid(theta_k - f(text))`` with one score ``f``, a sum of
hashed-feature weights that all grades share, and ordered thresholds.  From it
come the expected grade and the tail probability ``P(grade >= top)`` that
selects documents.

Features are the different lower-cased words and symbol runs of the whole
text, and shape features (shares of repeated, upper-case and symbol-marked
words, table bars), each hashed into ``DIMS`` weights.

The model is fitted on a bounded sample of different labelled rows (``SAMPLE``,
a documented parameter), chosen by a hash of id, text and grade.  Spark makes the
sample's features, whole texts, and counts them by grade and fold; those whose
presence depends on the grade (chi-square, in all rows or without a fold) stay,
and the driver receives them alone: ``DIMS`` counts a grade and fold, and the
informative features of ``SAMPLE`` rows.  Scoring is a map over all documents with the weights (``DIMS``
floats, 1 MB) in its closure.

Defined results: a text without a word (null, empty, only symbols) has expected grade 0 and
is rejected; with no labelled row, or a single grade, there is no model: every
document is kept and has that grade (null without any); a document with
several different labels takes part once for each; rows that repeat id, text
and grade count once; null ratings take no part.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.llm.arrow import prepare, slices
from convlens.session import cut_lineage, scratch

DIMS = 1 << 18
SAMPLE = 12_000
LEAST_DF = 4  # a feature of fewer sampled texts has weight 0
CHI = 25.0  # and so has one whose presence is not clearly related to the grade
ROUNDS = 120
DECAY = 5e-5
FOLDS = 3
KEEP = 0.999  # share of the top grade that selection has to keep, measured out of fold

_WORD = re.compile(r"\w+").findall
_MARK = re.compile(r"[^\w\s]+").findall


def _bin(share: float, steps: int = 10) -> int:
    return int(min(share, 1.0) * steps)


def features(text: str | None) -> set[str]:
    """Different words, symbol runs and shapes of a text; empty without a word."""
    words = _WORD(text) if text else []
    if not words:
        return set()
    n, marks = len(words), _MARK(text)
    out = {w.lower() for w in words}
    out.update([f"\0mark {m}" for m in set(marks)])
    out.add(f"\0repeat {_bin(sum(map(str.__eq__, words, words[1:])) / n)}")
    out.add(f"\0upper {_bin(sum(map(str.isupper, words)) / n)}")
    out.add(f"\0marks {_bin(sum(len(m) > 1 for m in marks) / n)}")
    out.add(f"\0bars {_bin(text.count(' | ') / n)}")
    out.add(f"\0different {_bin(len({*words}) / n)}" if n >= 20 else "\0short")
    return out


def hashed(text: str | None, cache: dict[str, int]) -> np.ndarray:
    found = features(text)
    out = np.empty(len(found), np.int64)
    for k, f in enumerate(found):
        h = cache.get(f)
        if h is None:
            h = crc32(f.encode("utf-8", "surrogatepass")) % DIMS
            if len(cache) < 200_000:
                cache[f] = h
        out[k] = h
    return out


@dataclass
class Model:
    weights: np.ndarray  # float32, DIMS
    theta: np.ndarray  # ordered thresholds, one fewer than grades
    cut: float  # least tail probability of a selected document

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Of every grade, rows by text."""
        below = _sigmoid(self.theta[None, :] - score[:, None])
        edges = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], 1)
        return np.diff(edges, axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def informative(by: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Features whose presence depends on the grade by a chi-square test, from counts (feature x grade) and texts by grade;
    chance words of a text bring only noise."""
    by, size = by.astype(float), size.astype(float)
    df = by.sum(1, keepdims=True)
    expected = np.maximum(df * size / size.sum(), 1e-12)
    rest = np.maximum((size.sum() - df) * size / size.sum(), 1e-12)
    chi = ((by - expected) ** 2 * (1 / expected + 1 / rest)).sum(1)
    return np.flatnonzero((df[:, 0] >= LEAST_DF) & (chi >= CHI))


def fit_ordinal(index: np.ndarray, counts: np.ndarray, grade: np.ndarray, grades: int, rounds: int = ROUNDS, decay: float = DECAY) -> Model:
    """Maximum likelihood with weight decay by Adam over the whole sample; index: features text by text."""
    by = np.bincount(index * grades + np.repeat(grade, counts), minlength=DIMS * grades).reshape(DIMS, grades)
    used = informative(by, np.bincount(grade, minlength=grades))
    place = np.full(DIMS, -1, np.int64)
    place[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(counts)), counts)
    live = place[index] >= 0
    col, row = place[index[live]], row[live]
    n, m = len(counts), len(used)
    w = np.zeros(m)
    share = np.cumsum(np.bincount(grade, minlength=grades))[:-1] / n
    share = np.clip(share, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])  # theta_0, then log gaps
    state = [np.zeros(m + len(raw)) for _ in range(2)]
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        f = np.bincount(row, weights=w[col], minlength=n)
        cdf = np.concatenate([np.zeros((n, 1)), _sigmoid(theta[None, :] - f[:, None]), np.ones((n, 1))], 1)
        k = np.arange(n)
        hi, lo = cdf[k, grade + 1], cdf[k, grade]
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        g_f = (dhi - dlo) / p / n  # of the negative log-likelihood
        g_theta = np.zeros(len(theta))
        for j in range(len(theta)):
            g_theta[j] = (-(dhi / p)[grade == j].sum() + (dlo / p)[grade == j + 1].sum()) / n
        tail = np.cumsum(g_theta[::-1])[::-1]
        g_raw = np.concatenate([tail[:1], tail[1:] * np.exp(raw[1:])])
        g = np.concatenate([np.bincount(col, weights=g_f[row], minlength=m) + decay * w, g_raw])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        step = 0.08 * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        w -= step[:m]
        raw -= step[m:]
    weights = np.zeros(DIMS, np.float32)
    weights[used] = w
    return Model(weights, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])), 0.5)


def selection_cut(
    index: np.ndarray, counts: np.ndarray, grade: np.ndarray, fold: np.ndarray, worded: np.ndarray, grades: int, folds: int = FOLDS
) -> float:
    """The tail probability that ``KEEP`` of the top grade reach in folds that their model has not seen, 0.5 at most."""
    text = np.repeat(np.arange(len(counts)), counts)
    tails = []
    for k in range(folds):
        out = fold == k
        if len(np.unique(grade[~out])) < grades or not out.any():
            continue
        model = fit_ordinal(index[~out[text]], counts[~out], grade[~out], grades)
        score = np.bincount(np.cumsum(out)[text[out[text]]] - 1, weights=model.weights[index[out[text]]], minlength=int(out.sum()))
        tails.append(model.probabilities(score)[:, -1][(grade[out] == grades - 1) & worded[out]])
    top = np.concatenate([*tails, np.zeros(0)])
    return float(min(0.5, np.quantile(top, 1 - KEEP))) if len(top) else 0.5


def sample_features(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, ...]:
    """Informative features, features per text, grades, folds and whether a text has a word, of at most about ``sample``
    different rows of the texts ``(i, t)`` with their grades ``(i, grade)``."""
    import pyarrow as pa

    def run(batches):
        cache: dict[str, int] = {}
        for batch in batches:
            out = [np.sort(hashed(t, cache)).astype("<i4").tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary()), batch.column(2)], names=["grade", "f", "h"])

    # rows are drawn by bare hashes, and only those drawn bring their texts
    named = docs.withColumn("key", F.xxhash64("i", "t"))
    rated = named.select("i", "key").join(grades, "i").select("key", "grade").distinct().withColumn("h", F.xxhash64("key", "grade"))
    rated = cut_lineage(rated)
    n = rated.count()
    if n > sample:
        rated = cut_lineage(rated.where(F.pmod("h", F.lit(1 << 20)) < F.lit(int(sample / n * (1 << 20)))))
    hashed_rows = named.join(rated, "key")
    drawn = hashed_rows.select("t", "grade", "h").mapInArrow(run, "grade int, f binary, h long")
    rows = cut_lineage(drawn.dropDuplicates(["h", "grade"]).withColumn("fold", F.pmod("h", F.lit(FOLDS)).cast("int")))

    def count(batches):
        own: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for g, f, k in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                have = own.setdefault((g, k), np.zeros(DIMS, np.int64))
                have[np.unique(np.frombuffer(f, "<i4"))] += 1
        for (g, k), have in own.items():
            used = np.flatnonzero(have)
            cols = [pa.array(np.full(len(used), g)), pa.array(np.full(len(used), k)), pa.array(used), pa.array(have[used])]
            yield pa.RecordBatch.from_arrays(cols, names=["g", "k", "f", "n"])

    sizes = rows.groupBy("grade", "fold").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, bool),)
    grades = max(r["grade"] for r in sizes) + 1
    size = np.zeros((grades, FOLDS), np.int64)
    for r in sizes:
        size[r["grade"], r["fold"]] = r["n"]
    found = rows.select("grade", "f", "fold").mapInArrow(count, "g long, k long, f long, n long").groupBy("g", "k", "f").agg(F.sum("n").alias("n")).toArrow()
    by = np.zeros((DIMS, grades, FOLDS), np.int64)
    g, k, f, c = (found.column(x).to_numpy() for x in ("g", "k", "f", "n"))
    by[f, g, k] = c
    used = np.zeros(DIMS, bool)
    used[informative(by.sum(2), size.sum(1))] = True
    for fold in range(FOLDS):  # what the model without a fold may choose
        rest = [x for x in range(FOLDS) if x != fold]
        if size[:, rest].sum():
            used[informative(by[:, :, rest].sum(2), size[:, rest].sum(1))] = True

    def pick(batches):
        for batch in batches:
            kept = [(x := np.frombuffer(f, "<i4"))[used[x]].tobytes() for f in batch.column(1).to_pylist()]
            worded = [len(f) > 0 for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), batch.column(2), batch.column(3), pa.array(worded)], names=["grade", "f", "h", "fold", "worded"]
            )

    table = rows.select("grade", "f", "h", "fold").mapInArrow(pick, "grade int, f binary, h long, fold int, worded boolean").toArrow()
    # in an order of their own, whatever order tasks end in, so that reruns agree
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("h", "f", "grade", "fold", "worded")), strict=True))
    parts = [np.frombuffer(r[1], "<i4") for r in rows]
    counts = np.array([len(x) for x in parts], np.int64)
    index = np.concatenate([*parts, np.zeros(0, "<i4")]).astype(np.int64)
    return index, counts, np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], bool)


def fit(docs: DataFrame, labels: DataFrame, grade: Column, id_col="doc_id", text_col="text", sample: int = SAMPLE) -> Model | int | None:
    """A model; or the only grade; or None without a labelled row.  ``grade``: of ``labels``, from 0, null ignored."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    given = labels.select(F.col(id_col).alias("i"), grade.cast("int").alias("grade")).where(F.col("grade") >= 0)
    with scratch(docs.sparkSession):
        index, counts, grades, fold, worded = sample_features(texts, given, sample)
    if len(grades) == 0 or grades.min() == grades.max():
        return int(grades[0]) if len(grades) else None
    # the grades of all labels, should the sample have missed the highest
    top = max(given.agg(F.max("grade")).first()[0], int(grades.max())) + 1
    model = fit_ordinal(index, counts, grades, top)
    model.cut = selection_cut(index, counts, grades, fold, worded, top)
    return model


def _grades(model: Model, texts: list[str | None], cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and tail probability of every text; 0 without a word."""
    found = [hashed(t, cache) for t in texts]
    p = model.probabilities(np.array([model.weights[x].sum(dtype=np.float64) for x in found]))
    full = np.array([len(x) > 0 for x in found])
    return np.where(full, p @ np.arange(p.shape[1]), 0.0), np.where(full, p[:, -1], 0.0)


def score(docs: DataFrame, model: Model | int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, expected_grade, tail, kept`` per row."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    if not isinstance(model, Model):
        grade = F.lit(model).cast("double")
        return docs.select(id_col, grade.alias("expected_grade"), F.lit(1.0).alias("tail"), F.lit(True).alias("kept"))
    weights, theta, cut = model.weights, model.theta, model.cut

    def run(batches):
        own, cache = Model(weights, theta, cut), {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(np.array([len(t or "") for t in texts]), 4_000_000):
                expected, tail = _grades(own, texts[a:b], cache)
                cols = [batch.column(0).slice(a, b - a), pa.array(expected), pa.array(tail), pa.array(tail >= cut)]
                yield pa.RecordBatch.from_arrays(cols, names=["i", "expected_grade", "tail", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"i {kind}, expected_grade double, tail double, kept boolean").withColumnRenamed("i", id_col)


def rating() -> Column:
    """Grades of the table ``labels``: 0 toxic, 1 poor, 2 good.  Toxic is the lowest, so that its words only ever lower a score;
    between poor and good they would have to raise it above the poor."""
    return F.when(F.coalesce("toxic", F.lit(0)) == 1, F.lit(0)).otherwise(F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2))


def drop_rejected(docs: DataFrame, model: Model | int | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rejected rows; columns unchanged.  Rows pass through Python once, nothing is shuffled."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    if not isinstance(model, Model):
        return docs
    weights, theta, cut = model.weights, model.theta, model.cut
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        own, cache = Model(weights, theta, cut), {}
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = [_grades(own, texts[a:b], cache)[1] >= cut for a, b in slices(np.array([len(t or "") for t in texts]), 4_000_000)]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    plain = docs.toDF(*[f"d{k}" for k in range(len(names))])
    return plain.mapInArrow(run, plain.schema).toDF(*names)
