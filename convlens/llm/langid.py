"""Language identification of mixed-language text.

A word is a run of letters with the marks that follow them.  Its script (by code-point range) leaves as
candidates the languages that were seen with that script; every candidate
scores the word by hashed character n-grams; Viterbi over a document's words
with a penalty for switching labels spans of one language each.

The model is learned from labelled texts: n-gram counts by language over whole
texts, aggregated by Spark.  The number of labelled rows is bounded by
``ROWS`` (a documented parameter): up to a level that all languages share, a
language brings all its rows, above it rows chosen by a hash of id and text,
and one at least, so that every labelled language is learned whatever its
share of the table.  The size of the model is bounded by ``languages * DIMS`` numbers; that is all the driver receives.

Defined results: a text that is null or has no letter (digits, number signs and
marks alone are none) is ``und`` with score 0 and no spans; a word in a script that no language was seen with follows its
neighbours; ties go to the language first in code-point order; without a
labelled text every document is ``und``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.llm.arrow import prepare, slices

DIMS = 1 << 17
ROWS = 20_000
ORDERS = (1, 2, 3, 4)
PENALTY = 6.0
WORDS_AT_ONCE = 20_000
LEAST = 0.002  # share of a language's words from which a script counts as seen

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")

#: Script ranges: name, first and last code point.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("syriac", 0x0700, 0x074F), ("arabic", 0x0750, 0x077F),
    ("thaana", 0x0780, 0x07BF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F),
    ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF), ("thai", 0x0E00, 0x0E7F),
    ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F), ("cherokee", 0x13A0, 0x13FF), ("khmer", 0x1780, 0x17FF),
    ("mongolian", 0x1800, 0x18AF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
NAMES = ("other", *dict.fromkeys(s for s, _, _ in SCRIPTS))


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """Number of the script of every code point; 0 where no range holds it."""
    first = np.array([a for _, a, _ in SCRIPTS])
    last = np.array([b for _, _, b in SCRIPTS])
    name = np.array([NAMES.index(s) for s, _, _ in SCRIPTS])
    k = np.searchsorted(first, codes, "right") - 1
    return np.where((k >= 0) & (codes <= last[np.maximum(k, 0)]), name[np.maximum(k, 0)], 0)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of the words with their ends marked: buckets, n-grams per word, script and letters per word."""
    marked = "".join([f"\x02{w}\x03" for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.int64)
    lens = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lens + 2)
    begin = ends - lens - 2
    stop = np.repeat(ends, lens + 2)
    at = np.arange(len(codes))
    buckets, owner = [], []
    word = np.repeat(np.arange(len(words)), lens + 2)
    for n in ORDERS:
        ok = at + n <= stop
        if n == 1:
            ok = ok & (codes > 3)
        i = at[ok]
        h = np.full(len(i), n, np.uint64)
        for j in range(n):
            h = (h ^ codes[i + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        buckets.append((h % np.uint64(DIMS)).astype(np.int64))
        owner.append(word[i])
    bucket, own = np.concatenate(buckets), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return bucket[order], np.bincount(own, minlength=len(words)), scripts_of(codes[begin + 1]), lens


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # DIMS x languages
    seen: np.ndarray  # scripts x languages

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores (words x languages) and letters of every word."""
        if not words:
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64)
        parts = [self._scores(words[k : k + WORDS_AT_ONCE]) for k in range(0, len(words), WORDS_AT_ONCE)]
        return np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])

    def _scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        bucket, counts, script, lens = grams(words)
        at = np.cumsum(counts) - counts
        out = np.stack([np.add.reduceat(self.logp[bucket, j], at) for j in range(len(self.langs))], 1) / len(ORDERS)
        allowed = self.seen[script]
        out = np.where(allowed | ~allowed.any(1, keepdims=True), out, -1e6)
        out[~allowed.any(1)] = 0
        return out.astype(np.float32), lens


def level(sizes: list[int], rows: int) -> float:
    """Rows that each language may bring, so that together they bring ``rows`` or all they have."""
    left = float(rows)
    for k, n in enumerate(sorted(sizes)):
        each = left / (len(sizes) - k)
        if n > each:
            return each
        left -= n
    return float("inf")


def fit(docs: DataFrame, use: Column, id_col="doc_id", text_col="text", lang_col="lang", rows: int = ROWS) -> Model | None:
    """Learn from the text and non-null language of the rows for which ``use`` holds."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    given = docs.where(use & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.col(id_col).alias("i")
    )
    given = given.withColumn("h", F.pmod(F.xxhash64("i", "t"), F.lit(1 << 40)))
    sizes = given.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("least")).collect()
    each = level([r["n"] for r in sizes], rows)
    bounds = [(r["l"], max(int(each / r["n"] * (1 << 40)), r["least"] + 1)) for r in sizes if r["n"] > each]
    if bounds:
        # a condition, not a join: texts stay where they are, however few languages there are
        bound = F.create_map(*[F.lit(x) for r in bounds for x in r])
        given = given.where(F.coalesce(F.col("h") < F.element_at(bound, F.col("l")), F.lit(True)))

    def run(batches):
        # counts of one task by language; the last places count words by script
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            texts = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in set(langs):
                have = own.setdefault(lang, np.zeros(DIMS + len(NAMES), np.int64))
                part = texts[langs == lang]
                for a, b in slices(np.array([len(t) for t in part]), 2_000_000):
                    index: dict[str, int] = {}
                    order = [index.setdefault(w, len(index)) for t in part[a:b] for w in _WORD.findall(t.lower())]
                    if not order:
                        continue
                    times = np.bincount(np.array(order), minlength=len(index))
                    words = list(index)
                    for k in range(0, len(words), WORDS_AT_ONCE):
                        bucket, counts, script, _ = grams(words[k : k + WORDS_AT_ONCE])
                        n = times[k : k + WORDS_AT_ONCE]
                        have += np.bincount(bucket, weights=np.repeat(n, counts), minlength=DIMS + len(NAMES)).astype(np.int64)
                        have[DIMS:] += np.bincount(script, weights=n, minlength=len(NAMES)).astype(np.int64)
        for lang, have in own.items():
            used = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(have[used])], names=["l", "b", "n"]
            )

    counted = given.select("t", "l").mapInArrow(run, "l string, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, count = (counted.column(k) for k in ("l", "b", "n"))
    langs = sorted(set(lang.to_pylist()))
    if not langs:
        return None
    table = np.zeros((DIMS + len(NAMES), len(langs)))
    place = {x: j for j, x in enumerate(langs)}
    table[bucket.to_numpy(), [place[x] for x in lang.to_pylist()]] = count.to_numpy()
    words = table[DIMS:]
    smooth = table[:DIMS] + 0.1
    return Model(langs, np.log(smooth / smooth.sum(0)).astype(np.float32), words > LEAST * np.maximum(words.sum(0), 1))


def viterbi(score: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word (words document by document), all documents in step, longest first."""
    order = np.argsort(-counts, kind="stable")
    lens = counts[order]
    start = (np.cumsum(counts) - counts)[order]
    steps = int(lens[0]) if len(lens) else 0
    out = np.zeros(len(score), np.int64)
    if not steps:
        return out
    alive = np.searchsorted(-lens, -np.arange(steps), "left")  # documents longer than t
    v = score[start[: alive[0]]].astype(np.float64)
    back: list[tuple[np.ndarray, np.ndarray]] = []
    final = np.zeros(alive[0], np.int64)
    for t in range(1, steps + 1):
        n = int(alive[t]) if t < steps else 0
        if n < len(v):
            final[n : len(v)] = v[n:].argmax(1)
            v = v[:n]
        if not n:
            break
        best = v.argmax(1)
        jump = v[np.arange(n), best][:, None] - penalty
        stay = v >= jump
        back.append((stay, best))
        v = np.where(stay, v, jump) + score[start[:n] + t]
    state = final
    for t in range(steps - 1, -1, -1):
        n = int(alive[t])
        out[start[:n] + t] = state[:n]
        if t:
            stay, best = back[t - 1]
            k = np.arange(n)
            state[:n] = np.where(stay[k, state[:n]], state[:n], best)
    return out


def identify(docs: DataFrame, model: Model | None, id_col="doc_id", text_col="text", penalty: float = PENALTY, spans: bool = False) -> DataFrame:
    """``id, lang_pred, score`` per row: the language with most letters in its spans, and its share of the letters; with
    ``spans`` also ``array<struct<begin, end, lang>>`` of character ranges from 0."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"i {kind}, lang_pred string, score double" + (", spans array<struct<begin:int,end:int,lang:string>>" if spans else "")

    def run(batches):
        for batch in batches:
            every = batch.column(1).to_pylist()
            for a, b in slices(np.array([len(t or "") for t in every]), 16_000_000):
                texts = every[a:b]
                index: dict[str, int] = {}
                order: list[int] = []
                counts = np.zeros(len(texts), np.int64)
                for k, t in enumerate(texts):
                    found = _WORD.findall(t.lower()) if t and model else ()
                    counts[k] = len(found)
                    order.extend([index.setdefault(w, len(index)) for w in found])
                names, share = ["und"] * len(texts), np.zeros(len(texts))
                flat, state = np.array(order, np.int64), np.zeros(0, np.int64)
                if order:
                    table, lens = model.word_scores(list(index))
                    state = viterbi(table[flat], counts, penalty)
                    doc = np.repeat(np.arange(len(texts)), counts)
                    width = len(model.langs)
                    letters = np.bincount(doc * width + state, weights=lens[flat], minlength=len(texts) * width).reshape(-1, width)
                    top, total = letters.argmax(1), letters.sum(1)
                    names = [model.langs[j] if n else "und" for j, n in zip(top, total, strict=True)]
                    share = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0)
                cols = [batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(share)]
                if spans:
                    at, out = 0, []
                    for t, n in zip(texts, counts, strict=True):
                        out.append(_spans(t, state[at : at + n], model))
                        at += n
                    cols.append(pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(cols, names=["i", "lang_pred", "score", "spans"][: len(cols)])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("i", id_col)


def _spans(text: str | None, state: np.ndarray, model: Model | None) -> list[dict]:
    """Runs of one language, from the first letter of a run to its last."""
    out: list[dict] = []
    if not len(state):
        return out
    low = text.lower()
    places = [m.span() for m in _WORD.finditer(text if len(low) == len(text) else low)]
    for (a, b), s in zip(places, state, strict=False):
        if out and out[-1]["lang"] == model.langs[s]:
            out[-1]["end"] = b
        else:
            out.append({"begin": a, "end": b, "lang": model.langs[s]})
    return out
