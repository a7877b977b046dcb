"""Periodic runs in the words of a text, found by string synchronising sets.

A run is a stretch of words with smallest period ``q`` and length ``2 q`` or
more that no neighbouring word extends.  All runs of a text are found scale by
scale; scale ``t = 1, 2, 4, ...`` finds the periods from ``3 t`` to ``6 t - 1``:

1. *Highly periodic regions*: windows of ``t`` words with a period of at most
   ``t / 3``.  They lie inside runs of smaller scales; periods 1 and 2 come
   from comparing neighbours directly.
2. *Synchronising set*: every window of ``t`` words has a hash; a position
   belongs to the set when the smallest hash among the windows that begin in
   its ``t + 1`` next places, highly periodic ones left out, stands at the first
   or the last of them.  Positions with equal contexts (``2 t`` words) are both
   in the set or both not, and every ``t`` places hold one unless the text is
   highly periodic there.
3. *Proposals*: positions of the set with equal contexts, ``3 t`` to ``6 t - 1``
   words apart, propose their distance as a period.  Equal contexts stand more
   than ``t / 3`` apart, so a position meets a bounded number of others.  Where
   the first period of a run is itself highly periodic, the set is empty there:
   two touching regions of one small period propose all distances that bring
   one into phase with the other.
4. A proposal is extended to both sides by comparing prefix hashes, and of
   equal stretches the smallest period stays.  Every run is compared word by
   word afterwards; should hashes ever have collided, the texts are done
   again with other hashes, so the result is exact.

The texts of a batch are searched together, one after the other with separators
that occur once.  Work is a map: nothing is shuffled or collected, and a text's
memory is a few numbers a word.

Defined results: a null or empty text, or one without a word, has no run and an
empty collapsed text; words are compared as they stand, case included.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.llm.arrow import prepare, slices

WORD = r"[^\x20\x09-\x0D]+"
LEAST = 12
AT_ONCE = 4_000_000  # characters searched together

_PRIMES = (2_147_483_647, 2_147_483_629)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Prefixes:
    """Prefix hashes of a sequence, for comparing stretches of it."""

    def __init__(self, ids: np.ndarray, rng):
        self.kept = []
        for p in _PRIMES:
            base, names = int(rng.integers(1 << 20, p - 1)), rng.integers(1, p, int(ids.max(initial=0)) + 1)
            power = np.ones(len(ids) + 1, np.int64)
            have = 1
            while have < len(power):
                step = power[:have] * pow(base, have, p) % p
                power[have : 2 * have] = step[: len(power) - have]
                have *= 2
            total = np.zeros(len(ids) + 1, np.int64)
            # sums of at most 2**31 terms below 2**31 stay within 63 bits
            np.cumsum(names[ids] * power[:-1] % p, out=total[1:])
            self.kept.append((p, power, total % p))

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the ``n`` elements from i equal those from j; ``i <= j``."""
        same = np.ones(len(i), bool)
        for p, power, total in self.kept:
            left = (total[i + n] - total[i]) % p * power[j - i] % p
            same &= left == (total[j + n] - total[j]) % p
        return same

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch from i and from j."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(i, j, mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends before i and before j."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(i - mid, j - mid, mid)
            low = np.where(open_ & same, mid, low)
            high = np.where(open_ & ~same, mid - 1, high)
        return low


def _smallest(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values."""
    n = len(v)
    padded = np.full(-(-n // w) * w, _NONE)
    padded[:n] = v
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _pairs(context: np.ndarray, at: np.ndarray, near: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i, j)`` with equal contexts, ``near <= j - i < far``."""
    order = np.lexsort((at, context))
    c, p = context[order], at[order]
    first = np.arange(len(p))
    out_i, out_j = [], []
    lag = 1
    while True:
        first = first[first + lag < len(p)]
        second = first + lag
        gap = p[second] - p[first]
        ok = (c[first] == c[second]) & (gap < far)
        first = first[ok]
        if not len(first):
            break
        wide = gap[ok] >= near
        out_i.append(p[first[wide]])
        out_j.append(p[first[wide] + lag])
        lag += 1
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


def _in_phase(runs: np.ndarray, t: int, ids_hash: _Prefixes) -> tuple[np.ndarray, np.ndarray]:
    """Proposals of touching regions of one small period: ``(i, j)`` with j the end of the first region."""
    s, e, p = runs
    ok = (3 * p <= t) & (e - s >= 3 * t)
    s, e, p = s[ok], e[ok], p[ok]
    order = np.lexsort((s, p))
    s, e, p = s[order], e[order], p[order]
    k = np.flatnonzero((p[1:] == p[:-1]) & (s[1:] <= e[:-1]))
    if not len(k):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the place in the first period of A that begins like B
    own = np.repeat(np.arange(len(k)), p[k])
    shift = np.arange(len(own)) - np.repeat(np.cumsum(p[k]) - p[k], p[k])
    x, y = s[k][own] + shift, s[k + 1][own]
    hit = ids_hash.equal(x, y, p[k][own])
    own, rest = own[hit], (y - x)[hit] % p[k][own[hit]]
    k = k[own]
    low = 3 * t + (rest - 3 * t) % p[k]
    high = np.minimum(6 * t - 1, np.minimum(e[k] - s[k], e[k + 1] - s[k + 1]))
    n = np.maximum((high - low) // p[k] + 1, 0)
    again = np.repeat(np.arange(len(k)), n)
    step = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
    q = low[again] + step * p[k][again]
    j = e[k][again]
    return j - q, j


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Runs ``(start, end, period)`` of both; of equal stretches the smallest period."""
    s, e, q = np.concatenate([a, b], axis=1)
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return np.stack([s[new], e[new], q[new]])


def _neighbours(ids: np.ndarray, q: int) -> np.ndarray:
    """Runs of period ``q`` by comparing the words ``q`` apart."""
    same = np.zeros(max(len(ids) - q, 0) + 2, np.int8)
    same[1:-1] = ids[q:] == ids[: len(ids) - q] if len(ids) > q else 0
    edge = np.diff(same)
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
    ok = e - s >= 2 * q
    return np.stack([s[ok], e[ok], np.full(int(ok.sum()), q)]).astype(np.int64)


def _true(ids: np.ndarray, runs: np.ndarray) -> bool:
    """Whether all words of the runs that lie a period apart are equal."""
    s, e, q = runs
    n = e - s - q
    for a, b in slices(n, 4_000_000):
        begin = np.cumsum(n[a:b]) - n[a:b]
        at = np.arange(int(n[a:b].sum())) + np.repeat(s[a:b] - begin, n[a:b])
        if not np.array_equal(ids[at], ids[at + np.repeat(q[a:b], n[a:b])]):
            return False
    return True


def _search(ids: np.ndarray, begin: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray | None:
    """All runs of the sequences; None when hashes have collided."""
    rng = np.random.default_rng(seed)
    prefixes = _Prefixes(ids, rng)
    salt = rng.integers(1, 1 << 63, 3, dtype=np.uint64) | np.uint64(1)
    runs = np.zeros((3, 0), np.int64)
    for q in (1, 2):
        runs = _merge(runs, _neighbours(ids, q))
    name = np.repeat(np.arange(len(lens)), lens + 1)
    at = np.arange(len(ids))  # places of the sequences still searched
    level = _mix(ids.astype(np.uint64) * salt[0] + salt[1])  # hash of the t words from a place
    end = begin + lens
    t = 1
    while True:
        mine = lens[name[at]] >= 6 * t
        if not mine.all():
            at, level = at[mine], level[mine]
        if not len(at):
            return runs
        ahead = np.empty_like(level)
        ahead[:-t] = level[t:]
        ahead[-t:] = _mix(at[-t:].astype(np.uint64) + salt[2])
        context = _mix(level * salt[0] + (ahead ^ salt[1]) * salt[2])
        value = np.minimum(level, _NONE - np.uint64(1))
        s, e, p = runs
        hot = (3 * p <= t) & (e - s >= t) & (lens[name[s]] >= 6 * t)
        if hot.any():
            # the places kept are in rising order, and whole sequences are kept
            mark = np.zeros(len(at) + 1, np.int64)
            np.add.at(mark, np.searchsorted(at, s[hot]), 1)
            np.add.at(mark, np.searchsorted(at, e[hot] - t) + 1, -1)
            value[np.cumsum(mark)[:-1] > 0] = _NONE
        if len(value) > t:
            low = _smallest(value, t + 1)
            n = len(low)
            chosen = np.flatnonzero((low != _NONE) & ((value[:n] == low) | (value[t : t + n] == low)))
            i, j = _pairs(context[chosen], at[chosen], 3 * t, 6 * t)
            more_i, more_j = _in_phase(runs, t, prefixes)
            i, j = np.concatenate([i, more_i]), np.concatenate([j, more_j])
            same = name[i] == name[j]
            i, j = i[same], j[same]
            if len(i):
                doc = name[i]
                right = prefixes.forward(i, j, end[doc] - j)
                left = prefixes.backward(i, j, i - begin[doc])
                found = np.stack([i - left, j + right, j - i])
                found = _merge(found[:, found[1] - found[0] >= 2 * found[2]], np.zeros((3, 0), np.int64))
                if not _true(ids, found):
                    return None
                runs = _merge(runs, found)
        level, t = context, 2 * t


def find_runs(words: list[list[str]], least: int = LEAST) -> list[np.ndarray]:
    """For every list of words its runs of ``least`` words or more, rows ``start, length, period`` by start and period."""
    index: dict[str, int] = {}
    lens = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(lens + 1) - lens - 1
    ids = np.empty(int((lens + 1).sum()), np.int64)
    for k, w in enumerate(words):
        ids[begin[k] : begin[k] + lens[k]] = [index.setdefault(x, len(index)) for x in w]
    ids[begin + lens] = len(index) + np.arange(len(words))
    seed = 0
    while (runs := _search(ids, begin, lens, seed)) is None:
        seed += 1
    s, e, q = runs[:, runs[1] - runs[0] >= least]
    order = np.lexsort((q, s))
    s, e, q = s[order], e[order], q[order]
    doc = np.searchsorted(begin, s, "right") - 1
    cut = np.searchsorted(doc, np.arange(len(words) + 1))
    table = np.stack([s - begin[doc], e - s, q], axis=1) if len(s) else np.zeros((0, 3), np.int64)
    return [table[cut[k] : cut[k + 1]] for k in range(len(words))]


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words that no run holds behind its first period, joined by one space."""
    if not len(runs):
        return " ".join(words)
    mark = np.zeros(len(words) + 1, np.int64)
    np.add.at(mark, runs[:, 0] + runs[:, 2], 1)
    np.add.at(mark, runs[:, 0] + runs[:, 1], -1)
    return " ".join([words[k] for k in np.flatnonzero(np.cumsum(mark)[:-1] == 0)])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: ``id, n_words, runs array<struct<start, length, period>>, collapsed``."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        cut = re.compile(WORD).findall
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(np.array([len(t or "") for t in texts]), AT_ONCE):
                words = [cut(t) if t else [] for t in texts[a:b]]
                runs = find_runs(words, least)
                flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
                ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
                listed = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run_type)),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(w) for w in words], pa.int64()),
                        listed,
                        pa.array([collapsed(w, r) for w, r in zip(words, runs, strict=True)], pa.string()),
                    ],
                    names=["i", "n_words", "runs", "collapsed"],
                )

    schema = f"i {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("i", id_col)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text``: with ``h = crc32`` of the decimal id and ``g = floor(h / 10)``, a text of n > 0 words for which
    ``h % 10 = 0`` repeats, from word ``a = g % n`` on, its ``1 + floor((n - a) / (3 + g % 8))`` words from there.
    Other texts, and those with a null id, stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    d = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), h.alias("h")).withColumn("g", F.floor(F.col("h") / 10))
    # words are cut only where they are needed
    w = d.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(1))))
    n = F.size("w").cast("long")
    w = w.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at("w", (place(i) + 1).cast("int")))
    text = F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("t"))
    return w.select(F.col("i").alias(id_col), text.alias(text_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: number of runs, the longest (ties: smallest start, then period), and digests of the list and the
    collapsed text."""
    order = F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("q")))
    best = F.array_max(order)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listing = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        id_col,
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.q")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.l") / -F.col("best.q")).alias("exponent_milli"),
        F.sha2(listing.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
