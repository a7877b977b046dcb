"""Exact top-k inner products with a vector-approximation file.

1. Vectors become integers, ``floor(scale * x)``.  Of the ids that bear one
   vector the ``k + 1`` smallest take part as candidates: a score is the same
   for all of them, ties go to the smaller id, and one may be the query's own,
   so no other can be among the ``k`` best.  Per dimension the range is cut into ``CELLS`` equal cells; the approximation file holds one byte per
   component, in blocks of ``BLOCK`` vectors, the exact vectors a table beside it.
2. Scan: every block of cells meets every block of queries.  Cell borders give
   each vector a lower and an upper bound of its score: the score of its cell's
   middle, less or more the query's reach.  In a task a query keeps the vectors
   whose upper bound reaches the k-th largest lower bound of the blocks it has
   met there; over all blocks, those that reach the k-th largest lower bound of all.
3. Refinement: candidates are read in the order of their bound, best first.
   ``FIRST * k`` of each query are read and scored exactly; the k-th exact
   score then settles which of the rest can still matter, and only those are
   read.  Upper bounds equal to the k-th score count, so ties are whole.

The query set is given in blocks and meets the table in blocks: a pair of
blocks is one row of an equi-join on a deal number, streamed through a map of
bounded memory.  Each side is copied to every deal of the other, and Spark's
estimate knows neither the copies nor how far a file was compressed: joins that
carry vectors are always merge joins, never broadcasts.  Nothing is sampled, and of
the vectors nothing but two numbers a dimension and length and their count
reaches the driver.

Defined results: vectors that are null, or hold null or non-finite components,
or have a null id take no part; only vectors of the query's length are its
candidates; rows that repeat an id count once, with the best score; an empty
table gives an empty result; with fewer than k candidates all are returned;
empty vectors take no part; a component beyond 64 bits counts as the nearest
64-bit number; where the absolute products of a pair sum to ``EXACT`` or more
its score is the sum in floating point, and beyond 64 bits the nearest 64-bit
number.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlens.llm.arrow import prepare
from convlens.session import cut_lineage

CELLS = 256
BLOCK = 4096
QUERIES = 512
FIRST = 4
#: Pairs of blocks that make a task worth its copies; blocks of cells that a task keeps at hand.
PAIRS = 8
AT_HAND = 64
#: Candidates that a task holds back, and those it hands on at once.
HELD = 1 << 20
HANDED = 1 << 18
EXACT = float(1 << 62)


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``id, v array<long>`` of the vectors that take part."""
    x = F.col(vec_col)
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale))).cast("long"))
    part = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    return part.select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def ranges(exact: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Smallest and largest component of every dimension, by vector length."""
    comp = exact.select(F.size("v").alias("d"), F.posexplode("v").alias("j", "x"))
    found = comp.groupBy("d", "j").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in found:
        lo, hi = out.setdefault(r["d"], (np.zeros(r["d"], np.int64), np.zeros(r["d"], np.int64)))
        lo[r["j"]], hi[r["j"]] = r["lo"], r["hi"]
    return out


def candidates(whole: DataFrame, k: int) -> DataFrame:
    """``id, v``: of the ids of every different vector the ``k + 1`` smallest, once each."""
    same = Window.partitionBy("v").orderBy("id")
    return whole.dropDuplicates(["id", "v"]).withColumn("r", F.row_number().over(same)).where(F.col("r") <= k + 1).select("id", "v")


class Grid:
    """Equal cells between the smallest and largest component of every dimension."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, cells: int):
        # in floating point, where ranges may leave 64 bits; border() is only ever asked with cells made here
        self.lo, self.cells = lo.astype(np.float64), cells
        self.width = hi.astype(np.float64) - self.lo + 1

    def cell(self, v: np.ndarray) -> np.ndarray:
        wide = (v.astype(np.float64) - self.lo) * (self.cells / self.width)
        return np.clip(np.floor(wide), 0, self.cells - 1).astype(np.uint8)

    def borders(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest whole number of a cell, and a rounding more."""
        x = c.astype(np.float64)
        slack = (np.abs(self.lo) + self.width) * 4e-15
        low = np.ceil(self.lo + x * self.width / self.cells - slack)
        high = np.floor(self.lo + (x + 1) * self.width / self.cells + slack)
        # the ends are as exact as a double holds them
        return np.maximum(low, self.lo - slack), np.minimum(high, self.lo + self.width + slack)

    def middles(self) -> tuple[np.ndarray, np.ndarray]:
        """The middle of every cell of every dimension; by dimension, how far a value lies from its cell's middle at most."""
        low, high = self.borders(np.repeat(np.arange(self.cells)[:, None], len(self.lo), axis=1))
        middle = low / 2 + high / 2
        return middle, np.maximum(high - middle, middle - low).max(axis=0)


def approximation_file(exact: DataFrame, grids: dict[int, Grid], block: int) -> DataFrame:
    """``d, ids, cells``: blocks of up to ``block`` vectors of one length; a map without shuffle."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            v, lens = batch.column(1), None
            lens = v.value_lengths().to_numpy()
            flat, at = v.flatten().to_numpy(), np.cumsum(lens) - lens
            for d in np.unique(lens):
                rows = np.flatnonzero(lens == d)
                for k in range(0, len(rows), block):
                    part = rows[k : k + block]
                    x = flat[at[part][:, None] + np.arange(d)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(d)], pa.int32()), pa.array([ids[part].tobytes()]), pa.array([grids[int(d)].cell(x).tobytes()])],
                        names=["d", "ids", "cells"],
                    )

    return exact.mapInArrow(run, "d int, ids binary, cells binary")


def query_blocks(queries: DataFrame, size: int) -> DataFrame:
    """``d, qids, values``: blocks of up to ``size`` queries of one length."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), batch.column(1)
            lens = v.value_lengths().to_numpy()
            flat, at = v.flatten().to_numpy(), np.cumsum(lens) - lens
            for d in np.unique(lens):
                rows = np.flatnonzero(lens == d)
                for k in range(0, len(rows), size):
                    part = rows[k : k + size]
                    x = flat[at[part][:, None] + np.arange(d)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(d)], pa.int32()), pa.array([ids[part].tobytes()]), pa.array([x.tobytes()])],
                        names=["d", "qids", "values"],
                    )

    return queries.mapInArrow(run, "d int, qids binary, values binary")


class Asked:
    """A block of queries on its way past blocks of cells of its length: for every query the ``k`` largest lower bounds
    so far, each of another id, and the candidates that may still reach them."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, middle: np.ndarray, reach: np.ndarray, k: int):
        self.qids, self.q, self.middle, self.k = qids, q.astype(np.float64), middle, k
        # a sum's rounding grows with its terms, here and in the exact score
        rounding = np.abs(middle).max(axis=0) * (len(reach) + 16) * 4.5e-16
        self.reach = np.abs(self.q) @ (reach + rounding)
        self.low = np.full((len(qids), k), -np.inf)
        self.low_id = np.zeros((len(qids), k), np.int64)
        self.held, self.rows = [], 0

    def meet(self, ids: np.ndarray, cells: np.ndarray) -> None:
        score = self.q @ self.middle[cells, np.arange(cells.shape[1])].T
        order = np.argsort(ids, kind="stable")
        named = ids[order]
        new = np.concatenate([[True], named[1:] != named[:-1]])
        if not new.all():  # a repeated id counts once, by its best bounds
            score = np.maximum.reduceat(score[:, order], np.flatnonzero(new), axis=1)
            ids = named = named[new]
            order = np.arange(len(ids))
        at = np.minimum(np.searchsorted(named, self.qids), len(ids) - 1)
        own = np.flatnonzero(named[at] == self.qids)
        score[own, order[at[own]]] = -np.inf
        known = self.low.min(axis=1)
        kth = known
        if len(ids) > self.k and np.isinf(known).any():
            kth = np.maximum(known, np.partition(score, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - self.reach)
        at = np.flatnonzero(score >= np.maximum(kth - self.reach, -np.finfo(np.float64).max)[:, None])
        row, col = np.divmod(at, len(ids))
        found = score.ravel()[at]
        lower, upper = found - self.reach[row], found + self.reach[row]
        self.held.append((row, ids[col], lower, upper))
        self.rows += len(row)
        more = lower > known[row]
        if more.any():
            self._raise(row[more], ids[col[more]], lower[more])

    def _raise(self, row: np.ndarray, ids: np.ndarray, lower: np.ndarray) -> None:
        """Takes lower bounds of a block among the ``k`` largest; an id counts once, by its best."""
        mine = np.unique(row)
        row = np.concatenate([np.repeat(mine, self.k), row])
        ids = np.concatenate([self.low_id[mine].ravel(), ids])
        lower = np.concatenate([self.low[mine].ravel(), lower])
        there = np.flatnonzero(lower > -np.inf)
        there = there[np.lexsort((-lower[there], ids[there], row[there]))]
        row, ids, lower = row[there], ids[there], lower[there]
        best = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])]))
        best = best[np.lexsort((-lower[best], row[best]))]
        row, ids, lower = row[best], ids[best], lower[best]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < self.k
        self.low[row[top], place[top]] = lower[top]
        self.low_id[row[top], place[top]] = ids[top]

    def candidates(self):
        """``(query ids, vector ids, lower, upper)``: those held that reach the k-th largest lower bound so far; no more are held then."""
        if not self.held:
            return
        row, ids, lower, upper = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.rows = [], 0
        kept = np.flatnonzero(upper >= self.low.min(axis=1)[row])
        for a in range(0, len(kept), HANDED):
            part = kept[a : a + HANDED]
            yield self.qids[row[part]], ids[part], lower[part], upper[part]


def dealing(n: int, asked: int, block: int, most: int) -> tuple[int, int]:
    """Into how many deals the blocks of ``n`` vectors and the blocks of ``asked`` queries go; about ``most`` pairs of deals.

    Each deal of vectors costs a copy of the queries and of their candidates, about 16 times the bytes of as many
    vectors' cells; each deal of queries costs a copy of the cells.
    """
    blocks, sets = -(-n // block), -(-asked // QUERIES)
    tasks = min(most, -(-blocks * sets // PAIRS))
    a = max(1, round((tasks * n / max(1, 16 * asked)) ** 0.5), -(-blocks // AT_HAND))
    a = max(1, min(a, blocks, max(tasks, -(-blocks // AT_HAND))))
    return a, max(1, min(sets, -(-tasks // a)))


def scan(cells: DataFrame, blocks: DataFrame, grids: dict[int, Grid], k: int, deals: tuple[int, int]) -> DataFrame:
    """``query_id, id, lower, upper`` of the candidates of every block of queries in every pair of deals."""
    import pyarrow as pa

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    dealt = cells.withColumn("deal", F.pmod(F.xxhash64("ids"), F.lit(deals[0]))).withColumn("part", every(deals[1]))
    asked = blocks.withColumn("part", F.pmod(F.xxhash64("qids", "values"), F.lit(deals[1]))).withColumn("deal", every(deals[0]))
    # a merge join streams its left side: a block of queries meets all the cells of its deal, then comes the next
    pairs = asked.join(dealt.hint("merge"), ["deal", "part", "d"]).select("d", "qids", "values", "ids", "cells")

    def run(batches):
        of, block, middles = None, None, {}

        def handed():
            for found in block.candidates():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "id", "lower", "upper"])

        for batch in batches:
            for row in batch.to_pylist():
                d = row["d"]
                if of != (d, row["qids"], row["values"]):
                    if block:
                        yield from handed()
                    of = (d, row["qids"], row["values"])
                    if d not in middles:
                        middles = {d: grids[d].middles()}
                    q = np.frombuffer(row["values"], np.int64).reshape(-1, d)
                    block = Asked(np.frombuffer(row["qids"], np.int64), q, *middles[d], k)
                block.meet(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["cells"], np.uint8).reshape(-1, d))
                if block.rows > HELD:
                    yield from handed()
        if block:
            yield from handed()

    return pairs.mapInArrow(run, "query_id long, id long, lower double, upper double")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = 1024,
    cells: int = CELLS,
    block: int = BLOCK,
    first: int = FIRST,
) -> DataFrame:
    """``query_id, rank, id, score``: the k largest integer inner products of every query row, ties to the smaller id;
    a query's own id is no candidate.  ``is_query`` is a condition on the column ``id``."""
    spark = vectors.sparkSession
    prepare(spark)
    whole = quantise(vectors, id_col, vec_col, scale)
    exact = cut_lineage(candidates(whole, k))
    grids = {d: Grid(lo, hi, cells) for d, (lo, hi) in ranges(exact).items()}
    asked = cut_lineage(whole.where(is_query).dropDuplicates(["id", "v"]))
    deals = dealing(exact.count(), asked.count(), block, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = scan(approximation_file(exact, grids, block), query_blocks(asked, QUERIES), grids, k, deals)
    found = cut_lineage(found.groupBy("query_id", "id").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper")))
    mine = Window.partitionBy("query_id")
    kth = (
        found.withColumn("r", F.row_number().over(mine.orderBy(F.desc("lower"))))
        .where(F.col("r") <= k)
        .groupBy("query_id")
        .agg(F.when(F.count(F.lit(1)) == k, F.min("lower")).alias("kth"))
    )
    kept = found.join(kth, "query_id").where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth")))
    order = cut_lineage(
        kept.select("query_id", "id", "upper", F.row_number().over(mine.orderBy(F.desc("upper"), "id")).alias("place"))
    )
    q = asked.select(F.col("id").alias("query_id"), F.col("v").alias("qv"))

    def scored(part: DataFrame) -> DataFrame:
        both = part.select("query_id", "id").join(exact.hint("merge"), "id").join(q.hint("merge"), "query_id")
        both = both.where(F.size("v") == F.size("qv"))
        wide = F.zip_with("v", "qv", lambda a, b: a.cast("double") * b.cast("double"))
        whole = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
        near = F.aggregate(wide, F.lit(0.0), lambda s, x: s + x)
        most = F.aggregate(wide, F.lit(0.0), lambda s, x: s + F.abs(x))
        # floor() gives the nearest 64-bit number of what lies beyond
        product = F.when(most < EXACT, whole).otherwise(F.floor(near))
        return both.select("query_id", "id", product.alias("score")).groupBy("query_id", "id").agg(F.max("score").alias("score"))

    head = cut_lineage(scored(order.where(F.col("place") <= first * k)))
    sure = (
        head.withColumn("r", F.row_number().over(mine.orderBy(F.desc("score"))))
        .where(F.col("r") <= k)
        .groupBy("query_id")
        .agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("certain"))
    )
    rest = order.where(F.col("place") > first * k).join(sure, "query_id").where(
        F.col("certain").isNull() | (F.col("upper") >= F.col("certain"))
    )
    ranked = head.unionByName(scored(rest)).withColumn("rank", F.row_number().over(mine.orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
