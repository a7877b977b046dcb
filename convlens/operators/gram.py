"""Sums of products of many columns, blocked (inventory H5, H7).

One expression per pair of columns stops compiling at a few hundred columns.
Here a task multiplies its rows' matrix with itself, and with the mask of what
is present, so that every pair of columns counts the rows that have both; pairs
of column blocks are the keys under which the tasks' sums meet.  Columns are
shifted by their smallest value first, which leaves correlations as they are
and keeps the sums small.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.session import ship_package

BLOCK = 128
CONSTANT = 1e-14  # share of the mean square below which a variance is rounding


def _columns(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(cols)])


def _matrix(batch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1)


def _minima(df: DataFrame, cols: list[str]) -> np.ndarray:
    import pyarrow as pa

    def run(batches):
        low = np.full(len(cols), np.inf)
        for batch in batches:
            if batch.num_rows:
                low = np.fmin(low, np.fmin.reduce(_matrix(batch), axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cols)), pa.int32()), pa.array(low)], names=["k", "low"])

    found = _columns(df, cols).mapInArrow(run, "k int, low double").groupBy("k").agg(F.min("low").alias("low")).collect()
    out = np.zeros(len(cols))
    for r in found:
        out[r["k"]] = r["low"] if np.isfinite(r["low"]) else 0.0
    return out


def _pair(n, sx, sy, sxx, syy, sxy) -> np.ndarray:
    """Correlations from sums; NaN where either side is constant or nothing is left."""
    n = np.where(n > 0, n, np.nan)
    mx, my = sx / n, sy / n
    vx, vy = sxx / n - mx * mx, syy / n - my * my
    ok = (vx > CONSTANT * sxx / n) & (vy > CONSTANT * syy / n)
    return np.where(ok, (sxy / n - mx * my) / np.sqrt(np.where(ok, vx * vy, 1.0)), np.nan)


def correlations(df: DataFrame, cols: list[str], block: int = BLOCK) -> DataFrame:
    """``(a, b, corr)`` of all pairs of columns, pairwise complete; null where a column is constant."""
    import pyarrow as pa

    ship_package(df.sparkSession)
    d, low = len(cols), _minima(df, cols)
    parts = [(i, min(i + block, d)) for i in range(0, d, block)]
    pairs = [(p, q) for p in range(len(parts)) for q in range(p, len(parts))]

    def sums(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch) - low
            here = (~np.isnan(x)).astype(np.float64)
            x = np.where(here > 0, x, 0.0)
            # rows that have both; sums and squares of the first where the second is there; products
            now = [here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x]
            total = now if total is None else [a + b for a, b in zip(total, now)]
        if total is not None:
            n, s, ss, xy = total
            for p, q in pairs:
                i, j = slice(*parts[p]), slice(*parts[q])
                six = np.stack([n[i, j], s[i, j], s[j, i].T, ss[i, j], ss[j, i].T, xy[i, j]])
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([q], pa.int32()), pa.array([six.tobytes()])], names=["p", "q", "s"])

    def merge(batches):
        key, total = None, None
        for batch in batches:
            for p, q, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                six = np.frombuffer(s, np.float64)
                if (p, q) == key:
                    total = total + six
                else:
                    if key is not None:
                        yield rows(key, total)
                    key, total = (p, q), six
        if key is not None:
            yield rows(key, total)

    def rows(key, total):
        (i, i_end), (j, j_end) = parts[key[0]], parts[key[1]]
        r = _pair(*total.reshape(6, i_end - i, j_end - j))
        a, b = (x.ravel() for x in np.meshgrid(np.arange(i, i_end), np.arange(j, j_end), indexing="ij"))
        values = r.ravel()
        values = np.where((a == b) & ~np.isnan(values), 1.0, values)
        if key[0] != key[1]:
            a, b, values = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([values, values])
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(values, from_pandas=True)], names=["i", "j", "corr"])

    met = _columns(df, cols).mapInArrow(sums, "p int, q int, s binary").repartition("p", "q").sortWithinPartitions("p", "q")
    found = met.mapInArrow(merge, "i int, j int, corr double")
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "k int, name string")
    first, second = names.toDF("i", "a"), names.toDF("j", "b")
    return found.join(first, "i").join(second, "j").select("a", "b", "corr")


def label_correlations(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """``(feature, r, n)``: correlation of every feature with the label, pairwise complete; ``n`` counts all rows."""
    import pyarrow as pa

    ship_package(df.sparkSession)
    cols = [*features, label]
    low = _minima(df, cols)

    def sums(batches):
        total, n = np.zeros((6, len(features))), 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch) - low
                x, y = x[:, :-1], x[:, -1:]
                both = ~np.isnan(x) & ~np.isnan(y)
                x, y = np.where(both, x, 0.0), np.where(both, y, 0.0)
                total += np.stack([both.sum(0), x.sum(0), y.sum(0), (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)])
                n += batch.num_rows
        cols = [pa.array(range(len(features)), pa.int32()), pa.array(np.full(len(features), n)), *[pa.array(t) for t in total]]
        yield pa.RecordBatch.from_arrays(cols, names=["k", "rows", "n", "sx", "sy", "sxx", "syy", "sxy"])

    part = _columns(df, cols).mapInArrow(sums, "k int, rows long, n double, sx double, sy double, sxx double, syy double, sxy double")
    s = part.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("rows", "n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.nullif(F.col("n"), F.lit(0.0))
    vx, vy = F.col("sxx") / n - F.pow(F.col("sx") / n, F.lit(2)), F.col("syy") / n - F.pow(F.col("sy") / n, F.lit(2))
    ok = (vx > CONSTANT * F.col("sxx") / n) & (vy > CONSTANT * F.col("syy") / n)
    r = F.when(ok, (F.col("sxy") / n - F.col("sx") / n * F.col("sy") / n) / F.sqrt(vx * vy))
    names = df.sparkSession.createDataFrame(list(enumerate(features)), "k int, feature string")
    return s.join(names, "k").select("feature", r.alias("r"), F.col("rows").alias("n"))
