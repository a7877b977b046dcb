"""Helpers for maps over Arrow batches."""

from __future__ import annotations

import numpy as np

from convlens.session import ship_package

BATCH_BYTES = 8 << 20


def prepare(spark) -> None:
    """Send the package to the Python workers, and bound the bytes of an Arrow batch where the session leaves them
    unbounded, so that very long texts do not meet by the ten thousand in one worker."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(c for c in str(spark.conf.get(key)) if c.isdigit()) or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(lengths: np.ndarray, most: int):
    """Consecutive row ranges of at most ``most`` in sum, one row at least."""
    total, a = np.cumsum(lengths), 0
    while a < len(lengths):
        base = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, base + most, "right")))
        yield a, b
        a = b


def runs(batches, keys: int):
    """Batches sorted by their first ``keys`` columns -> ``(table, starts)`` that hold whole groups only.

    ``starts`` are the first rows of the groups.  Only the group that a batch
    ends in is held back until it is complete.
    """
    import pyarrow as pa

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        starts = _starts(table, keys)
        last = int(starts[-1])
        held = table.slice(last)
        if last:
            yield table.slice(0, last).combine_chunks(), starts[:-1]
    if held is not None:
        yield held.combine_chunks(), np.zeros(1, np.int64)


def _starts(table, keys: int) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in range(keys):
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def binary_matrix(column, width: int) -> np.ndarray:
    """A binary column of equal lengths as a matrix of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def gather(values: np.ndarray, at: np.ndarray, lens: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[at[p] : at[p] + lens[p]]`` of every p of ``pick`` one after the other, and their lengths."""
    n = lens[pick]
    total = int(n.sum())
    kind = np.int32 if max(total, len(values)) < 2**31 else np.int64
    start = np.cumsum(n, dtype=kind) - n.astype(kind)
    index = np.repeat(at.astype(kind)[pick] - start, n)
    index += np.arange(total, dtype=kind)
    return values[index], n


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` of the given lengths."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]
