"""Vector expressions over ARRAY<DOUBLE|FLOAT> columns (JVM-side higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convlens.functions.common import as_col


def _d(c) -> Column:
    return as_col(c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def l2norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_d(a), lambda x: x * x), F.lit(0.0), lambda acc, v: acc + v))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector is all zeros, null when either is missing."""
    na, nb = l2norm(a), l2norm(b)
    return F.when(as_col(a).isNull() | as_col(b).isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(F.try_divide(dot(a, b), F.nullif(na * nb, F.lit(0.0))), F.lit(0.0))
    )


def euclidean(a, b) -> Column:
    diff = F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda acc, v: acc + v))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)
