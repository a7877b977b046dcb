"""Small helpers shared by the expression modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_unit(key, seed) -> Column:
    """Deterministic number in [0, 1) from md5(seed ':' key).

    Uses the first 8 hex digits (32 bits), which agree across engines
    (md5 is standard), unlike xxhash64 or rand().
    """
    h = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), as_col(key).cast("string"))), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(2**32))


def md5_hex8(key, seed) -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), as_col(key).cast("string"))), 1, 8)
