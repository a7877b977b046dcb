"""Relational alignment of feature and score tables (inventory G).

Tables are aligned by key (never by row position).  Joins are plain
equi-joins; Spark picks broadcast or sort-merge from run-time sizes (AQE).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from convlens.functions.common import as_col


def assemble(frames: list[DataFrame], on: str = "id", how: str = "inner") -> DataFrame:
    """G1: join feature blocks on the key (each block one row per key)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, on, how)
    return out


def join_scores(features: DataFrame, scores: DataFrame, on: str = "id") -> DataFrame:
    """Inner equi-join of features and scores."""
    return features.join(scores, on, "inner")


def keep_matching(df: DataFrame, other: DataFrame, on: str = "id") -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other`` (``isin`` as a semi-join)."""
    return df.join(other.select(on), on, "left_semi")


def common_keys(cols: list[tuple[DataFrame, str]], out: str = "id") -> DataFrame:
    """Distinct keys present in every (table, column) pair."""
    first, rest = cols[0], cols[1:]
    acc = first[0].select(F.col(first[1]).alias(out))
    for df, c in rest:
        acc = acc.intersect(df.select(F.col(c).alias(out)))
    return acc


def sort_by(df: DataFrame, *cols) -> DataFrame:
    """Total sort (range-partitioned, parallel)."""
    return df.orderBy(*cols)


def digits_of(c) -> Column:
    """G6 expression: keep the digits of an id and read them as a bigint (null when none).

    Merges id families such as ``p5`` and ``pp5``; never the default join key.
    """
    return F.nullif(F.regexp_replace(as_col(c), r"\D", ""), F.lit("")).try_cast("bigint")


def cleanse_id_column(df: DataFrame, col: str = "id") -> DataFrame:
    """Replace the id by its digits, sorted by it."""
    return df.withColumn(col, digits_of(col)).orderBy(col)


DEFAULT_PARTICIPANT_PATTERN = r"^(PP?\d+)"


def participant_key(c, pattern: str = DEFAULT_PARTICIPANT_PATTERN) -> Column:
    """First capture group of ``pattern``, lower-cased; null when there is no match."""
    return F.lower(F.nullif(F.regexp_extract(as_col(c), pattern, 1), F.lit("")))


def numeric_columns(df: DataFrame, integral_only: bool = False, exclude=()) -> list[str]:
    """Names of numeric (or integral) columns, in schema order."""
    kinds = (TY.IntegralType,) if integral_only else (TY.NumericType,)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in exclude]


def mean_by_key(df: DataFrame, key: str, decimal_scale: int | None = None) -> DataFrame:
    """Mean of every numeric column per key; null keys dropped.

    ``decimal_scale`` sums in DECIMAL(38, scale) so the mean does not depend
    on the order in which partial sums meet (exact for decimal inputs).
    """
    cols = numeric_columns(df, exclude=(key,))

    def mean(c):
        if decimal_scale is None:
            return F.avg(c)
        return F.avg(F.col(c).cast(f"decimal(38,{decimal_scale})")).cast("double")

    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[mean(c).alias(c) for c in cols])


def first_numeric_column(df: DataFrame, exclude=("id",)) -> str:
    """The first numeric column that is not excluded."""
    cols = numeric_columns(df, exclude=exclude)
    if not cols:
        raise ValueError("no numeric column")
    return cols[0]


def rename_first_numeric(df: DataFrame, new_name: str, exclude=("id",)) -> DataFrame:
    return df.withColumnRenamed(first_numeric_column(df, exclude), new_name)


def drop_columns(df: DataFrame, cols: list[str], strict: bool = True) -> DataFrame:
    """Drop columns; ``strict`` raises when any is missing (Spark's drop is lenient)."""
    if strict:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns."""
    return df.withColumnsRenamed(mapping)
