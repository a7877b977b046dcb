"""Exact deduplication (native): group by a 128-bit content hash, keep one stable id, compare bytes inside groups.

Two texts are equal when they are identical without any change; a null text
counts as empty.  Only DataFrame functions run: no Python on the executors.

1. ``(id, md5)`` is aggregated by hash with map-side combine, so a hash that a
   third of all rows share reaches its reducer as one row per map task.  Only
   hashes with two or more rows stay; they are written to the shared folder,
   so their size is known when the next joins are planned.
2. The rows of those hashes are compared byte for byte: all texts of a hash
   are equal exactly when its smallest and largest text are equal, and both
   are decomposable aggregates.  Hashes that fail are collisions; their rows
   are grouped by the text itself.
3. Rows are joined with their group.  The group side has one row per key, so
   a hot hash can only be hot on the row side, which AQE splits.

Defined results: an empty table gives an empty table; a null id is the lowest
id; of rows that repeat one id with one text a single one is kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlens.session import cut_lineage


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


class CopyGroups:
    """Groups of two or more equal texts: ``plain (h, keep_id, n)``, and ``split (h, t, keep_id, n)`` for the
    groups of colliding hashes.  Both are tables in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, hash_fn: Callable[[Column], Column], largest: bool):
        pick = F.max if largest else F.min
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col).alias("i"), hash_fn(text).alias("h"), text.alias("t"))
        many = cut_lineage(
            rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), pick("i").alias("keep_id")).where(F.col("n") > 1)
        )
        extremes = rows.join(many.select("h"), "h", "left_semi").groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        self.collided = cut_lineage(extremes.where(F.col("lo") != F.col("hi")).select("h"))
        self.plain = many.join(self.collided, "h", "left_anti")
        self.split = (
            rows.join(self.collided, "h", "left_semi")
            .groupBy("h", "t")
            .agg(F.count(F.lit(1)).alias("n"), pick("i").alias("keep_id"))
        )

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with struct ``row``, ``i``, ``h``, ``t``) plus ``keep_id``, ``n`` (null: no copy) and ``kept``."""
        ok = rows.join(self.collided, "h", "left_anti").join(self.plain, "h", "left")
        bad = rows.join(self.collided, "h", "left_semi").join(self.split, ["h", "t"], "left")
        cols = ["row", "i", "h", "keep_id", "n"]
        both = ok.select(*cols, F.lit(None).cast("string").alias("t")).unionByName(bad.select(*cols, "t"))
        single = F.col("n").isNull() | (F.col("n") == 1)
        top = ~single & F.col("i").eqNullSafe(F.col("keep_id"))
        rest = both.where(~top).withColumn("kept", single)
        # only rows of the kept id meet here: one per group unless a row is repeated
        w = Window.partitionBy("h", "t").orderBy("i")
        tops = both.where(top).withColumn("kept", F.row_number().over(w) == 1)
        return rest.unionByName(tops)


def mark_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_fn: Callable[[Column], Column] = content_hash,
    largest: bool = False,
) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, text_sha256``.

    The smallest id of a group stays, or the largest with ``largest``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = CopyGroups(docs, id_col, text_col, hash_fn, largest)
    rows = docs.select(
        F.struct(F.sha2(text, 256).alias("sha")).alias("row"),
        F.col(id_col).alias("i"),
        hash_fn(text).alias("h"),
        text.alias("t"),
    )
    out = groups.attach(rows)
    return out.select(
        F.col("i").alias(id_col),
        F.when(F.col("n").isNull(), F.col("i")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        "kept",
        F.col("row.sha").alias("text_sha256"),
    )


def drop_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_fn: Callable[[Column], Column] = content_hash,
    largest: bool = False,
) -> DataFrame:
    """``docs`` with one row per different text, every column unchanged."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = CopyGroups(docs, id_col, text_col, hash_fn, largest)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(id_col).alias("i"),
        hash_fn(text).alias("h"),
        text.alias("t"),
    )
    return groups.attach(rows).where("kept").select("row.*")
