"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

* Sources get weights by rank (code point order, null last) and share
  ``share`` times all sizes.  A source is clamped at ``max_epochs`` times its
  size and its excess is re-shared by weight until none is above.  That
  procedure ends at one water level: with sources ordered by the level at
  which each is clamped, the clamped ones are a prefix, so the level comes
  from running sums over one row per source.
* A source's repetitions are ``target / size``: every document is taken the
  whole part of that, and documents in the order of a seeded hash once more
  until the fraction is used up (rounded to the nearest document).
* No source is ever gathered: sizes are pre-aggregated by (source, hash
  prefix) with map-side combine, running sums go over at most
  ``16 ** PREFIX`` rows a source, and only the documents of the one prefix in
  which the fraction ends are ordered.  The result is one hash bound per
  source, so the last step is a filter-like map joined with one row per source.

Defined results: a null text has size 0; a null source is a source of its own
and the last; an empty table gives an empty table; rows that repeat an id,
also a null one, are decided one by one, by a hash of id, text and a number
among equal rows; a source of size 0 has target 0 and its documents are taken
no times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlens.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
PREFIX = 3  # hex digits of the hash: 4,096 prefixes a source


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(id_: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """``(source, total)`` per source -> plus ``weight`` and ``target``.  One row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    cap = F.col("total") * max_epochs
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = ranked.withColumn("cap", cap).select(
        "source", "total", "weight", "cap",
        (
            (F.sum("total").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
            / F.sum("weight").over(after)
        ).alias("level"),
    )
    # the first source that its level does not clamp sets the level of all; from there on levels only fall
    open_ = levels.withColumn("l", F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")))
    water = F.max("l").over(everything)
    return open_.withColumn("water", water).select(
        "source", "total", "weight",
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("water") * F.col("weight")), F.col("cap").cast("double")).alias("target"),
    )


def mixing_plan(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Per source: ``source, total, target, whole, bound`` from ``(source, size, hash)`` rows.

    A document is taken ``whole`` times, and once more when its hash is not
    above ``bound`` (null: none is).
    """
    by_prefix = cut_lineage(
        sized.groupBy("source", F.substring("hash", 1, PREFIX).alias("prefix")).agg(F.sum("size").alias("size"))
    )
    targets = source_targets(by_prefix.groupBy("source").agg(F.sum("size").alias("total")), weights, share, max_epochs)
    reps = F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(F.lit(0.0))
    plan = targets.withColumn("whole", F.floor(reps)).withColumn(
        "budget", F.col("target") - F.col("whole") * F.col("total")
    )
    plan = cut_lineage(plan)
    w = Window.partitionBy("source").orderBy("prefix")
    upto = by_prefix.withColumn("before", F.sum("size").over(w) - F.col("size"))
    key = upto["source"].eqNullSafe(plan["source"])
    # the prefix in which the fraction ends: the last that begins within the budget
    last = (
        upto.join(plan, key)
        .where((F.col("before") <= F.col("budget")) & (F.col("budget") > 0))
        .groupBy(plan["source"].alias("source"))
        .agg(F.max(F.struct("prefix", "before", "budget")).alias("m"))
        .select("source", "m.*")
    )
    last = cut_lineage(last)
    inside = sized.join(
        last.select(F.col("source").alias("s2"), "prefix", "before", "budget"),
        F.col("source").eqNullSafe(F.col("s2")) & (F.substring("hash", 1, PREFIX) == F.col("prefix")),
    ).groupBy("s2", "hash").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("budget").alias("budget"))
    w = Window.partitionBy("s2").orderBy("hash")
    start = F.sum("size").over(w) - F.col("size") + F.col("before")
    fits = inside.withColumn("start", start).where(F.col("start") + F.col("size") / 2 <= F.col("budget"))
    exact = fits.groupBy("s2").agg(F.max("hash").alias("h"))
    bounds = last.join(exact, F.col("source").eqNullSafe(F.col("s2")), "left").select(
        F.col("source").alias("s3"), F.coalesce("h", F.col("prefix")).alias("bound")
    )  # the bare prefix sorts before its hashes and after all smaller prefixes
    return plan.join(bounds, F.col("source").eqNullSafe(F.col("s3")), "left").select("source", "total", "target", "whole", "bound")


def _hashed(rows: DataFrame, seed: int) -> DataFrame:
    """Written rows with ``i, th (hash of the text), place`` (any number of the row's own) -> plus ``hash``.

    A row whose id is its own has the hash of the id.  Rows of one id are told
    apart by their text and a number among equal rows; equal rows may change
    numbers without changing the mix.  Numbers are counted by parts of the
    table, so that no group of equal rows meets in one task.
    """
    repeated = rows.groupBy(F.coalesce(F.col("i").cast("string"), F.lit("null")).alias("name")).agg(F.count(F.lit(1)).alias("m"))
    repeated = cut_lineage(repeated.where(F.col("m") > 1).select("name"))
    plain = rows.withColumn("hash", seeded_hash(F.col("i"), seed))
    if repeated.isEmpty():
        return plain
    named = plain.withColumn("name", F.coalesce(F.col("i").cast("string"), F.lit("null"))).withColumn("part", F.shiftright("place", 16))
    some = named.join(repeated, "name", "left_semi")
    counts = cut_lineage(some.groupBy("name", "th", "part").agg(F.count(F.lit(1)).alias("m")))
    upto = Window.partitionBy("name", "th").orderBy("part")
    before = counts.withColumn("before", F.sum("m").over(upto) - F.col("m")).drop("m")
    inside = Window.partitionBy("name", "th", "part").orderBy("place")
    numbered = some.withColumn("r", F.row_number().over(inside)).join(before, ["name", "th", "part"])
    own = F.md5(F.concat(F.col("hash"), F.col("th"), (F.col("before") + F.col("r")).cast("string")))
    rest = named.join(repeated, "name", "left_anti")
    return numbered.withColumn("hash", own).select(*plain.columns).unionByName(rest.select(*plain.columns))


def _named(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """Written once: the numbers of its rows hold for all that follows."""
    return cut_lineage(
        docs.select(
            *more,
            F.col(id_col).alias("i"),
            F.col(source_col).alias("source"),
            text_size(F.col(text_col)).alias("size"),
            F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("th"),
            F.monotonically_increasing_id().alias("place"),
        )
    )


def _reps() -> Column:
    return F.col("whole") + F.when(F.col("hash") <= F.col("bound"), 1).otherwise(0)


def _plan(sized: DataFrame, **kw) -> DataFrame:
    """The plan with names of its own; written, so that its size decides between broadcast and shuffle."""
    return cut_lineage(mixing_plan(sized, **kw).withColumnRenamed("source", "plan_source"))


def mix_sizes(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = 7, **kw) -> DataFrame:
    """One row per document: ``id, size, source_size, target, taken`` (words the mix takes, repeats counted)."""
    sized = cut_lineage(_hashed(_named(docs, id_col, text_col, source_col), seed).select("i", "source", "size", "hash"))
    out = sized.join(_plan(sized, **kw), F.col("source").eqNullSafe(F.col("plan_source")))
    return out.select(
        F.col("i").alias(id_col), "size", F.col("total").cast("long").alias("source_size"), "target",
        (F.col("size") * _reps()).cast("long").alias("taken"),
    )


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed: int = 7, **kw) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; columns unchanged."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _hashed(_named(docs, id_col, text_col, source_col, whole), seed)
    plan = _plan(cut_lineage(rows.select("source", "size", "hash")), **kw)
    taken = rows.select("row", "source", "hash").join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).where(_reps() > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), _reps().cast("int")))).select("row.*")
