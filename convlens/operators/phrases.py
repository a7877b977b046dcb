"""Counts of many literal phrases in one pass (inventory B11, B12).

A phrase that begins and ends with a word character matches, with word borders
on both sides, exactly where its tokens (words and what stands between them)
follow each other.  Texts are cut into tokens once; every word begins one
candidate for each length that the dictionary has, and candidates meet the
dictionary in a hash join.  The work grows with the text and the number of
different lengths, not with the number of phrases.

Matches of one phrase do not overlap, leftmost first, as with a regular
expression: only a phrase that can overlap itself needs its places in order,
and those are folded per text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (?U): word characters are Unicode ones whatever the Java version's default
BORDER = r"(?U)\b"
_WORD = r"(?U)^\w"


def plain(phrase: str) -> bool:
    """Whether a literal can be counted by its tokens: it begins and ends with a word character."""
    return bool(re.match(r"\w", phrase)) and bool(re.search(r"\w\Z", phrase))


def tokens(text: Column) -> Column:
    """Words and what stands between them, alternating."""
    return F.filter(F.split(F.lower(text), BORDER), lambda t: t != "")


def dictionary(spark, phrases: list[str]) -> tuple[DataFrame, list[int]]:
    """``(phrase, gram, overlaps)`` and the different numbers of tokens."""
    rows = spark.createDataFrame([(p,) for p in dict.fromkeys(phrases)], "phrase string").select("phrase", tokens(F.col("phrase")).alias("t"))
    out, lengths = [], set()
    for r in rows.collect():  # the dictionary is the caller's
        t = list(r["t"])
        lengths.add(len(t))
        out.append((r["phrase"], "".join(t), len(t), any(t[:j] == t[-j:] for j in range(1, len(t), 2))))
    return spark.createDataFrame(out, "phrase string, gram string, size int, overlaps boolean"), sorted(lengths)


def phrase_counts(df: DataFrame, keys: list[str], text_col: str, phrases: list[str]) -> DataFrame:
    """``keys + (phrase, n)`` for the phrases that occur; rows of ``df`` are told apart, their counts summed by ``keys``."""
    for p in phrases:
        if not plain(p):
            raise ValueError(f"{p!r} does not begin and end with a word character")
    if not phrases:
        return df.select(*keys, F.lit("").alias("phrase"), F.lit(0).cast("long").alias("n")).limit(0)
    known, lengths = dictionary(df.sparkSession, phrases)
    cut = df.where(F.col(text_col).isNotNull()).select(*keys, F.monotonically_increasing_id().alias("__row"), tokens(F.col(text_col)).alias("t"))
    first = F.when(F.get("t", F.lit(0)).rlike(_WORD), 0).otherwise(1)  # words and the rest alternate
    starts = F.when(F.size("t") > first, F.sequence(first, F.size("t") - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    grams = F.flatten(
        F.transform(
            starts,
            lambda i: F.array(*[F.struct(i.alias("at"), F.when(i + k <= F.size("t"), F.array_join(F.slice("t", i + 1, k), "")).alias("gram")) for k in lengths]),
        )
    )
    found = cut.select(*keys, "__row", F.inline(grams)).where(F.col("gram").isNotNull()).join(known, "gram")
    simple = found.where(~F.col("overlaps")).groupBy(*keys, "phrase").agg(F.count(F.lit(1)).alias("n"))
    # places of one phrase in one text, in order; a match counts from where the last one ended
    state = "struct<n:long,free:int>"
    places = F.array_sort(F.collect_list("at"))
    step = lambda s, at: F.when(at >= s["free"], F.struct((s["n"] + 1).alias("n"), (at + F.col("size")).alias("free"))).otherwise(s).cast(state)
    folded = F.aggregate("p", F.expr(f"cast(named_struct('n', 0L, 'free', 0) as {state})"), step)["n"]
    self_ = found.where("overlaps").groupBy(*keys, "__row", "phrase", "size").agg(places.alias("p")).select(*keys, "phrase", folded.alias("n"))
    return simple.unionByName(self_).groupBy(*keys, "phrase").agg(F.sum("n").alias("n"))
