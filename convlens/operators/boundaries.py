"""Sentence boundaries learned from the corpus (inventory B13, beside the plain split).

The method of Kiss and Strunk (2006): which words end in a period because they
are abbreviations, which words begin sentences, and which pairs belong together
across a period are all read off the corpus by log-likelihood ratios; then every
period between two words is decided on its own.

Training is a few aggregations: counts of word types, and of pairs of
neighbouring tokens in which a first token without a period is only a class.
Splitting cuts every text where a terminator meets white space, decides each cut
by joining the (written) tables of the model, and numbers sentences by a
skew-safe running sum.

Defined results: a null text has no sentence; blank sentences are dropped;
``!`` and ``?`` always end a sentence; the text of a sentence keeps its white
space inside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convlens.functions import text as T
from convlens.operators.sequence import exclusive_prefix_sum
from convlens.session import cut_lineage

# Fixed values of the published method.
ABBREVIATION = 0.3
COLLOCATION = 7.88
STARTER = 30.0
NUMBER = "##number##"
_NUMBER = r"^-?[.,]?[0-9][0-9,.\-]*$"
_ENDS = r"[.!?][\"'\)\]]*\z"


@dataclass
class Boundaries:
    """``abbreviations(type)``, ``starters(type)``, ``collocations(first, second)`` and ``cases(type, lower, upper_inside,
    upper, lower_first)``: which types occur in lower case, in upper case inside a sentence, in upper case at all, and in lower
    case at the beginning of a sentence."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    cases: DataFrame


def token_type(token: Column) -> Column:
    """Lower case, without outer punctuation and the final period; numbers are one type."""
    bare = F.regexp_replace(F.lower(token), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", "")
    return F.when(bare.rlike(_NUMBER), F.lit(NUMBER)).otherwise(bare)


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _marks(token: Column) -> tuple[Column, Column, Column]:
    """Ends in a period; ends in ``!`` or ``?``; is an initial (one letter and a period)."""
    bare = F.regexp_replace(token, r"[\"'\)\]]+\z", "")
    return bare.endswith("."), bare.rlike(r"[!?]\z"), bare.rlike(r"^[\"'\(\[]*\p{L}\.\z")


def _first_upper(token: Column) -> Column:
    letter = F.regexp_extract(token, r"^[\"'\(\[]*(\p{L})", 1)
    return (letter != "") & (letter == F.upper(letter)) & (letter != F.lower(letter))


def _first_lower(token: Column) -> Column:
    letter = F.regexp_extract(token, r"^[\"'\(\[]*(\p{L})", 1)
    return (letter != "") & (letter == F.lower(letter)) & (letter != F.upper(letter))


def _log(share: Column) -> Column:
    return F.ln(F.greatest(share, F.lit(1e-300)))


def _association(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Log-likelihood ratio of ``ab`` joint occurrences of two things that occur a and b times among n."""
    p, p1 = b / n, ab / a
    p2 = F.when(n == a, F.lit(1.0)).otherwise((b - ab) / F.nullif(n - a, F.lit(0)))
    one = ab * _log(p) + (a - ab) * _log(1 - p)
    two = (b - ab) * _log(p) + (n - a - b + ab) * _log(1 - p)
    three = F.when(a == ab, F.lit(0.0)).otherwise(ab * _log(p1) + (a - ab) * _log(1 - p1))
    four = F.when(b == ab, F.lit(0.0)).otherwise((b - ab) * _log(p2) + (n - a - b + ab) * _log(1 - p2))
    return -2 * (one + two - three - four)


def abbreviation_scores(types: DataFrame) -> DataFrame:
    """``(type, with_period, without)`` per type -> plus ``score``; abbreviations reach ``ABBREVIATION``."""
    totals = types.agg(F.sum(F.col("with_period") + F.col("without")).alias("n"), F.sum("with_period").alias("p")).select(F.struct("n", "p")).scalar()
    a, ab = (F.col("with_period") + F.col("without")).cast("double"), F.col("with_period").cast("double")
    p1 = totals["p"] / totals["n"]
    null = ab * _log(p1) + (a - ab) * _log(1 - p1)
    alternative = ab * F.ln(F.lit(0.99)) + (a - ab) * F.ln(F.lit(0.01))
    inner = F.length(F.regexp_replace("type", r"\.", ""))
    periods = F.length("type") - inner + 1
    score = -2 * (null - alternative) * F.exp(-inner.cast("double")) * periods * F.pow(inner.cast("double"), -F.col("without").cast("double"))
    word = (F.col("with_period") > 0) & (F.col("type") != NUMBER) & F.col("type").rlike(r"\p{L}")
    return types.withColumn("score", F.when(word, score).otherwise(F.lit(0.0)))


def type_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``(type, with_period, without)``: tokens of every type with and without a final period."""
    # every different token is looked at once
    each = df.select(F.explode(_tokens(F.col(text_col))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    period, _, _ = _marks(F.col("t"))
    typed = each.select(token_type(F.col("t")).alias("type"), period.alias("p"), "n").where(F.col("type") != "")
    counted = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return typed.groupBy("type").agg(counted(F.col("p")).alias("with_period"), counted(~F.col("p")).alias("without"))


def train(df: DataFrame, text_col: str = "text") -> Boundaries:
    """Learn from all texts."""
    types = cut_lineage(type_counts(df, text_col))
    abbreviations = cut_lineage(abbreviation_scores(types).where(F.col("score") >= ABBREVIATION).select("type"))

    words = _tokens(F.col(text_col))
    pairs = df.select(F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), words).alias("a"), words.alias("b"))).alias("e")).select("e.a", "e.b")
    # a first token without a terminator is only a class; every different pair is looked at once
    a = F.col("a")
    plain = (a != "") & ~a.contains(".") & ~a.contains("!") & ~a.contains("?")
    pairs = pairs.where(F.col("b").isNotNull()).groupBy(F.when(plain, "x").otherwise(a).alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    period, other, initial = _marks(F.col("a"))
    ends = F.when(F.col("a") == "", "start").when(period, "period").when(other, "other").otherwise("none")
    kept = pairs.select(
        ends.alias("ends"),
        F.when(period, token_type(F.col("a"))).alias("first"),  # a first token without a period is only a class
        F.coalesce(F.when(period, initial), F.lit(False)).alias("initial"),
        token_type(F.col("b")).alias("second"),
        _first_upper(F.col("b")).alias("upper"),
        _first_lower(F.col("b")).alias("lower"),
        (F.regexp_count("b", F.lit(r"^[\"'\(\[]*\p{L}")) > 0).alias("alpha"),
        "n",
    )
    counted = cut_lineage(kept.groupBy(*kept.columns[:-1]).agg(F.sum("n").alias("n")))
    named = counted.join(abbreviations.select(F.col("type").alias("first"), F.lit(True).alias("abbr")), "first", "left")
    breaks = (F.col("ends") == "other") | ((F.col("ends") == "period") & F.col("abbr").isNull())
    place = F.when(breaks | (F.col("ends") == "start"), "first").when(F.col("abbr"), "unknown").otherwise("inside")
    seen = cut_lineage(named.withColumn("breaks", breaks).withColumn("place", place))

    def any_of(c):
        return F.coalesce(F.bool_or(c), F.lit(False))

    cases = seen.where(F.col("second") != "").groupBy(F.col("second").alias("type")).agg(
        any_of(F.col("lower")).alias("lower"),
        any_of(F.col("upper") & (F.col("place") == "inside")).alias("upper_inside"),
        any_of(F.col("upper")).alias("upper"),
        any_of(F.col("lower") & (F.col("place") == "first")).alias("lower_first"),
    )
    total = types.agg(F.sum(F.col("with_period") + F.col("without")).cast("double")).scalar()
    breaks_n = seen.where("breaks").agg(F.sum("n").cast("double")).scalar()
    ordinary = F.col("breaks") & ~F.col("initial") & ~F.coalesce(F.col("first") == NUMBER, F.lit(False)) & F.col("alpha")
    at_break = seen.where(ordinary).groupBy(F.col("second").alias("type")).agg(F.sum("n").cast("double").alias("ab"))
    typed = at_break.join(types, "type").withColumn("b", (F.col("with_period") + F.col("without")).cast("double"))
    likely = F.try_divide(total, breaks_n) > F.col("b") / F.col("ab")
    starters = typed.where((_association(breaks_n, F.col("b"), F.col("ab"), total) >= STARTER) & likely).select("type")
    numbered = F.col("breaks") & (F.col("initial") | (F.col("first") == NUMBER)) & (F.col("second") != "")
    met = seen.where(numbered).groupBy("first", "second").agg(F.sum("n").cast("double").alias("ab")).where(F.col("ab") > 1)
    both = met.join(types.select(F.col("type").alias("first"), (F.col("with_period") + F.col("without")).cast("double").alias("a")), "first")
    both = both.join(types.select(F.col("type").alias("second"), (F.col("with_period") + F.col("without")).cast("double").alias("b")), "second")
    joined = (_association(F.col("a"), F.col("b"), F.col("ab"), total) >= COLLOCATION) & (total / F.col("a") > F.col("b") / F.col("ab"))
    collocations = both.where(joined).select("first", "second")
    return Boundaries(abbreviations, cut_lineage(starters), cut_lineage(collocations), cut_lineage(cases))


def decide(cuts: DataFrame, model: Boundaries) -> DataFrame:
    """``cuts`` with the columns ``a`` and ``b`` (the tokens before and behind) -> plus ``breaks``."""
    period, other, initial = _marks(F.col("a"))
    d = cuts.withColumn("first", token_type(F.col("a"))).withColumn("second", token_type(F.col("b")))
    d = d.join(model.abbreviations.select(F.col("type").alias("first"), F.lit(True).alias("__abbr")), "first", "left")
    d = d.join(model.starters.select(F.col("type").alias("second"), F.lit(True).alias("__starts")), "second", "left")
    d = d.join(model.collocations.withColumn("__pair", F.lit(True)), ["first", "second"], "left")
    d = d.join(model.cases.select(F.col("type").alias("second"), *[F.col(c).alias(f"__{c}") for c in ("lower", "upper_inside", "upper", "lower_first")]), "second", "left")
    flag = lambda c: F.coalesce(F.col(f"__{c}"), F.lit(False))
    up, low = _first_upper(F.col("b")), _first_lower(F.col("b"))
    # does the token behind begin a sentence, by how its type is written elsewhere: true, false, or null where that says nothing
    starts = F.when(~F.col("b").rlike(r"[\p{L}\p{N}]"), False).when(up & flag("lower") & ~flag("upper_inside"), True).when(
        low & (flag("upper") | ~flag("lower_first")), False
    )
    abbreviated = flag("abbr") & ~initial
    counted = initial | (F.col("first") == NUMBER)
    breaks = (
        F.when(other & ~period, True)
        .when(flag("pair"), False)
        .when(abbreviated, F.coalesce(starts, F.lit(False)) | (up & flag("starts")))
        .when(counted & ~starts, False)
        .when(counted & initial & starts.isNull() & up & ~flag("lower"), False)
        .when(flag("abbr"), F.coalesce(starts, F.lit(False)))
        .otherwise(True)
    )
    return d.withColumn("breaks", breaks).select(*cuts.columns, "breaks")


def split(df: DataFrame, model: Boundaries, id_col: str = "id", text_col: str = "text", bucket_size: int = 64) -> DataFrame:
    """``id, sentence_no, sentence``: sentences numbered from 0 in each text; rows with one id must be one text."""
    marked = F.regexp_replace(F.col(text_col), r"([.!?][\"'\)\]]*)(\s+)", "$1\u0001$2")
    pieces = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.split(marked, "\u0001", -1).alias("p"))
    last = lambda x: F.regexp_extract(x, r"(\S+)\s*\z", 1)
    first = lambda x: F.regexp_extract(x, r"^\s*(\S+)", 1)
    each = F.transform("p", lambda x, k: F.struct(k.alias("no"), x.alias("piece"), last(x).alias("a"), F.coalesce(first(F.get("p", k + 1)), F.lit("")).alias("b")))
    rows = pieces.select("id", F.inline(each))
    # written: the totals and the numbers both read it
    decided = cut_lineage(decide(rows, model).select("id", "no", "piece", F.when(F.col("breaks"), 1).otherwise(0).alias("step")))
    numbered = exclusive_prefix_sum(decided, ["id"], ["no"], "step", "sentence_no", bucket_size)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "piece"))), lambda x: x["piece"]), "")
    out = numbered.groupBy("id", "sentence_no").agg(T.strip_ws(joined).alias("sentence"))
    return out.where(F.col("sentence") != "").select(F.col("id").alias(id_col), F.col("sentence_no").cast("long").alias("sentence_no"), "sentence")
