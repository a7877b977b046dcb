"""Lexicon sentiment per sentence (inventory D).

The scoring arithmetic follows the published VADER rules (Hutto & Gilbert,
ICWSM 2014): a sentence's valence is the sum of its tokens' lexicon valences;
``compound = s / sqrt(s^2 + 15)``; the positive / negative / neutral shares
count a positive token as ``v + 1``, a negative one as ``v - 1`` and any other
token as 1.  The lexicon is data supplied by the caller as a DataFrame
``(token, valence)``; none is shipped.

Execution: tokens are exploded and joined to the lexicon (Spark broadcasts it
when its size in bytes allows), then summed per sentence.  Optional modifiers
look back at most three tokens and ahead two inside the same sentence: sentences
are brought together by key as texts, and every token leaves its sentence with
its neighbours beside it, so tokens are neither shuffled nor sorted.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.session import local_table

ALPHA = 15.0
_BETWEEN = r"[^\p{L}\p{N}_']+"

# Fixed values of the published rule set (vaderSentiment, Copyright (c) 2016 C.J. Hutto, MIT licence).
NEGATION_SCALAR = -0.74
BOOSTER_INCREMENT = 0.293
CAPS_INCREMENT = 0.733
EXCLAMATION_INCREMENT = 0.292
QUESTION_INCREMENT = 0.18
NEVER_SO = 1.25
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
DISTANCE = (1.0, 0.95, 0.9)  # of a booster one, two and three tokens before
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "badass": 1.5, "bus stop": 0.0, "yeah right": -2.0,
    "kiss of death": -1.5, "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9,
}
NEGATIONS = [
    "aint", "arent", "cannot", "cant", "couldnt", "darent", "didnt", "doesnt",
    "ain't", "aren't", "can't", "couldn't", "daren't", "didn't", "doesn't",
    "dont", "hadnt", "hasnt", "havent", "isnt", "mightnt", "mustnt", "neither",
    "don't", "hadn't", "hasn't", "haven't", "isn't", "mightn't", "mustn't",
    "neednt", "needn't", "never", "none", "nope", "nor", "not", "nothing", "nowhere",
    "oughtnt", "shant", "shouldnt", "uhuh", "wasnt", "werent",
    "oughtn't", "shan't", "shouldn't", "uh-uh", "wasn't", "weren't",
    "without", "wont", "wouldnt", "won't", "wouldn't", "rarely", "seldom", "despite",
]
BOOST_UP = [
    "absolutely", "amazingly", "awfully", "completely", "considerable", "considerably",
    "decidedly", "deeply", "effing", "enormous", "enormously", "entirely", "especially",
    "exceptional", "exceptionally", "extreme", "extremely", "fabulously", "flipping",
    "flippin", "frackin", "fracking", "fricking", "frickin", "frigging", "friggin",
    "fully", "fuckin", "fucking", "fuggin", "fugging", "greatly", "hella", "highly",
    "hugely", "incredible", "incredibly", "intensely", "major", "majorly", "more", "most",
    "particularly", "purely", "quite", "really", "remarkably", "so", "substantially",
    "thoroughly", "total", "totally", "tremendous", "tremendously", "uber", "unbelievably",
    "unusually", "utter", "utterly", "very",
]
BOOST_DOWN = [
    "almost", "barely", "hardly", "kind of", "kinda", "kindof", "kind-of", "less",
    "little", "marginal", "marginally", "occasional", "occasionally", "partly",
    "scarce", "scarcely", "slight", "slightly", "somewhat", "sort of", "sorta",
    "sortof", "sort-of",
]


def sentiment_tokens(c):
    """Runs of letters, digits, ``_`` and ``'``; cut at what is none of them, which takes time in proportion to the text."""
    return F.filter(F.split(c, _BETWEEN), lambda t: t != "")


def lexicon_frame(spark, lexicon) -> DataFrame:
    """Accept a DataFrame ``(token, valence)`` or a dict and return the DataFrame."""
    if isinstance(lexicon, DataFrame):
        return lexicon.select(F.lower(F.col("token")).alias("token"), F.col("valence").cast("double").alias("valence"))
    rows = [(k.lower(), float(v)) for k, v in dict(lexicon).items()]
    return local_table(spark, rows, "token string, valence double")


def score_sentences(
    sentences: DataFrame,
    lexicon,
    keys=("id", "sentence_no"),
    sentence_col: str = "sentence",
    modifiers: bool | str = False,
    negations=None,
) -> DataFrame:
    """D1 (+ D2 when ``modifiers``): ``keys + (compound, pos, neu, neg)`` per sentence.

    ``modifiers``: False (base form), True (all published rules, see
    ``_apply_rules``, and ``!``/``?`` emphasis) or ``"negation"`` (the factor of
    each negation among the three tokens before).  ``negations`` replaces the
    negation word list.
    """
    spark = sentences.sparkSession
    keys = list(keys)
    lex = lexicon_frame(spark, lexicon)
    if modifiers:
        grouped = sentences.groupBy(*keys).agg(F.collect_list(F.struct(sentence_col)).alias("__s"))
        toks = _with_neighbours(grouped, keys, sentence_col, modifiers is True)
    else:
        toks = sentences.select(*keys, F.explode(sentiment_tokens(F.col(sentence_col))).alias("orig")).withColumn("token", F.lower("orig"))
    # a modifier only changes valences, so only tokens of the lexicon go on
    scored = toks.join(lex, "token", "inner" if modifiers else "left").withColumn("v", F.coalesce(F.col("valence"), F.lit(0.0)))
    if modifiers is True:
        scored = _apply_rules(scored, lex, negations or NEGATIONS)
    elif modifiers:
        scored = _apply_negation(scored, negations or NEGATIONS)
    agg = scored.groupBy(*keys).agg(
        F.sum("v").alias("s"),
        F.sum(F.when(F.col("v") > 0, F.col("v") + 1).otherwise(0.0)).alias("pos_sum"),
        F.sum(F.when(F.col("v") < 0, F.col("v") - 1).otherwise(0.0)).alias("neg_sum"),
        F.sum(F.when(F.col("v") == 0, 1).otherwise(0)).alias("neu_count"),
        F.sum(F.when(F.col("v") != 0, 1).otherwise(0)).alias("hits"),
    )
    if modifiers:
        # tokens of the key without a valence; null keys meet no sums
        n = F.aggregate("__s", F.lit(0), lambda a, s: a + F.greatest(F.size(sentiment_tokens(s[sentence_col])), F.lit(0)))
        met = functools.reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))
        base = grouped.select(*keys, "__s", F.when(met, n).otherwise(0).alias("n")).join(agg.drop("neu_count"), keys, "left")
        base = base.withColumn("neu_count", F.col("n") - F.coalesce("hits", F.lit(0)))
        joined = base.select(*keys, "s", "pos_sum", "neg_sum", "neu_count", F.inline("__s"))
    else:
        joined = sentences.select(*keys, sentence_col).join(agg, keys, "left")
    emph = _punctuation_emphasis(F.col(sentence_col)) if modifiers is True else F.lit(0.0)
    out = joined.withColumn("emph", emph).select(
        *keys,
        sentence_col,
        F.coalesce("s", F.lit(0.0)).alias("s"),
        F.coalesce("pos_sum", F.lit(0.0)).alias("pos_sum"),
        F.coalesce("neg_sum", F.lit(0.0)).alias("neg_sum"),
        F.coalesce("neu_count", F.lit(0)).cast("double").alias("neu_count"),
        "emph",
    )
    # emphasis pushes the sum (and the larger side) further from zero
    s = F.when(F.col("s") > 0, F.col("s") + F.col("emph")).when(F.col("s") < 0, F.col("s") - F.col("emph")).otherwise(F.col("s"))
    pos_sum = F.when(F.col("pos_sum") > F.abs("neg_sum"), F.col("pos_sum") + F.col("emph")).otherwise(F.col("pos_sum"))
    neg_sum = F.when(F.col("pos_sum") < F.abs("neg_sum"), F.col("neg_sum") - F.col("emph")).otherwise(F.col("neg_sum"))
    out = out.select(*keys, sentence_col, s.alias("s"), pos_sum.alias("ps"), neg_sum.alias("ns"), "neu_count")
    total = F.col("ps") + F.abs("ns") + F.col("neu_count")
    return out.select(
        *keys,
        sentence_col,
        (F.col("s") / F.sqrt(F.col("s") * F.col("s") + F.lit(ALPHA))).alias("compound"),
        F.coalesce(F.try_divide(F.abs("ps"), total), F.lit(0.0)).alias("pos"),
        F.coalesce(F.try_divide(F.col("neu_count"), total), F.lit(1.0)).alias("neu"),
        F.coalesce(F.try_divide(F.abs("ns"), total), F.lit(0.0)).alias("neg"),
    )


def score_pieces(pieces: DataFrame, lexicon, keys=("id", "sentence_no"), piece_col: str = "piece") -> DataFrame:
    """D1 base form from sentence pieces, without assembling sentence text.

    A token never crosses a piece boundary, so a sentence's sums are the sums
    over its pieces' tokens: one aggregation per sentence whose shuffle
    carries partial sums (tokens of one sentence mostly meet map-side).
    Blank sentences are dropped; a sentence without tokens scores
    compound 0, neu 1.  Equal to ``score_sentences`` on ``sentence_table``.
    """
    spark = pieces.sparkSession
    keys = list(keys)
    lex = lexicon_frame(spark, lexicon)
    toks = pieces.select(
        *keys,
        (F.regexp_replace(F.col(piece_col), r"^\s+|\s+$", "") != F.lit("")).alias("nonblank"),
        F.explode_outer(sentiment_tokens(F.col(piece_col))).alias("orig"),
    ).withColumn("token", F.lower("orig"))
    scored = toks.join(lex, "token", "left").withColumn(
        "v", F.when(F.col("token").isNotNull(), F.coalesce(F.col("valence"), F.lit(0.0)))
    )
    agg = scored.groupBy(*keys).agg(
        F.max("nonblank").alias("nonblank"),
        F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"),
        F.sum(F.when(F.col("v") > 0, F.col("v") + 1).otherwise(0.0)).alias("ps"),
        F.sum(F.when(F.col("v") < 0, F.col("v") - 1).otherwise(0.0)).alias("ns"),
        F.sum(F.when(F.col("v") == 0, 1.0).otherwise(0.0)).alias("neu_count"),
    ).where(F.col("nonblank"))
    total = F.col("ps") + F.abs("ns") + F.col("neu_count")
    return agg.select(
        *keys,
        (F.col("s") / F.sqrt(F.col("s") * F.col("s") + F.lit(ALPHA))).alias("compound"),
        F.coalesce(F.try_divide(F.abs("ps"), total), F.lit(0.0)).alias("pos"),
        F.coalesce(F.try_divide(F.col("neu_count"), total), F.lit(1.0)).alias("neu"),
        F.coalesce(F.try_divide(F.abs("ns"), total), F.lit(0.0)).alias("neg"),
    )


def _punctuation_emphasis(c):
    ex = F.least(F.regexp_count(c, F.lit("!")), F.lit(4)).cast("double") * F.lit(EXCLAMATION_INCREMENT)
    qm = F.regexp_count(c, F.lit(r"\?"))
    q = F.when(qm <= 1, F.lit(0.0)).when(qm <= 3, qm.cast("double") * F.lit(QUESTION_INCREMENT)).otherwise(F.lit(0.96))
    return ex + q


def _with_neighbours(grouped: DataFrame, keys, sentence_col: str, rules: bool) -> DataFrame:
    """``keys, pos, orig, token`` of every token and the tokens before it, ``p1..p3``; with ``rules`` also ``upper``, ``u1..u3``
    (whether those are upper case), ``n1, n2`` (tokens behind), ``mixed`` (the sentence has upper-case words and others) and
    ``but`` (place of its first ``but``).  ``grouped`` lists the sentences ``__s`` of a key; several are one, in the order of
    ``pos``."""
    placed = F.transform("__s", lambda s: F.transform(sentiment_tokens(s[sentence_col]), lambda t, k: F.struct(k.alias("pos"), t.alias("orig"))))
    several = F.array_sort(F.flatten(F.filter(placed, lambda t: t.isNotNull())))
    one = sentiment_tokens(F.col("__s")[0][sentence_col])
    # tokens of one row stand in order already
    d = grouped.select(*keys, F.when(F.size("__s") > 1, several).alias("__t"), one.alias("__one"))
    d = d.withColumn("__o", F.coalesce(F.col("__t.orig"), F.col("__one"))).withColumn("__a", F.transform("__o", lambda t: F.lower(t)))
    d = d.withColumn("__p", F.coalesce(F.col("__t.pos"), F.sequence(F.lit(0), F.size("__o"))))
    back = lambda c, k, kind: F.concat(F.array_repeat(F.lit(None).cast(kind), k), F.col(c))
    fields = [F.col("__p").alias("pos"), F.col("__o").alias("orig"), F.col("__a").alias("token")]
    fields += [back("__a", k, "string").alias(f"p{k}") for k in (1, 2, 3)]
    beside = []
    if rules:
        d = d.withColumn("__u", F.transform("__o", lambda t: t.rlike(r"\p{L}") & (t == F.upper(t))))
        d = d.withColumn("mixed", F.array_contains("__u", True) & F.array_contains("__u", False))
        d = d.withColumn("but", F.get("__p", F.nullif(F.array_position("__a", F.lit("but")), F.lit(0)).cast("int") - 1))
        fields += [F.col("__u").alias("upper"), *[back("__u", k, "boolean").alias(f"u{k}") for k in (1, 2, 3)]]
        fields += [F.slice("__a", k + 1, F.size("__a")).alias(f"n{k}") for k in (1, 2)]
        beside = ["mixed", "but"]
    # the shifted arrays are longer: what is behind the last token is no token
    return d.select(*keys, *beside, F.inline(F.arrays_zip(*fields))).where(F.col("orig").isNotNull())


def _apply_negation(scored: DataFrame, negations) -> DataFrame:
    """Each of the three positions before a token applies the factor once."""
    neg_words = F.array(*[F.lit(x) for x in negations])

    def is_neg(c):
        return F.coalesce(F.array_contains(neg_words, c) | c.endswith("n't"), F.lit(False))

    before = sum((is_neg(F.col(f"p{k}")).cast("int") for k in (2, 3)), is_neg(F.col("p1")).cast("int"))
    factor = F.element_at(F.array(*[F.lit(NEGATION_SCALAR**k) for k in range(4)]), before + 1)
    return scored.withColumn("before", factor).withColumn("v", F.when(F.col("v") != 0, F.col("v") * F.col("before")).otherwise(F.col("v")))


def _apply_rules(scored: DataFrame, lex: DataFrame, negations) -> DataFrame:
    """The published rules, in their order, for every token with a valence:

    1. ``no`` before a lexicon word is no word of its own; a lexicon word behind
       ``no`` (next to it, one further, or two further with ``or``/``nor``
       between) is negated;
    2. capitals, in a sentence that has words of both kinds;
    3. for the tokens one, two, three before, each only if it is not in the
       lexicon itself: a booster (damped by distance), then negation with its
       exceptions ``never so/this`` and ``without doubt``; behind the third,
       idioms and two-word boosters;
    4. ``least`` (but not ``at least``, ``very least``);
    5. ``but``: halves what stands before the sentence's first, raises what follows.

    Boosters and ``kind`` of ``kind of`` have no valence of their own.
    """
    d = scored.withColumn("known", F.col("valence").isNotNull())
    # which neighbours are in the lexicon themselves
    held = lex.where(F.col("valence").isNotNull()).select("token").distinct()
    for name, c in (("k1", "p1"), ("k2", "p2"), ("k3", "p3"), ("nk", "n1")):
        d = d.join(held.select(F.col("token").alias(c), F.lit(True).alias(name)), c, "left").withColumn(name, F.col(name).isNotNull())

    def listed(c, words):
        return F.coalesce(c.isin(list(words)), F.lit(False))

    def yes(c):
        return F.coalesce(c, F.lit(False))

    def negated(c):
        return listed(c, negations) | yes(c.contains("n't"))

    p1, p2, p3, n1, n2, token = (F.col(c) for c in ("p1", "p2", "p3", "n1", "n2", "token"))
    up, down = set(BOOST_UP), set(BOOST_DOWN)
    own = F.col("known") & ~listed(token, up | down) & ~yes((token == "kind") & (n1 == "of"))
    steps = [F.when(yes((token == "no") & F.col("nk")), F.lit(0.0)).otherwise(F.col("valence"))]
    after_no = yes(p1 == "no") | yes(p2 == "no") | (yes(p3 == "no") & listed(p1, ("or", "nor")))
    steps.append(F.when(after_no, F.col("valence") * NEGATION_SCALAR).otherwise(F.col("r")))
    sign = F.when(F.col("r") > 0, 1.0).otherwise(-1.0)
    steps.append(F.when(F.col("upper") & F.col("mixed"), F.col("r") + sign * CAPS_INCREMENT).otherwise(F.col("r")))
    so = ("so", "this")
    negation = {
        1: F.when(negated(p1), NEGATION_SCALAR),
        2: F.when(yes(p2 == "never") & listed(p1, so), NEVER_SO)
        .when(yes((p2 == "without") & (p1 == "doubt")), 1.0)
        .when(negated(p2), NEGATION_SCALAR),
        3: F.when(yes(p3 == "never") & (listed(p2, so) | listed(p1, so)), NEVER_SO)
        .when(yes(p3 == "without") & (yes(p2 == "doubt") | yes(p1 == "doubt")), 1.0)
        .when(negated(p3), NEGATION_SCALAR),
    }
    for k in (1, 2, 3):
        here = F.col(f"p{k}").isNotNull() & ~yes(F.col(f"k{k}"))
        size = F.when(listed(F.col(f"p{k}"), up), BOOSTER_INCREMENT).when(listed(F.col(f"p{k}"), down), -BOOSTER_INCREMENT)
        size = F.when(F.col("r") < 0, -size).otherwise(size)
        shout = F.when(yes(F.col(f"u{k}")) & F.col("mixed"), F.when(F.col("r") > 0, CAPS_INCREMENT).otherwise(-CAPS_INCREMENT)).otherwise(0.0)
        boost = F.coalesce((size + shout) * DISTANCE[k - 1], F.lit(0.0))
        steps.append(F.when(here, F.col("r") + boost).otherwise(F.col("r")))
        steps.append(F.when(here, F.col("r") * F.coalesce(negation[k], F.lit(1.0))).otherwise(F.col("r")))
    here = p3.isNotNull() & ~yes(F.col("k3"))
    join = lambda *c: F.concat_ws(" ", *c)
    idiom = lambda c: F.coalesce(*[F.when(c == x, F.lit(v)) for x, v in IDIOMS.items()])
    behind = F.coalesce(*[idiom(c) for c in (join(p1, token), join(p2, p1, token), join(p2, p1), join(p3, p2, p1), join(p3, p2))])
    ahead = F.coalesce(F.when(n2.isNotNull(), idiom(join(token, n1, n2))), F.when(n1.isNotNull(), idiom(join(token, n1))))
    steps.append(F.when(here, F.coalesce(ahead, behind, F.col("r"))).otherwise(F.col("r")))
    two = lambda c: F.when(listed(c, up), BOOSTER_INCREMENT).when(listed(c, down), -BOOSTER_INCREMENT).otherwise(0.0)
    steps.append(F.when(here, F.col("r") + two(join(p3, p2)) + two(join(p2, p1))).otherwise(F.col("r")))
    least = yes(p1 == "least") & ~yes(F.col("k1")) & ~listed(p2, ("at", "very"))
    steps.append(F.when(least, F.col("r") * NEGATION_SCALAR).otherwise(F.col("r")))
    but = F.when(F.col("pos") < F.col("but"), BEFORE_BUT).when(F.col("pos") > F.col("but"), AFTER_BUT).otherwise(1.0)
    steps.append(F.col("r") * but)
    for step in steps:
        d = d.withColumn("r", step)
    return d.withColumn("v", F.when(own, F.col("r")).otherwise(F.lit(0.0)))


def sentiment_summary(scores: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Mean / min / max compound per transcript; null for a transcript without sentences."""
    agg = scores.groupBy(id_col).agg(
        F.avg("compound").alias("average_sentence_sentiment"),
        F.min("compound").alias("minimum_sentence_sentiment"),
        F.max("compound").alias("maximum_sentence_sentiment"),
    )
    return ids.select(id_col).join(agg, id_col, "left")


def append_rows(*frames: DataFrame) -> DataFrame:
    """Row append by column name (``pd.concat(ignore_index=True)``)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
