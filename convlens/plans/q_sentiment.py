"""Driver queries for inventory D (lexicon sentiment)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens.functions import text as T
from convlens.operators import sentiment as S
from convlens.operators import transcripts as TR
from convlens.plans.q_transcripts import SENTENCES_CTE, conv_parts
from convlens.plans.registry import query, table
from convlens.plans.sqlparts import strip

# A small lexicon of tokens that occur in the synthetic text (the real
# lexicon is caller data).
DRIVER_LEXICON = {
    "the": 1.5, "and": -0.8, "de": 2.1, "la": -1.2, "der": 0.9, "en": 0.4,
    "die": -2.4, "que": 1.1, "no": -1.9, "nicht": -0.6, "er": 0.3, "re": -0.5,
}
DRIVER_NEGATIONS = ["no", "nicht"]


def _lex_sql() -> str:
    rows = ", ".join(f"('{k}', {v})" for k, v in DRIVER_LEXICON.items())
    return f"lex(token, valence) AS (VALUES {rows})"


def doc_sentences(spark, sf):
    """B13 row-local on each document: ``(doc_id, sentence_no, sentence)``."""
    d = table(spark, sf, "documents")
    return (
        d.select("doc_id", F.posexplode(T.sentence_pieces(F.coalesce("text", F.lit("")))).alias("sentence_no", "s"))
        .select("doc_id", F.col("sentence_no").cast("bigint").alias("sentence_no"), T.strip_ws("s").alias("sentence"))
        .where(F.col("sentence") != "")
    )


DOC_SENT_CTE = r"""
sp AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS arr FROM documents),
ex AS (SELECT doc_id, unnest(range(len(arr))) AS sentence_no, unnest(arr) AS s FROM sp),
sents AS (SELECT doc_id, sentence_no, """ + strip("s") + " AS sentence FROM ex WHERE " + strip("s") + " <> '')"


def _score_sql(sent: str, keys: str, negation: bool) -> str:
    """Oracle for the base form (and negation-only) over a sentence CTE."""
    neg = ", ".join(f"'{w}'" for w in DRIVER_NEGATIONS)
    v = "coalesce(l.valence, 0.0)"
    if negation:
        lags = " + ".join(
            f"coalesce(lag(tk.token, {k}) OVER (PARTITION BY {keys} ORDER BY tk.pos) IN ({neg}) OR ends_with(lag(tk.token, {k}) OVER (PARTITION BY {keys} ORDER BY tk.pos), 'n''t'), false)::INTEGER"
            for k in (1, 2, 3)
        )
        v = f"coalesce(l.valence, 0.0)::DOUBLE * [{', '.join(repr((-0.74) ** k) + '::DOUBLE' for k in range(4))}][{lags} + 1]"
    return f"""
tk0 AS (SELECT {keys}, regexp_extract_all({sent}.sentence, '[\\p{{L}}\\p{{N}}_'']+') AS arr FROM {sent}),
tk AS (SELECT {keys}, unnest(range(len(arr))) AS pos, lower(unnest(arr)) AS token FROM tk0),
sc AS (SELECT {", ".join("tk." + k.strip() for k in keys.split(","))}, {v} AS v FROM tk LEFT JOIN lex l ON l.token = tk.token),
ag AS (
  SELECT {keys}, sum(v) AS s,
         sum(CASE WHEN v > 0 THEN v + 1 ELSE 0.0 END) AS ps,
         sum(CASE WHEN v < 0 THEN v - 1 ELSE 0.0 END) AS ns,
         sum(CASE WHEN v = 0 THEN 1 ELSE 0 END)::DOUBLE AS nc
  FROM sc GROUP BY {keys}
),
scored AS (
  SELECT {", ".join("x." + k.strip() for k in keys.split(","))}, x.sentence,
         coalesce(ag.s, 0.0) / sqrt(coalesce(ag.s, 0.0) * coalesce(ag.s, 0.0) + 15.0) AS compound,
         CASE WHEN coalesce(ag.ps, 0) + abs(coalesce(ag.ns, 0)) + coalesce(ag.nc, 0) = 0 THEN 0.0
              ELSE abs(ag.ps) / (ag.ps + abs(ag.ns) + ag.nc) END AS pos,
         CASE WHEN coalesce(ag.ps, 0) + abs(coalesce(ag.ns, 0)) + coalesce(ag.nc, 0) = 0 THEN 1.0
              ELSE ag.nc / (ag.ps + abs(ag.ns) + ag.nc) END AS neu,
         CASE WHEN coalesce(ag.ps, 0) + abs(coalesce(ag.ns, 0)) + coalesce(ag.nc, 0) = 0 THEN 0.0
              ELSE abs(ag.ns) / (ag.ps + abs(ag.ns) + ag.nc) END AS neg
  FROM {sent} x LEFT JOIN ag USING ({keys})
)"""


@query(
    "d1_sentence_sentiment",
    "WITH " + _lex_sql() + "," + DOC_SENT_CTE + "," + _score_sql("sents", "doc_id, sentence_no", False)
    + " SELECT doc_id, sentence_no, compound, pos, neu, neg FROM scored",
)
def d1(spark, sf):
    s = S.score_sentences(doc_sentences(spark, sf), DRIVER_LEXICON, keys=("doc_id", "sentence_no"))
    return s.select("doc_id", "sentence_no", "compound", "pos", "neu", "neg")


@query(
    "d2_negation",
    "WITH " + _lex_sql() + "," + DOC_SENT_CTE + "," + _score_sql("sents", "doc_id, sentence_no", True)
    + " SELECT doc_id, sentence_no, compound, pos, neu, neg FROM scored",
)
def d2(spark, sf):
    s = S.score_sentences(
        doc_sentences(spark, sf), DRIVER_LEXICON, keys=("doc_id", "sentence_no"), modifiers="negation", negations=DRIVER_NEGATIONS
    )
    return s.select("doc_id", "sentence_no", "compound", "pos", "neu", "neg")


def _rules_sql() -> str:
    """Oracle of all rules: one CTE a step over the tokens of the documents' sentences."""
    words = lambda ws: "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in ws) + ")"
    inc = lambda c, yes: f"coalesce({c} IN {words(yes)}, false)"
    neg = lambda c: f"({inc(c, DRIVER_NEGATIONS)} OR coalesce(contains({c}, 'n''t'), false))"
    yes = lambda c: f"coalesce({c}, false)"
    w = "OVER (PARTITION BY doc_id, sentence_no ORDER BY pos)"
    g = "OVER (PARTITION BY doc_id, sentence_no)"
    lags = ", ".join(f"lag({c}, {k}) {w} AS {n}{k}" for k in (1, 2, 3) for n, c in (("p", "token"), ("k", "known"), ("u", "upr")))
    so = ("so", "this")
    factor = {
        1: f"CASE WHEN {neg('p1')} THEN {S.NEGATION_SCALAR} ELSE 1.0 END",
        2: f"CASE WHEN {yes('p2 = ' + repr('never'))} AND {inc('p1', so)} THEN {S.NEVER_SO} WHEN {yes('p2 = ' + repr('without'))} AND {yes('p1 = ' + repr('doubt'))} THEN 1.0 WHEN {neg('p2')} THEN {S.NEGATION_SCALAR} ELSE 1.0 END",
        3: f"CASE WHEN {yes('p3 = ' + repr('never'))} AND ({inc('p2', so)} OR {inc('p1', so)}) THEN {S.NEVER_SO} WHEN {yes('p3 = ' + repr('without'))} AND ({yes('p2 = ' + repr('doubt'))} OR {yes('p1 = ' + repr('doubt'))}) THEN 1.0 WHEN {neg('p3')} THEN {S.NEGATION_SCALAR} ELSE 1.0 END",
    }
    steps = [f"CASE WHEN {yes('token = ' + repr('no') + ' AND nk')} THEN 0.0 ELSE valence END::DOUBLE"]
    steps.append(f"CASE WHEN {yes('p1 = ' + repr('no'))} OR {yes('p2 = ' + repr('no'))} OR ({yes('p3 = ' + repr('no'))} AND {inc('p1', ('or', 'nor'))}) THEN valence * {S.NEGATION_SCALAR} ELSE r0 END::DOUBLE")
    steps.append(f"CASE WHEN upr AND mixed THEN r1 + CASE WHEN r1 > 0 THEN {S.CAPS_INCREMENT} ELSE -{S.CAPS_INCREMENT} END ELSE r1 END::DOUBLE")
    for k in (1, 2, 3):
        r, here = f"r{len(steps) - 1}", f"p{k} IS NOT NULL AND NOT {yes(f'k{k}')}"
        size = f"CASE WHEN {inc(f'p{k}', S.BOOST_UP)} THEN {S.BOOSTER_INCREMENT} WHEN {inc(f'p{k}', S.BOOST_DOWN)} THEN -{S.BOOSTER_INCREMENT} END * CASE WHEN {r} < 0 THEN -1 ELSE 1 END"
        shout = f"CASE WHEN {yes(f'u{k}')} AND mixed THEN CASE WHEN {r} > 0 THEN {S.CAPS_INCREMENT} ELSE -{S.CAPS_INCREMENT} END ELSE 0.0 END"
        steps.append(f"CASE WHEN {here} THEN {r} + coalesce(({size} + {shout})::DOUBLE * {S.DISTANCE[k - 1]}, 0.0) ELSE {r} END::DOUBLE")
        r = f"r{len(steps) - 1}"
        steps.append(f"CASE WHEN {here} THEN {r} * {factor[k]} ELSE {r} END::DOUBLE")
    here, r = f"p3 IS NOT NULL AND NOT {yes('k3')}", f"r{len(steps) - 1}"
    idiom = lambda c: "CASE " + " ".join(f"WHEN {c} = '{x}' THEN {v}::DOUBLE" for x, v in S.IDIOMS.items()) + " END"
    grams = ["token || ' ' || n1 || ' ' || n2", "token || ' ' || n1", "p1 || ' ' || token", "p2 || ' ' || p1 || ' ' || token", "p2 || ' ' || p1", "p3 || ' ' || p2 || ' ' || p1", "p3 || ' ' || p2"]
    steps.append(f"CASE WHEN {here} THEN coalesce({', '.join(idiom(x) for x in grams)}, {r}) ELSE {r} END::DOUBLE")
    r = f"r{len(steps) - 1}"
    two = lambda c: f"CASE WHEN {inc(c, S.BOOST_UP)} THEN {S.BOOSTER_INCREMENT} WHEN {inc(c, S.BOOST_DOWN)} THEN -{S.BOOSTER_INCREMENT} ELSE 0.0 END"
    steps.append(f"CASE WHEN {here} THEN {r} + {two(grams[6])} + {two(grams[4])} ELSE {r} END::DOUBLE")
    r = f"r{len(steps) - 1}"
    steps.append(f"CASE WHEN {yes('p1 = ' + repr('least'))} AND NOT {yes('k1')} AND NOT {inc('p2', ('at', 'very'))} THEN {r} * {S.NEGATION_SCALAR} ELSE {r} END::DOUBLE")
    r = f"r{len(steps) - 1}"
    steps.append(f"({r} * CASE WHEN pos < but_at THEN {S.BEFORE_BUT} WHEN pos > but_at THEN {S.AFTER_BUT} ELSE 1.0 END)::DOUBLE")
    chain = ", ".join(f"c{k} AS (SELECT *, {x} AS r{k} FROM {'wide' if k == 0 else f'c{k - 1}'})" for k, x in enumerate(steps))
    last = len(steps) - 1
    own = f"known AND NOT {inc('token', [*S.BOOST_UP, *S.BOOST_DOWN])} AND NOT {yes('token = ' + repr('kind') + ' AND n1 = ' + repr('of'))}"
    return f"""
t0 AS (SELECT doc_id, sentence_no, regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_'']+') AS arr FROM sents),
t1 AS (SELECT doc_id, sentence_no, unnest(range(len(arr))) AS pos, unnest(arr) AS orig FROM t0),
t2 AS (SELECT t1.*, lower(orig) AS token, regexp_matches(orig, '\\p{{L}}') AND orig = upper(orig) AS upr FROM t1),
t3 AS (SELECT t2.*, lex.valence::DOUBLE AS valence, lex.valence IS NOT NULL AS known FROM t2 LEFT JOIN lex USING (token)),
wide AS (SELECT *, {lags}, lead(token, 1) {w} AS n1, lead(token, 2) {w} AS n2, lead(known, 1) {w} AS nk,
                bool_or(upr) {g} AND NOT bool_and(upr) {g} AS mixed, min(CASE WHEN token = 'but' THEN pos END) {g} AS but_at FROM t3),
{chain},
vs AS (SELECT doc_id, sentence_no, CASE WHEN {own} THEN r{last} ELSE 0.0 END::DOUBLE AS v FROM c{last}),
ag AS (SELECT doc_id, sentence_no, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS ps, sum(CASE WHEN v < 0 THEN v - 1 ELSE 0 END) AS ns,
              count(*) FILTER (v = 0)::DOUBLE AS nc FROM vs GROUP BY doc_id, sentence_no),
em AS (SELECT doc_id, sentence_no, sentence, least(len(sentence) - len(replace(sentence, '!', '')), 4) * {S.EXCLAMATION_INCREMENT}::DOUBLE
         + CASE WHEN len(sentence) - len(replace(sentence, '?', '')) <= 1 THEN 0.0 WHEN len(sentence) - len(replace(sentence, '?', '')) <= 3
                THEN (len(sentence) - len(replace(sentence, '?', ''))) * {S.QUESTION_INCREMENT} ELSE 0.96 END::DOUBLE AS e FROM sents),
b AS (SELECT doc_id, sentence_no, e, coalesce(s, 0.0) AS s, coalesce(ps, 0.0) AS ps, coalesce(ns, 0.0) AS ns, coalesce(nc, 0.0) AS nc
      FROM em LEFT JOIN ag USING (doc_id, sentence_no)),
f AS (SELECT doc_id, sentence_no, nc, s + CASE WHEN s > 0 THEN e WHEN s < 0 THEN -e ELSE 0 END AS s,
             ps + CASE WHEN ps > abs(ns) THEN e ELSE 0 END AS ps, ns - CASE WHEN ps < abs(ns) THEN e ELSE 0 END AS ns FROM b)
SELECT doc_id, sentence_no, s / sqrt(s * s + 15.0) AS compound,
       CASE WHEN ps + abs(ns) + nc = 0 THEN 0.0 ELSE ps / (ps + abs(ns) + nc) END AS pos,
       CASE WHEN ps + abs(ns) + nc = 0 THEN 1.0 ELSE nc / (ps + abs(ns) + nc) END AS neu,
       CASE WHEN ps + abs(ns) + nc = 0 THEN 0.0 ELSE abs(ns) / (ps + abs(ns) + nc) END AS neg
FROM f"""


@query("d2_all_modifiers", "WITH " + _lex_sql() + "," + DOC_SENT_CTE + "," + _rules_sql())
def d2_all(spark, sf):
    s = S.score_sentences(
        doc_sentences(spark, sf), DRIVER_LEXICON, keys=("doc_id", "sentence_no"), modifiers=True, negations=DRIVER_NEGATIONS
    )
    return s.select("doc_id", "sentence_no", "compound", "pos", "neu", "neg")


_CONV_SENT = "WITH " + SENTENCES_CTE


def conv_sentence_scores(spark, sf):
    return S.score_sentences(TR.sentence_table(conv_parts(spark, sf)), DRIVER_LEXICON)


@query(
    "d3_sentence_table",
    _CONV_SENT.replace("WITH ", "WITH " + _lex_sql() + ",", 1) + "," + _score_sql("csent", "id, sentence_no", False)
    + " SELECT id, sentence_no, sentence, compound, pos, neu, neg FROM scored",
)
def d3(spark, sf):
    return conv_sentence_scores(spark, sf)


@query(
    "d4_sentiment_summary",
    _CONV_SENT.replace("WITH ", "WITH " + _lex_sql() + ",", 1) + "," + _score_sql("csent", "id, sentence_no", False)
    + """, ids AS (SELECT DISTINCT conv_id AS id FROM conversations)
SELECT ids.id, avg(compound) AS average_sentence_sentiment, min(compound) AS minimum_sentence_sentiment,
       max(compound) AS maximum_sentence_sentiment
FROM ids LEFT JOIN scored USING (id) GROUP BY ids.id""",
)
def d4(spark, sf):
    ids = table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct()
    # the summary needs no sentence text: score the pieces directly
    return S.sentiment_summary(S.score_pieces(TR.sentence_pieces(conv_parts(spark, sf)), DRIVER_LEXICON), ids)


@query(
    "d5_append_rows",
    "WITH " + _lex_sql() + "," + DOC_SENT_CTE + "," + _score_sql("sents", "doc_id, sentence_no", False) + """
SELECT 'document' AS source, doc_id AS id, avg(compound) AS average_sentence_sentiment FROM scored GROUP BY doc_id
UNION ALL
SELECT 'language' AS source, NULL::BIGINT AS id, avg(compound) AS average_sentence_sentiment FROM scored JOIN documents USING (doc_id) GROUP BY lang""",
)
def d5(spark, sf):
    s = S.score_sentences(doc_sentences(spark, sf), DRIVER_LEXICON, keys=("doc_id", "sentence_no"))
    per_doc = s.groupBy("doc_id").agg(F.avg("compound").alias("average_sentence_sentiment")).select(
        F.lit("document").alias("source"), F.col("doc_id").alias("id"), "average_sentence_sentiment"
    )
    langs = table(spark, sf, "documents").select("doc_id", "lang")
    per_lang = s.join(langs, "doc_id").groupBy("lang").agg(F.avg("compound").alias("average_sentence_sentiment")).select(
        F.lit("language").alias("source"), F.lit(None).cast("bigint").alias("id"), "average_sentence_sentiment"
    )
    return S.append_rows(per_doc, per_lang)
