"""Driver queries for the assembled feature table (G1, H8) and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens.operators import prep as H
from convlens.plans import pipelines as PL
from convlens.plans.q_bow import conv_cv_body, wl_cte
from convlens.plans.q_sentiment import DRIVER_LEXICON, _lex_sql, _score_sql
from convlens.plans.q_transcripts import DRIVER_FILLERS, SENTENCES_BODY, _filler_sql_rows, conv_parts
from convlens.plans.registry import query
from convlens.plans.sqlparts import INDIVIDUAL_BODY, TURNS_CTE, wc

FEATURE_COLUMNS = [
    "id", "filler_pct", "speaker_balance", "total_word_count",
    "word_length_2", "word_length_3", "word_length_4", "word_length_5", "word_length_6", "word_length_7",
    "word_length_8_plus", "average_sentence_sentiment", "minimum_sentence_sentiment", "maximum_sentence_sentiment",
    "similarity", "interviewer_length", "interviewee_length", "ratio",
]


def features_cte() -> str:
    return (
        _lex_sql() + "," + TURNS_CTE + "," + SENTENCES_BODY + "," + _score_sql("csent", "id, sentence_no", False) + ","
        + conv_cv_body() + "," + wl_cte("ccv", "(SELECT id FROM st)", "wlf") + "," + INDIVIDUAL_BODY
        + ", fil AS (" + _filler_sql_rows() + "),\n"
        + f"""fh AS (SELECT id, sum(n) AS hits FROM fil GROUP BY id),
fb AS (
  SELECT st.id,
         CASE WHEN {wc('interviewee_text')} = 0 THEN 0.0 ELSE coalesce(fh.hits, 0)::DOUBLE / {wc('interviewee_text')} END AS filler_pct,
         CASE WHEN {wc('interviewer_text')} + {wc('interviewee_text')} = 0 THEN 0.0
              ELSE {wc('interviewee_text')}::DOUBLE / ({wc('interviewer_text')} + {wc('interviewee_text')}) END AS speaker_balance
  FROM st LEFT JOIN fh USING (id)
),
sm AS (
  SELECT st.id, avg(compound) AS average_sentence_sentiment, min(compound) AS minimum_sentence_sentiment,
         max(compound) AS maximum_sentence_sentiment
  FROM st LEFT JOIN scored USING (id) GROUP BY st.id
),
feat AS (
  SELECT fb.id, fb.filler_pct, fb.speaker_balance, wlf.total_word_count,
         wlf.word_length_2, wlf.word_length_3, wlf.word_length_4, wlf.word_length_5, wlf.word_length_6, wlf.word_length_7,
         wlf.word_length_8_plus, sm.average_sentence_sentiment, sm.minimum_sentence_sentiment, sm.maximum_sentence_sentiment,
         ind.similarity, ind.interviewer_length::BIGINT AS interviewer_length, ind.interviewee_length::BIGINT AS interviewee_length, ind.ratio
  FROM fb JOIN wlf USING (id) JOIN sm USING (id) JOIN ind USING (id)
)
"""
    )


def feature_table(spark, sf):
    return PL.feature_table(conv_parts(spark, sf), DRIVER_LEXICON, DRIVER_FILLERS).select(*FEATURE_COLUMNS)


@query("g1_assemble_features", "WITH " + features_cte() + "SELECT * FROM feat")
def g1(spark, sf):
    return feature_table(spark, sf)


REDUCED = ["id", "filler_pct", "word_length_6", "word_length_7", "word_length_8_plus", "average_sentence_sentiment", "ratio"]


@query("h8_drop_list", "WITH " + features_cte() + "SELECT " + ", ".join(REDUCED) + " FROM feat")
def h8(spark, sf):
    parts = conv_parts(spark, sf)
    members, _, _ = PL.transcript_analysis(parts, k=5, seed=42, dim=64)
    return H.reduced_features(PL.feature_table(parts, DRIVER_LEXICON, DRIVER_FILLERS, clusters=members.select("id", "cluster")))
