"""Driver queries for inventory A1 and B (transcript parsing and text features)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens.functions import text as T
from convlens.operators import boundaries as BO
from convlens.operators import phrases as PH
from convlens.operators import subwords as W
from convlens.operators import transcripts as TR
from convlens.plans.registry import query, table
from convlens.plans.sqlparts import TURNS_CTE, ascii_word_view, rcount, strip, wc

# Driver dictionary: the default fillers never occur in the synthetic text,
# so the checked query uses entries that do (one regex entry, one phrase).
DRIVER_FILLERS = [
    ("the", None),
    ("and", None),
    ("of", None),
    ("th", r"\bth\p{L}+\b"),
    ("of the", None),
]


def conv_parts(spark, sf):
    return TR.parts_from_conversations(table(spark, sf, "conversations"))


def conv_labelled(spark, sf):
    return TR.label_parts(conv_parts(spark, sf))


def conv_transcripts(spark, sf):
    return TR.transcripts_from_conversations(table(spark, sf, "conversations"))


@query("a1_read_transcripts", "WITH " + TURNS_CTE + "SELECT id, string_agg(raw, '|' ORDER BY turn) AS transcript FROM t GROUP BY id")
def a1(spark, sf):
    return conv_transcripts(spark, sf)


@query("b1_split_turns", "WITH " + TURNS_CTE + "SELECT id, turn, sub, part FROM p")
def b1(spark, sf):
    return conv_parts(spark, sf)


@query("b1_split_transcript", "WITH " + TURNS_CTE + """,
tr AS (SELECT id, string_agg(raw, '|' ORDER BY turn) AS transcript FROM t GROUP BY id)
SELECT id, unnest(range(len(string_split(transcript, '|')))) AS turn, unnest(string_split(transcript, '|')) AS part FROM tr""")
def b1_string(spark, sf):
    return TR.parts_from_transcripts(conv_transcripts(spark, sf)).select("id", "turn", "part")


@query("b2_classify_turns", "WITH " + TURNS_CTE + "SELECT id, turn, sub, speaker FROM lp")
def b2(spark, sf):
    return conv_labelled(spark, sf).select("id", "turn", "sub", "speaker")


@query("b3_strip_labels", "WITH " + TURNS_CTE + "SELECT id, turn, sub, speaker, text FROM lt WHERE speaker IS NOT NULL")
def b3(spark, sf):
    return conv_labelled(spark, sf).where(F.col("speaker").isNotNull()).select("id", "turn", "sub", "speaker", "text")


@query("b4_parse_transcript", "WITH " + TURNS_CTE + "SELECT id, interviewer_text, interviewee_text FROM st")
def b4(spark, sf):
    return TR.speaker_texts(conv_labelled(spark, sf))


@query("b4_parse_transcript_rowwise", "WITH " + TURNS_CTE + "SELECT id, interviewer_text, interviewee_text FROM st")
def b4_rowwise(spark, sf):
    return TR.parse_transcript(conv_transcripts(spark, sf)).select("id", "interviewer_text", "interviewee_text")


@query("b5_parse_interviewee", "WITH " + TURNS_CTE + "SELECT id, interviewee_text FROM st")
def b5(spark, sf):
    return TR.parse_one_speaker(conv_transcripts(spark, sf)).select("id", "interviewee_text")


@query("b6_clean_labels", "WITH " + TURNS_CTE + r""",
tr AS (SELECT id, string_agg(raw, '|' ORDER BY turn) AS transcript FROM t GROUP BY id)
SELECT id, regexp_replace(regexp_replace(transcript, 'Interviewer:\s*', '', 'g'), 'Interviewee:\s*', '', 'g') AS clean_text FROM tr""")
def b6(spark, sf):
    return TR.clean_labels(conv_transcripts(spark, sf)).select("id", "clean_text")


@query("b7_speaker_lengths", "WITH " + TURNS_CTE + """
SELECT id, length(interviewer_text)::BIGINT AS interviewer_length, length(interviewee_text)::BIGINT AS interviewee_length FROM st""")
def b7(spark, sf):
    return TR.text_stats(conv_labelled(spark, sf)).select("id", "interviewer_length", "interviewee_length")


@query("b8_length_ratio", "WITH " + TURNS_CTE + """
SELECT id, length(interviewer_text)::BIGINT AS interviewer_length, length(interviewee_text)::BIGINT AS interviewee_length,
       CASE WHEN length(interviewer_text) = 0 THEN NULL ELSE length(interviewee_text)::DOUBLE / length(interviewer_text) END AS ratio
FROM st""")
def b8(spark, sf):
    return TR.length_features(conv_labelled(spark, sf))


@query("b9_word_counts", "WITH " + TURNS_CTE + f"""
SELECT id, {wc('interviewer_text')}::BIGINT AS interviewer_words, {wc('interviewee_text')}::BIGINT AS interviewee_words FROM st""")
def b9(spark, sf):
    return TR.text_stats(conv_labelled(spark, sf)).select("id", "interviewer_words", "interviewee_words")


@query("b10_speaker_balance", "WITH " + TURNS_CTE + f""",
w AS (SELECT id, {wc('interviewer_text')} AS a, {wc('interviewee_text')} AS b FROM st)
SELECT id, a::BIGINT AS interviewer_words, b::BIGINT AS interviewee_words,
       CASE WHEN a + b = 0 THEN 0.0 ELSE b::DOUBLE / (a + b) END AS speaker_balance FROM w""")
def b10(spark, sf):
    return TR.speaker_balance(conv_labelled(spark, sf))


def _filler_sql_rows():
    rows = []
    for name, pattern in DRIVER_FILLERS:
        rx = pattern if pattern is not None else r"\b" + name + r"\b"
        rows.append(f"SELECT id, '{name}' AS filler, {rcount(ascii_word_view('lower(interviewee_text)'), rx)}::BIGINT AS n FROM st")
    return "\nUNION ALL\n".join(rows)


@query(
    "b11_filler_counts",
    "WITH " + TURNS_CTE + ", ids AS (SELECT DISTINCT id FROM lt WHERE speaker = 'interviewee')\n"
    + "SELECT f.* FROM (" + _filler_sql_rows() + ") f JOIN ids USING (id)",
)
def b11(spark, sf):
    return TR.filler_counts(conv_labelled(spark, sf), "interviewee", DRIVER_FILLERS)


_W = r"\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}"


@query("b11_many_phrases", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[{_W}]+|[^{_W}]+') AS t FROM documents),
g AS (SELECT doc_id, unnest([t[i] || t[i + 1] || t[i + 2] FOR i IN range(1, len(t) - 1)]) AS gram FROM d WHERE len(t) > 2),
b AS (SELECT regexp_extract_all(lower(text), '[{_W}]+|[^{_W}]+') AS t FROM benchmark),
e AS (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM b WHERE len(t) > 2),
dict AS (SELECT DISTINCT t[i] || t[i + 1] || t[i + 2] AS gram FROM e
         WHERE t[i + 1] = ' ' AND regexp_matches(t[i], '^[{_W}]') AND t[i] <> t[i + 2])
SELECT doc_id, gram AS phrase, count(*) AS n FROM g JOIN dict USING (gram) GROUP BY doc_id, gram""")
def b11_many(spark, sf):
    """Every pair of neighbouring words of the benchmark passages, counted in every document."""
    t = PH.tokens(F.col("text"))
    three = F.transform("t", lambda x, i: F.struct(x.alias("a"), F.get("t", i + 1).alias("s"), F.get("t", i + 2).alias("b")))
    pairs = table(spark, sf, "benchmark").select(t.alias("t")).select(F.inline(three)).where("s = ' ' AND a <> b")
    names = [r[0] for r in pairs.select(F.concat("a", "s", "b")).distinct().collect()]
    return PH.phrase_counts(table(spark, sf, "documents"), ["doc_id"], "text", sorted(n for n in names if PH.plain(n)))


@query(
    "b12_filler_percent",
    "WITH " + TURNS_CTE + ", f AS (" + _filler_sql_rows() + "), h AS (SELECT id, sum(n) AS hits FROM f GROUP BY id)\n"
    + f"""SELECT st.id, h.hits::BIGINT AS filler_hits, {wc('interviewee_text')}::BIGINT AS words,
       CASE WHEN {wc('interviewee_text')} = 0 THEN 0.0 ELSE h.hits::DOUBLE / {wc('interviewee_text')} END AS filler_pct
FROM st JOIN h USING (id)""",
)
def b12(spark, sf):
    return TR.filler_percent(conv_labelled(spark, sf), "interviewee", DRIVER_FILLERS)


SENTENCES_BODY = r"""
fullt AS (
  SELECT id, string_agg(regexp_replace(regexp_replace(part, 'Interviewer:\s*', '', 'g'), 'Interviewee:\s*', '', 'g'), ' ' ORDER BY turn, sub) AS c
  FROM p GROUP BY id
),
sp AS (SELECT id, string_split(regexp_replace(c, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS arr FROM fullt),
ex AS (SELECT id, unnest(range(len(arr))) AS sentence_no, unnest(arr) AS s FROM sp),
csent AS (SELECT id, sentence_no, """ + strip("s") + " AS sentence FROM ex WHERE " + strip("s") + """ <> '')
"""
SENTENCES_CTE = TURNS_CTE + "," + SENTENCES_BODY
SENTENCES_SQL = "WITH " + SENTENCES_CTE + "SELECT id, sentence_no, sentence FROM csent"


@query("b13_sentences", SENTENCES_SQL)
def b13(spark, sf):
    return TR.sentence_table(conv_parts(spark, sf))


@query("b14_sentence_runs", r"""
WITH d AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: """ + strip("s") + r"""), lambda s: s <> '') AS arr
  FROM documents
)
SELECT doc_id, unnest(range(len(arr))) AS sentence_no, unnest(arr) AS sentence FROM d""")
def b14(spark, sf):
    d = TR.sentences_by_runs(table(spark, sf, "documents"), "text")
    return d.select("doc_id", F.posexplode("sentences").alias("sentence_no", "sentence")).withColumn(
        "sentence_no", F.col("sentence_no").cast("bigint")
    )


@query("b13_abbreviations", r"""
WITH t AS (SELECT unnest(regexp_extract_all(text, '\S+')) AS t FROM documents),
b AS (SELECT regexp_replace(lower(t), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS bare,
             ends_with(regexp_replace(t, '["''\)\]]+$', ''), '.') AS p FROM t),
y AS (SELECT CASE WHEN regexp_matches(bare, '^-?[.,]?[0-9][0-9,.\-]*$') THEN '##number##' ELSE bare END AS type, p FROM b WHERE bare <> ''),
c AS (SELECT type, count(*) FILTER (p) AS with_period, count(*) FILTER (NOT p) AS without FROM y GROUP BY type),
n AS (SELECT sum(with_period + without)::DOUBLE AS n, sum(with_period)::DOUBLE AS p FROM c),
l AS (SELECT c.*, len(replace(type, '.', '')) AS inside, (with_period + without)::DOUBLE AS a, with_period::DOUBLE AS ab, n.p / n.n AS q FROM c, n)
SELECT type, with_period, without,
       CASE WHEN with_period > 0 AND type <> '##number##' AND regexp_matches(type, '\p{L}') THEN
         -2 * (ab * ln(greatest(q, 1e-300)) + (a - ab) * ln(greatest(1 - q, 1e-300)) - ab * ln(0.99) - (a - ab) * ln(0.01))
         * exp(-inside::DOUBLE) * (len(type) - inside + 1) * pow(inside::DOUBLE, -without::DOUBLE) ELSE 0.0 END AS score
FROM l""")
def b13_abbreviations(spark, sf):
    return BO.abbreviation_scores(BO.type_counts(table(spark, sf, "documents"), "text"))


@query("b13_trained_sentences", None)
def b13_trained(spark, sf):
    d = table(spark, sf, "documents")
    return BO.split(d, BO.train(d, "text"), "doc_id", "text")


@query("b15_subword_chunks", None)
def b15_subwords(spark, sf):
    d = table(spark, sf, "documents")
    out = W.chunk_subwords(d, "text", W.piece_vocabulary(d, "text"), max_length=128)
    return out.select("doc_id", F.posexplode("chunks").alias("chunk_no", "c")).select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "c.n_tokens", "c.chunk")


@query("b15_chunk_sums", r"""
WITH d AS (SELECT doc_id, """ + wc("coalesce(text, '')") + r""" AS n, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: """ + strip("s") + r"""), lambda s: s <> '') AS arr
           FROM documents WHERE """ + strip("coalesce(text, '')") + r""" <> ''),
u AS (SELECT doc_id, n, unnest(arr) AS s FROM d WHERE n > 126)
SELECT doc_id, sum(""" + wc("s") + r""")::BIGINT AS n_words FROM u GROUP BY doc_id
UNION ALL SELECT doc_id, n::BIGINT AS n_words FROM d WHERE n <= 126""")
def b15_sums(spark, sf):
    d = TR.chunk_text(table(spark, sf, "documents"), "text", max_length=128)
    words = F.transform("chunks", lambda c: T.word_count(c))
    return d.where(F.size("chunks") > 0).select(
        "doc_id",
        F.aggregate(words, F.lit(0).cast("long"), lambda s, n: s + n).alias("n_words"),
    )


@query("b15_chunks", None)
def b15(spark, sf):
    d = TR.chunk_text(table(spark, sf, "documents"), "text", max_length=128)
    return d.select("doc_id", F.posexplode("chunks").alias("chunk_no", "chunk")).select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.size(F.split(F.trim("chunk"), r"\s+")).alias("n_words")
    )
