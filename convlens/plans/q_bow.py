"""Driver queries for inventory C (bag of words) on ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens.operators import bow as B
from convlens.operators import transcripts as TR
from convlens.plans import pipelines as PL
from convlens.plans.registry import query, table
from convlens.plans.sqlparts import TURNS_CTE


def _stop_list_sql() -> str:
    return ",".join("'" + w.replace("'", "''") + "'" for w in B.default_stop_words())


# A fixed 10-term vocabulary for the wide table (frequent, not stop words).
WIDE_TERMS = ["de", "la", "der", "en", "die", "que", "le", "des", "und", "et"]

DOC_CTE = r"""
tok AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
kept AS (SELECT id, term FROM tok WHERE term NOT IN (%s)),
cnt AS (SELECT id, term, count(*)::BIGINT AS n FROM kept GROUP BY id, term),
nd AS (SELECT count(*) AS n_docs FROM documents),
voc AS (
  SELECT term, count(*)::BIGINT AS df FROM cnt GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n_docs FROM nd)
),
cv AS (SELECT id, term, n FROM cnt WHERE term IN (SELECT term FROM voc))
"""


def doc_cte() -> str:
    return DOC_CTE % _stop_list_sql()


def _docs(spark, sf):
    return table(spark, sf, "documents")


def _cv(spark, sf):
    return B.count_vectors(_docs(spark, sf), "doc_id", "text")


@query("c1_tokenize", "WITH " + doc_cte() + "SELECT id AS doc_id, term, count(*)::BIGINT AS n FROM tok GROUP BY ALL")
def c1(spark, sf):
    t = B.tokenize(_docs(spark, sf), "doc_id", "text")
    return B.term_counts(t).withColumnRenamed("id", "doc_id")


@query("c2_stop_words", "WITH " + doc_cte() + """
SELECT d.doc_id, coalesce(a.n_tokens, 0)::BIGINT AS n_tokens, coalesce(b.n_kept, 0)::BIGINT AS n_kept
FROM documents d
LEFT JOIN (SELECT id, count(*) AS n_tokens FROM tok GROUP BY id) a ON a.id = d.doc_id
LEFT JOIN (SELECT id, count(*) AS n_kept FROM kept GROUP BY id) b ON b.id = d.doc_id""")
def c2(spark, sf):
    docs = _docs(spark, sf)
    t = B.tokenize(docs, "doc_id", "text")
    a = t.groupBy("id").agg(F.count("*").alias("n_tokens"))
    b = B.remove_stop_words(t).groupBy("id").agg(F.count("*").alias("n_kept"))
    return (
        docs.select(F.col("doc_id").alias("id"))
        .join(a, "id", "left")
        .join(b, "id", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"),
            F.coalesce("n_kept", F.lit(0)).cast("bigint").alias("n_kept"),
        )
    )


@query("c3_vocabulary", "WITH " + doc_cte() + "SELECT term, df FROM voc")
def c3(spark, sf):
    return _cv(spark, sf)[1]


@query("c4_count_vectors", "WITH " + doc_cte() + "SELECT id AS doc_id, term, n FROM cv")
def c4(spark, sf):
    return _cv(spark, sf)[0].withColumnRenamed("id", "doc_id")


@query(
    "c5_wide_counts",
    "WITH "
    + doc_cte()
    + "SELECT id AS document_id, "
    + ", ".join(f"coalesce(sum(n) FILTER (WHERE term = '{t}'), 0)::BIGINT AS {t}" for t in WIDE_TERMS)
    + " FROM (SELECT d.doc_id AS id, cv.term, cv.n FROM documents d LEFT JOIN cv ON cv.id = d.doc_id) GROUP BY id",
)
def c5(spark, sf):
    w = B.wide_counts(_cv(spark, sf)[0], WIDE_TERMS, _docs(spark, sf), "doc_id")
    return w.select("document_id", *[F.col(t).cast("bigint").alias(t) for t in WIDE_TERMS])


@query("c6_corpus_stats", "WITH " + doc_cte() + """,
lens AS (SELECT d.doc_id, coalesce(sum(cv.n), 0) AS len FROM documents d LEFT JOIN cv ON cv.id = d.doc_id GROUP BY d.doc_id)
SELECT count(*)::BIGINT AS documents, min(len)::BIGINT AS min_length, max(len)::BIGINT AS max_length, avg(len) AS mean_length,
       (SELECT count(*) FROM voc)::BIGINT AS vocabulary_size FROM lens""")
def c6(spark, sf):
    docs = _docs(spark, sf)
    counts, vocab = B.count_vectors(docs, "doc_id", "text")
    return B.corpus_stats(counts, vocab, docs, "doc_id")


@query("c7_top_terms", "WITH " + doc_cte() + "SELECT term, sum(n)::BIGINT AS total FROM cv GROUP BY term ORDER BY total DESC, term LIMIT 20")
def c7(spark, sf):
    return B.top_terms(_cv(spark, sf)[0], 20)


@query("c8_sample_documents", """
SELECT doc_id, lang FROM documents ORDER BY substr(md5('7:' || doc_id::VARCHAR), 1, 8), doc_id LIMIT 3""")
def c8(spark, sf):
    return B.sample_documents(_docs(spark, sf), "doc_id", 3, seed=7).select("doc_id", "lang")


@query("c9_top_terms_per_doc", "WITH " + doc_cte() + """,
r AS (SELECT id, term, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS rank FROM cv WHERE n > 0)
SELECT id AS doc_id, rank::BIGINT AS rank, term, n FROM r WHERE rank <= 20""")
def c9(spark, sf):
    return B.top_terms_per_doc(_cv(spark, sf)[0], 20).withColumnRenamed("id", "doc_id")


@query("c10_fingerprint", "WITH " + doc_cte() + """,
r AS (SELECT id, term, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS rank FROM cv WHERE n > 0)
SELECT id AS doc_id, string_agg(n::VARCHAR || '×' || term, ' + ' ORDER BY rank) AS fingerprint FROM r WHERE rank <= 5 GROUP BY id""")
def c10(spark, sf):
    return B.fingerprint(_cv(spark, sf)[0], 5).withColumnRenamed("id", "doc_id")


def wl_cte(source: str, ids: str, name: str = "wlf") -> str:
    """CTE ``name`` with the word-length features (id column ``id``)."""
    body = _wl_sql(source, ids).replace("i.id AS doc_id", "i.id AS id")
    return body.replace("\nSELECT i.id", f",\n{name} AS (SELECT i.id", 1) + ")"


def _wl_sql(source: str, ids: str) -> str:
    shares = ",\n".join(
        f"CASE WHEN coalesce(wl.total, 0) = 0 THEN NULL ELSE coalesce(wl.l{k}, 0)::DOUBLE / wl.total END AS word_length_{k}"
        for k in range(2, 8)
    )
    return f"""
wl AS (SELECT id, sum(n) AS total,
  {", ".join(f"sum(n) FILTER (WHERE length(term) = {k}) AS l{k}" for k in range(2, 8))},
  sum(n) FILTER (WHERE length(term) >= 8) AS l8 FROM {source} GROUP BY id)
SELECT i.id AS doc_id, coalesce(wl.total, 0)::BIGINT AS total_word_count,
{shares},
CASE WHEN coalesce(wl.total, 0) = 0 THEN NULL ELSE coalesce(wl.l8, 0)::DOUBLE / wl.total END AS word_length_8_plus
FROM {ids} i LEFT JOIN wl ON wl.id = i.id"""


@query("c11_word_length_features", "WITH " + doc_cte() + "," + _wl_sql("cv", "(SELECT doc_id AS id FROM documents)"))
def c11(spark, sf):
    docs = _docs(spark, sf)
    counts, _ = B.count_vectors(docs, "doc_id", "text")
    return B.word_length_features(counts, docs, "doc_id").withColumnRenamed("id", "doc_id")


CONV_CV_BODY = r"""
ctok AS (SELECT id, unnest(regexp_extract_all(lower(interviewee_text), '[\p{L}\p{N}_]{2,}')) AS term FROM st),
ckept AS (SELECT id, term FROM ctok WHERE term NOT IN (%s)),
ccnt AS (SELECT id, term, count(*)::BIGINT AS n FROM ckept GROUP BY id, term),
cvoc AS (
  SELECT term FROM ccnt GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM st)
),
ccv AS (SELECT id, term, n FROM ccnt WHERE term IN (SELECT term FROM cvoc))
"""


def conv_cv_body() -> str:
    return CONV_CV_BODY % _stop_list_sql()


def conv_cv_cte() -> str:
    return TURNS_CTE + "," + conv_cv_body()


def interviewee_counts(spark, sf):
    """Parse -> interviewee document-term counts over the pruned vocabulary.

    The documents are the conversations (one per id, empty ones included).
    """
    labelled = TR.label_parts(TR.parts_from_conversations(table(spark, sf, "conversations")))
    ids = labelled.select("id").distinct()
    return PL.speaker_vectors(PL.speaker_counts(labelled), ids, "interviewee"), ids


@query("c12_interviewee_word_counts", "WITH " + conv_cv_cte() + "SELECT id, term, n FROM ccv")
def c12(spark, sf):
    return interviewee_counts(spark, sf)[0]


@query(
    "c11_interviewee_word_lengths",
    "WITH " + conv_cv_cte() + "," + _wl_sql("ccv", "(SELECT id FROM st)").replace("i.id AS doc_id", "i.id AS id"),
)
def c11_conv(spark, sf):
    counts, ids = interviewee_counts(spark, sf)
    return B.word_length_features(counts, ids, "id")
