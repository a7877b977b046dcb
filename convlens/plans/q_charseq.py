"""Driver queries for inventory L (character-sequence datasets)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from convlens.operators import charseq as L
from convlens.plans.registry import query, table
from convlens.session import checkpoint_dir

VOCAB_SQL = """
vocab AS (
  SELECT ch, (row_number() OVER (ORDER BY ch) - 1)::INTEGER AS idx
  FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''
)
"""


def doc_vocab(spark, sf):
    return L.char_vocabulary(table(spark, sf, "documents"), "text")


@query("l1_char_offsets", """
SELECT doc_id AS id, coalesce(sum(length(coalesce(text, '')) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset,
       length(coalesce(text, ''))::BIGINT AS length FROM documents""")
def l1(spark, sf):
    return L.char_offsets(table(spark, sf, "documents"), "doc_id", "text")


@query("l1_concat_texts", """
SELECT item_id AS id, coalesce(sum(length(coalesce(text, '')) + 1) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset,
       coalesce(text, '') AS text FROM benchmark""")
def l1_concat(spark, sf):
    return L.joined_texts(table(spark, sf, "benchmark"), "item_id", "text")


@query("l2_char_vocabulary", "WITH " + VOCAB_SQL + "SELECT ch, idx FROM vocab")
def l2(spark, sf):
    return doc_vocab(spark, sf)


ENC_SQL = "WITH " + VOCAB_SQL + """,
ch AS (SELECT conv_id, turn, unnest(range(len(string_split(text, '')))) AS pos, unnest(string_split(text, '')) AS c FROM conversations),
enc AS (SELECT conv_id, turn, string_agg(coalesce(vocab.idx::VARCHAR, 'null'), ',' ORDER BY pos) AS ids
        FROM ch LEFT JOIN vocab ON vocab.ch = ch.c WHERE ch.c <> '' GROUP BY conv_id, turn)
"""


def _encoded(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return L.encode(conv, "text", doc_vocab(spark, sf))


@query("l3_encode", ENC_SQL + "SELECT conv_id, turn, ids FROM enc")
def l3(spark, sf):
    return _encoded(spark, sf).select("conv_id", "turn", F.array_join(F.col("ids"), ",", "null").alias("ids"))


@query("l3_decode_roundtrip", "SELECT conv_id, turn, text FROM conversations WHERE text <> ''")
def l3_decode(spark, sf):
    enc = _encoded(spark, sf).where(F.col("text") != "")
    return L.decode(enc, "ids", doc_vocab(spark, sf)).select("conv_id", "turn", "text")


@query("l4_windows", "WITH " + VOCAB_SQL + """,
ch AS (SELECT conv_id, turn, unnest(range(len(string_split(text, '')))) AS pos, unnest(string_split(text, '')) AS c FROM conversations),
enc AS (SELECT conv_id, turn, list(vocab.idx ORDER BY pos) AS ids FROM ch JOIN vocab ON vocab.ch = ch.c WHERE ch.c <> '' GROUP BY conv_id, turn),
w AS (SELECT conv_id, turn, ids, unnest(range(0, len(ids) - 8, 4)) AS pos FROM enc WHERE len(ids) > 8)
SELECT conv_id, turn, pos::BIGINT AS pos, array_to_string(ids[pos + 1 : pos + 8], ',') AS x, array_to_string(ids[pos + 2 : pos + 9], ',') AS y FROM w""")
def l4(spark, sf):
    w = L.windows(_encoded(spark, sf), ["conv_id", "turn"], "ids", block_size=8, stride=4)
    return w.select("conv_id", "turn", "pos", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


@query("l4_corpus_windows", """
WITH j AS (SELECT string_agg(coalesce(text, ''), ' ' ORDER BY item_id) AS t FROM benchmark),
c AS (SELECT unnest(range(len(string_split(t, '')))) AS pos, unnest(string_split(t, '')) AS ch FROM j),
v AS (SELECT ch, row_number() OVER (ORDER BY ch) - 1 AS idx FROM (SELECT DISTINCT ch FROM c)),
ids AS (SELECT list(v.idx ORDER BY pos) AS ids FROM c JOIN v USING (ch)),
w AS (SELECT ids, unnest(range(0, len(ids) - 16, 64)) AS pos FROM ids)
SELECT pos::BIGINT AS pos, array_to_string(ids[pos + 1 : pos + 16], ',') AS x, array_to_string(ids[pos + 2 : pos + 17], ',') AS y FROM w""")
def l4_corpus(spark, sf):
    d = table(spark, sf, "benchmark")
    w = L.corpus_windows(d, "item_id", "text", L.char_vocabulary(d, "text", extra=" "), block_size=16, stride=64)
    return w.select("pos", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


@query("l5_vocab_roundtrip", "WITH " + VOCAB_SQL + " SELECT ch, idx::INTEGER AS idx FROM vocab")
def l5(spark, sf):
    path = os.path.join(checkpoint_dir(spark), f"vocab-{uuid.uuid4().hex}")
    L.save_vocabulary(doc_vocab(spark, sf), path)
    return L.load_vocabulary(spark, path)


@query("l6_remove_unknown", """
WITH v AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark),
ch AS (SELECT conv_id, turn, text, unnest(range(len(string_split(text, '')))) AS pos, unnest(string_split(text, '')) AS c FROM conversations),
kept AS (SELECT conv_id, turn, any_value(text) AS text,
                coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE c IN (SELECT ch FROM v WHERE ch <> '')), '') AS safe_text
         FROM ch GROUP BY conv_id, turn)
SELECT conv_id, turn, safe_text, length(safe_text) <> length(text) AS changed FROM kept""")
def l6(spark, sf):
    vocab = L.char_vocabulary(table(spark, sf, "benchmark"), "text")
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return L.remove_unknown(conv, "text", vocab).select("conv_id", "turn", "safe_text", "changed")


@query("l7_sample_prompt", """
SELECT doc_id, CASE WHEN length(coalesce(text, '')) > 20 THEN substr(text, 1, 20)
                    ELSE substr(coalesce(text, ''), 1, (length(coalesce(text, '')) // 2)::INTEGER) END AS prompt FROM documents""")
def l7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", L.sample_prompt(F.col("text")).alias("prompt"))
