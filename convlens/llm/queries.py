"""The queries ``opN_<name>``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens.llm import (
    bpe,
    chatformat,
    exact_dedup,
    jaccard_join,
    langid,
    licenses,
    mixing,
    periodic,
    pii,
    quality,
    token_blocks,
    vafile,
    whitening,
)
from convlens.llm.registry import register
from convlens.session import cut_lineage


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_copies(_table(spark, sf_dir, "documents"), largest=True)


register(
    "op6_exact_dedup",
    op6_exact_dedup,
    """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
""",
)


def op8_bpe(spark, sf_dir):
    import public_tokenizers as P

    return bpe.encode(_table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


register("op8_bpe", op8_bpe)


def op9_mixing(spark, sf_dir):
    return mixing.mix_sizes(_table(spark, sf_dir, "documents"), seed=7)


register(
    "op9_mixing",
    op9_mixing,
    """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS total FROM sized GROUP BY source),
ranked AS (
  SELECT source, total, 2 * total AS cap,
         [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM src),
levels AS (
  SELECT *, (sum(total) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked WINDOW o AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST)),
water AS (SELECT max(level) AS w FROM levels WHERE level <= cap::DOUBLE / weight),
plan AS (
  SELECT source, total, coalesce(least(cap::DOUBLE, w * weight), cap::DOUBLE) AS target FROM levels, water),
plan2 AS (
  SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END AS whole FROM plan),
ordered AS (
  SELECT s.*, p.total, p.target, p.whole, p.target - p.whole * p.total AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
  FROM sized s JOIN plan2 p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, total AS source_size, target,
       (size * (whole + CASE WHEN budget > 0 AND before + size / 2 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
""",
)


def op3_jaccard_join(spark, sf_dir):
    return jaccard_join.near_copies(_table(spark, sf_dir, "documents"))


register("op3_jaccard_join", op3_jaccard_join)


def op10_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), quality.rating())
    return quality.score(docs, model)


register("op10_quality", op10_quality)


def op1_vector_search(spark, sf_dir):
    return vafile.top_k(_table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10, scale=1024)


register(
    "op1_vector_search",
    op1_vector_search,
    """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)),
ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
)


def op2_license_scan(spark, sf_dir):
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("places")


def _license_sql() -> str:
    """Base and notice templates as plain phrase matching over word lists."""

    def starts(t):
        parts = []
        for a, n in t.keys:
            words = ", ".join(f"'{w}'" for w in t.words[a : a + n])
            parts.append(f"w[s + {a + 1} : s + {a + n}] = [{words}]")
        low, high = min(a for a, _ in t.keys), max(a + n for a, n in t.keys)
        return f"[s FOR s IN range({-low}, greatest(len(w) - {high - 1}, {-low})) IF {' AND '.join(parts)}]"

    def coverage(t, name):
        hits = " + ".join(f"(CASE WHEN s + {j} >= 0 AND w[s + {j + 1}] = '{x}' THEN 1 ELSE 0 END)" for j, x in enumerate(t.words))
        return f"coalesce(list_max([({hits}) / {len(t.words)} FOR s IN {name}]), 0)"

    ts = licenses.TEMPLATES
    found = ", ".join(f"{starts(t)} AS s{k}" for k, t in enumerate(ts))
    cover = ", ".join(f"{coverage(t, f's{k}')} AS c{k}" for k, t in enumerate(ts))
    given = lambda ks: "[x FOR x IN [" + ", ".join(f"CASE WHEN c{k} >= {licenses.LEAST} THEN '{ts[k].label}' END" for k in ks) + "] IF x IS NOT NULL]"
    base = [k for k, t in enumerate(ts) if t.base]
    places = " || ".join(f"s{k}" for k in base)
    names = lambda ks: f"array_to_string(list_sort(list_distinct({given(ks)})), ',')"
    best = ", ".join(f"CASE WHEN c{k} >= {licenses.LEAST} THEN c{k} ELSE 0 END" for k in range(len(ts)))
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
found AS (SELECT doc_id, w, {found} FROM words),
covered AS (SELECT *, {cover} FROM found),
based AS (SELECT *, {places} AS b FROM covered)
SELECT doc_id, len(w)::BIGINT AS n_words, len(b)::BIGINT AS n_base, list_min(b)::BIGINT AS first_word, list_max(b)::BIGINT AS last_word,
       {names(base)} AS base_labels, {names(range(len(ts)))} AS labels, greatest({best})::DOUBLE AS score
FROM based
"""


register("op2_license_scan", op2_license_scan, _license_sql())


def held_out(id_col="doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op4_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    out = F.coalesce(held_out(), F.lit(False))
    model = langid.fit(docs, ~out)
    return langid.identify(docs, model).withColumn("held_out", out)


register("op4_language_id", op4_language_id)


def op5_chat_format(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], turns.schema)
    examples = cut_lineage(chatformat.format_examples(turns.unionByName(probe)))
    return chatformat.read_back(examples)


register(
    "op5_chat_format",
    op5_chat_format,
    """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
drawn AS (
  SELECT *, length('<|im_start|>' || replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;') || chr(10)
                   || replace(replace(text, '&', '&amp;'), '<|', '&lt;|') || '<|im_end|>' || chr(10)) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM turns),
summed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM drawn)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = 'assistant' OR place = n))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
""",
)


def op7_token_blocks(spark, sf_dir):
    import public_tokenizers as P

    shards = token_blocks.write_shards(_table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), end=2)
    return token_blocks.read_shards(shards)


register("op7_token_blocks", op7_token_blocks)


def op13_periodic_runs(spark, sf_dir):
    return periodic.digest(periodic.periodic_runs(periodic.planted(_table(spark, sf_dir, "documents"))))


register("op13_periodic_runs", op13_periodic_runs)


def op11_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


register("op11_whitening", op11_whitening)


def op12_pii(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.fit(docs)))


register("op12_pii", op12_pii)
