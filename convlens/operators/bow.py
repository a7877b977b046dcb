"""Bag of words (inventory C), kept in long form ``(id, term, n)``.

The vocabulary decides a wide schema only in ``wide_counts``, and only for an
explicit term list.  Every aggregation here is decomposable (counts
and sums), so Spark's partial aggregation combines hot terms and hot
documents map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlens.functions import text as T
from convlens.functions.common import md5_hex8
from convlens.functions.stopwords import ENGLISH
from convlens.session import cut_lineage, local_table


def default_stop_words() -> tuple[str, ...]:
    """The package's fixed English list; nothing is looked up outside the package."""
    return ENGLISH


def tokenize(df: DataFrame, id_col: str, text_col: str, pattern: str = T.TOKEN_PATTERN) -> DataFrame:
    """``(id, term)`` one row per token occurrence (lower-cased, >= 2 word characters)."""
    return df.select(F.col(id_col).alias("id"), F.explode(T.tokens(F.col(text_col), pattern)).alias("term"))


def remove_stop_words(tokens: DataFrame, stop_words=None, term_col: str = "term") -> DataFrame:
    """Drop stop words (default: Spark's English list); one anti join for a list of any size."""
    words = list(stop_words if stop_words is not None else default_stop_words())
    stop = local_table(tokens.sparkSession, [(w,) for w in words], f"{term_col} string")
    return tokens.join(stop, term_col, "left_anti")


def term_counts(tokens: DataFrame) -> DataFrame:
    """``(id, term, n)`` occurrences of each term per document."""
    return tokens.groupBy("id", "term").agg(F.count("*").cast("bigint").alias("n"))


def vocabulary(counts: DataFrame, n_docs, min_df: float = 2, max_df: float = 0.95) -> DataFrame:
    """``(term, df)`` with document-frequency bounds.

    ``min_df``/``max_df``: an int is a document count, a float in (0, 1] a share
    of ``n_docs`` (a Column or number; empty documents count).
    """
    df = counts.groupBy("term").agg(F.count("*").cast("bigint").alias("df"))
    nd = n_docs if not isinstance(n_docs, (int, float)) else F.lit(n_docs)
    lo = F.lit(min_df) if isinstance(min_df, int) else F.lit(min_df) * nd
    hi = F.lit(max_df) if isinstance(max_df, int) else F.lit(max_df) * nd
    return df.where((F.col("df") >= lo) & (F.col("df") <= hi))


def count_vectors(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    stop_words=None,
    min_df: float = 2,
    max_df: float = 0.95,
) -> tuple[DataFrame, DataFrame]:
    """C4: document-term counts over the pruned vocabulary.

    Returns ``(counts (id, term, n), vocabulary (term, df))``.  Texts are read
    and tokenised once: the combined counts are written to the shared folder,
    and document frequencies and the pruned counts both come from there.
    """
    counts = cut_lineage(term_counts(remove_stop_words(tokenize(docs, id_col, text_col), stop_words)))
    n_docs = docs.agg(F.count("*")).scalar()  # scalar subquery, no join
    vocab = vocabulary(counts, n_docs, min_df, max_df)
    return prune(counts, vocab), vocab


def prune(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Combined counts of the vocabulary's terms (not raw tokens, so a frequent term has one row per document)."""
    return counts.join(vocab.select("term"), "term", "left_semi").select("id", "term", "n")


WIDE_GROUP = 200


def wide_counts(counts: DataFrame, terms: list[str], docs: DataFrame, id_col: str, id_name: str = "document_id") -> DataFrame:
    """One row per document and one column per listed term, 0 where absent.

    Terms are widened in groups of columns that are joined by id, so the list
    may be of any length.
    """
    out = docs.select(F.col(id_col).alias("id"))
    for k in range(0, len(terms), WIDE_GROUP):
        part = terms[k : k + WIDE_GROUP]
        wide = counts.where(F.col("term").isin(part)).groupBy("id").pivot("term", part).agg(F.sum("n"))
        out = out.join(wide, "id", "left")
    return out.fillna(0, subset=terms).withColumnRenamed("id", id_name)


def doc_lengths(counts: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """Kept tokens per document; documents without a kept token get 0."""
    per = counts.groupBy("id").agg(F.sum("n").alias("len"))
    return docs.select(F.col(id_col).alias("id")).join(per, "id", "left").select(
        "id", F.coalesce("len", F.lit(0)).cast("bigint").alias("len")
    )


def corpus_stats(counts: DataFrame, vocab: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """Documents, vocabulary size, min / max / mean document length."""
    lens = doc_lengths(counts, docs, id_col).agg(
        F.count("*").alias("documents"),
        F.min("len").alias("min_length"),
        F.max("len").alias("max_length"),
        F.avg("len").alias("mean_length"),
    )
    return lens.withColumn("vocabulary_size", vocab.agg(F.count("*")).scalar())


def top_terms(counts: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` most frequent terms of the corpus (ties by term); top-k, no full sort."""
    return (
        counts.groupBy("term")
        .agg(F.sum("n").cast("bigint").alias("total"))
        .orderBy(F.desc("total"), F.asc("term"))
        .limit(n)
    )


def sample_documents(docs: DataFrame, id_col: str, n: int = 3, seed: int = 0) -> DataFrame:
    """``min(n, count)`` documents without replacement, deterministic by md5 of the id."""
    return docs.orderBy(md5_hex8(F.col(id_col), seed), F.col(id_col)).limit(n)


def top_terms_per_doc(counts: DataFrame, n: int = 20) -> DataFrame:
    """``(id, rank, term, n)``, count > 0, ties by term.

    ``row_number() <= n`` lets Spark insert a per-partition group limit
    before the shuffle, so each task only ships its local top n per document.
    """
    w = Window.partitionBy("id").orderBy(F.desc("n"), F.asc("term"))
    return (
        counts.where(F.col("n") > 0)
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .select("id", F.col("rank").cast("bigint").alias("rank"), "term", "n")
    )


def fingerprint(counts: DataFrame, n: int = 5) -> DataFrame:
    """``"5×word + 3×word ..."`` of the top ``n`` terms, count descending."""
    top = top_terms_per_doc(counts, n)
    item = F.struct("rank", F.concat(F.col("n").cast("string"), F.lit("×"), F.col("term")).alias("s"))
    return top.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["s"]), " + ").alias("fingerprint")
    )


def word_length_features(counts: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """C11: total kept tokens and the share of tokens by term length 2..7 and 8+.

    Missing length -> 0; a document with no kept token has null shares.
    """
    by_len = counts.groupBy("id").agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(F.length("term") == k, F.col("n")).otherwise(0)).alias(f"l{k}") for k in range(2, 8)],
        F.sum(F.when(F.length("term") >= 8, F.col("n")).otherwise(0)).alias("l8"),
    )
    all_docs = docs.select(F.col(id_col).alias("id")).join(by_len, "id", "left")
    total = F.coalesce(F.col("total"), F.lit(0))
    cols = [F.col("id"), total.cast("bigint").alias("total_word_count")]
    for k in range(2, 8):
        cols.append(F.try_divide(F.coalesce(F.col(f"l{k}"), F.lit(0)).cast("double"), F.nullif(total, F.lit(0)).cast("double")).alias(f"word_length_{k}"))
    cols.append(F.try_divide(F.coalesce(F.col("l8"), F.lit(0)).cast("double"), F.nullif(total, F.lit(0)).cast("double")).alias("word_length_8_plus"))
    return all_docs.select(*cols)
