"""From raw documents to token ids: five stages, each one operator of ``convlens.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one
before it kept.  ``run`` writes each stage's rows to the shared folder and
reads them again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from convlens.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from convlens.llm.registry import register
from convlens.session import cut_lineage, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier selects."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.rating())
    return quality.drop_rejected(docs, model)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return jaccard_join.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix takes them."""
    return mixing.mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    import public_tokenizers as P

    return bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, ids=True)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("mixing", mixing_stage),
    ("byte_level_bpe", tokens_stage),
]

#: The classifier, MinHash and BPE are not expressible in SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go once its rows are written
            docs = cut_lineage(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)


register("pipeline", run, ORACLE_SQL)
