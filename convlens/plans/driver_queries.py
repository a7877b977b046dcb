"""All driver queries, imported by ``__spark_entry__.py``."""

from __future__ import annotations

from convlens.plans import (  # noqa: F401  (importing registers the queries)
    q_align,
    q_bow,
    q_charseq,
    q_eval,
    q_features,
    q_models,
    q_profile,
    q_sentiment,
    q_sources,
    q_transcripts,
    q_vectors,
)
from convlens.plans.registry import ORACLES, QUERIES, rounded_oracles


def flagship(spark, sf_dir):
    """Per-conversation feature table (G1): the reference's feature extraction entry point."""
    return q_features.feature_table(spark, sf_dir)


__all__ = ["QUERIES", "ORACLES", "flagship", "rounded_oracles"]
