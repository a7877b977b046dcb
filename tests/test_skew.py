"""A conversation holding a large share of all rows is processed exactly.

One transcript has 2,400 turns (about 40% of all turns) and runs through the
bucketed scans with many buckets; its features must equal the row-local
features computed from the whole transcript string.
"""

import random

from convlens.operators import transcripts as TR
from tests.test_longform_equivalence import rand_transcript


def test_hot_conversation(spark):
    rng = random.Random(11)
    hot = "|".join(rand_transcript(rng, 1) or "Interviewee: x" for _ in range(2400))
    rows = [("hot", hot)] + [(f"c{i}", rand_transcript(rng, 12)) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, transcript string")
    parts = TR.parts_from_transcripts(df)
    long = {r["id"]: r.asDict() for r in TR.transcript_features(parts, bucket_size=64).collect()}
    row = {r["id"]: r.asDict() for r in TR.transcript_features_rowwise(df).collect()}
    assert long["hot"]["interviewee_words"] > 1000
    assert long == row
    sents = TR.sentence_table(parts, bucket_size=64).where("id = 'hot'").count()
    assert sents > 100
