"""Streaming feature query over transcript files equals the batch long form."""

import os
import tempfile

from convlens.operators import transcripts as TR
from convlens.streaming import features as SF
from tests.conftest import SF_SMALL


def test_stream_matches_batch(spark):
    conv = spark.read.parquet(os.path.join(SF_SMALL, "conversations.parquet"))
    tr = TR.transcripts_from_conversations(conv).selectExpr("cast(id as string) as id", "transcript")
    src = tempfile.mkdtemp(prefix="convlens-stream-src-")
    tr.repartition(3).write.mode("overwrite").parquet(src)
    q = SF.feature_stream(SF.read_transcript_stream(spark, src)).writeStream.format("memory").queryName("feat_stream").start()
    q.processAllAvailable()
    q.stop()
    got = {r["id"]: r.asDict() for r in spark.sql("SELECT * FROM feat_stream").collect()}
    batch = TR.transcript_features(TR.parts_from_conversations(conv)).collect()
    assert len(got) == len(batch) > 0
    for r in batch:
        g = got[str(r["id"])]
        for k in ("interviewer_length", "interviewee_length", "interviewer_words", "interviewee_words", "filler_hits"):
            assert g[k] == r[k], k
        assert abs(g["speaker_balance"] - r["speaker_balance"]) < 1e-12
