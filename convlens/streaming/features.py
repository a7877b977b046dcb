"""Per-transcript features over a stream of transcript files.

The reference processes a fixed CSV; when interviews keep arriving, the same
row-local features run as a Structured Streaming query: each new transcript
row is parsed and measured in place (stateless, no shuffle, no watermark
needed), and results are appended to a file sink whose checkpoint lives in
the shared checkpoint folder so the query resumes after a failure.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as TY

from convlens.operators.transcripts import transcript_features_rowwise
from convlens.session import checkpoint_dir

TRANSCRIPT_SCHEMA = TY.StructType([TY.StructField("id", TY.StringType()), TY.StructField("transcript", TY.StringType())])


def read_transcript_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: TY.StructType = TRANSCRIPT_SCHEMA, max_files: int = 100) -> DataFrame:
    """Streaming source of ``(id, transcript)`` files (parquet, json or csv)."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if fmt == "csv":
        r = r.option("header", True).option("multiLine", True).option("escape", '"')
    return r.format(fmt).load(path)


def feature_stream(stream: DataFrame, fillers=None) -> DataFrame:
    return transcript_features_rowwise(stream, "transcript", fillers)


def start_feature_sink(features: DataFrame, out_path: str, name: str = "transcript_features", trigger_once: bool = False):
    """Append features to parquet; the checkpoint sits in the shared checkpoint folder."""
    ckpt = os.path.join(checkpoint_dir(features.sparkSession), "streams", name)
    w = features.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt).outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
