"""Readers (inventory A1-A6).

Readers have a fixed schema or take one; only A4 and A5, whose columns are the
caller's, infer one when none is given.  Later projections are pruned at the scan.

``multi_line``: records that hold line breaks (quoted transcripts) can be read
only with whole files a task, so it is on for transcripts; tables of numbers
and ids have one line a record, and their files are split among tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from convlens.operators.transcripts import read_transcript_table

SCORES_SCHEMA = TY.StructType(
    [
        TY.StructField("Participant", TY.StringType()),
        TY.StructField("Overall", TY.DoubleType()),
        TY.StructField("Excited", TY.DoubleType()),
    ]
)

# Feature table as written by the feature pipeline (CSV header names).
FEATURE_COLUMNS = [
    "id", "filler%", "speaker_balance", "total_word_count",
    "word_length_2", "word_length_3", "word_length_4", "word_length_5", "word_length_6", "word_length_7",
    "8+ words", "average_sentence_sentiment", "minimum_sentence_sentiment", "maximum_sentence_sentiment",
]
# CSV header name -> column name used in Spark (no backticks needed).
CSV_NAME_MAP = {"filler%": "filler_pct", "8+ words": "word_length_8_plus"}


def _csv(spark: SparkSession, path: str, schema=None, multi_line: bool = False):
    r = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_transcripts(spark: SparkSession, path: str, fmt: str = "csv", multi_line: bool = True) -> DataFrame:
    """A1: first two columns by position -> ``(id, transcript)``; error with fewer than two."""
    df = _csv(spark, path, multi_line=multi_line) if fmt == "csv" else spark.read.format(fmt).load(path)
    return read_transcript_table(df)


def read_scores(spark: SparkSession, path: str, key: str = "Participant", multi_line: bool = False) -> DataFrame:
    """A2: ``(id, Overall, Excited)``; ids stay strings."""
    return _csv(spark, path, SCORES_SCHEMA, multi_line).withColumnRenamed(key, "id")


def feature_schema(columns=FEATURE_COLUMNS) -> TY.StructType:
    return TY.StructType(
        [TY.StructField(c, TY.StringType() if c == "id" else (TY.LongType() if c == "total_word_count" else TY.DoubleType())) for c in columns]
    )


def read_features(spark: SparkSession, path: str, schema: TY.StructType | None = None, fmt: str = "csv", multi_line: bool = False) -> DataFrame:
    """A3: feature matrix with a fixed schema; CSV names with symbols are renamed."""
    if fmt == "csv":
        df = _csv(spark, path, schema or feature_schema(), multi_line)
    else:
        reader = spark.read.format(fmt)
        df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.withColumnsRenamed({k: v for k, v in CSV_NAME_MAP.items() if k in df.columns})


def read_prosodic(spark: SparkSession, path: str, schema: TY.StructType | None = None) -> DataFrame:
    """A4: per-question prosodic table; the key column ``participant&question`` is
    exposed as ``participant_question``."""
    df = _csv(spark, path, schema) if schema is not None else spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.withColumnRenamed("participant&question", "participant_question")


def load_checked(df: DataFrame, required=("id", "similarity", "interviewer_length", "interviewee_length", "ratio"), cluster_col: str = "cluster"):
    """A5: ``(df, has_clusters)``; raises naming the missing columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df, cluster_col in df.columns


def read_checked(spark: SparkSession, path: str, **kw):
    """A5 from a file: missing file and missing columns are errors."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    except AnalysisException as e:  # Spark's own lookup: works on any file system the cluster reads
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"File not found: {path}") from e
        raise
    return load_checked(df, **kw)


def cluster_count(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """A5: number of distinct clusters."""
    return df.agg(F.countDistinct(cluster_col).alias("n_clusters"))


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file ``(path, text)`` (UTF-8, whole file)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
