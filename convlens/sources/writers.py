"""Writers (inventory A7, A8).

Result tables are written by Spark tasks in parallel (one file per partition,
header included).  Reports are small ``(section, metric, value)`` tables that
are formatted (Python fixed-point rules, like the reference) and written as text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from convlens.sources.readers import CSV_NAME_MAP


def _flatten_for_csv(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (TY.ArrayType, TY.MapType, TY.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, rename_for_csv: bool = True) -> None:
    """CSV with header, overwrite; nested columns as JSON text."""
    out = _flatten_for_csv(df)
    if rename_for_csv:
        back = {v: k for k, v in CSV_NAME_MAP.items() if v in out.columns}
        out = out.withColumnsRenamed(back)
    out.write.mode("overwrite").option("header", True).csv(path)


# Fixed formats of the reference's report lines: (metric, label, decimals, unit).
REPORT_FORMATS = {
    "number_of_transcripts": ("Number of Transcripts", 0, ""),
    "average_similarity": ("Average Similarity", 4, ""),
    "min_similarity": ("Min Similarity", 4, ""),
    "max_similarity": ("Max Similarity", 4, ""),
    "average_interviewer_length": ("Average Interviewer Length", 1, " characters"),
    "average_interviewee_length": ("Average Interviewee Length", 1, " characters"),
    "average_ratio": ("Average Interviewee/Interviewer Ratio", 2, ""),
}


@F.pandas_udf(TY.StringType())
def _fixed(value: pd.Series, decimals: pd.Series) -> pd.Series:
    # Python's fixed-point formatting (round half to even on the exact binary
    # value), which the reports use; Java's %.nf rounds ties up.
    return pd.Series([None if pd.isna(v) else format(float(v), f".{int(d)}f") for v, d in zip(value, decimals)], dtype="object")


def report_lines(summary: DataFrame) -> DataFrame:
    """``(section, metric, line)`` text lines from ``(section, metric, value)`` rows.

    The summary has a handful of rows; numbers are formatted in one Arrow batch.
    """
    label = F.lit(None).cast("string")
    dec = F.lit(4)
    unit = F.lit("")
    for metric, (lab, d, u) in REPORT_FORMATS.items():
        cond = F.col("metric") == F.lit(metric)
        label = F.when(cond, F.lit(lab)).otherwise(label)
        dec = F.when(cond, F.lit(d)).otherwise(dec)
        unit = F.when(cond, F.lit(u)).otherwise(unit)
    is_cluster = F.col("section") == F.lit("cluster")
    dec = F.when(is_cluster, F.lit(0)).otherwise(dec)
    num = _fixed(F.col("value"), dec)
    cluster_line = F.concat(F.lit("  Cluster "), F.regexp_extract("metric", r"cluster_(.*)", 1), F.lit(": "), num, F.lit(" transcripts"))
    other = F.concat(F.lit("  "), F.coalesce(label, F.col("metric")), F.lit(": "), num, unit)
    # line order: report position of the metric, then clusters by number
    pos = F.lit(len(REPORT_FORMATS))
    for i, metric in enumerate(REPORT_FORMATS):
        pos = F.when(F.col("metric") == F.lit(metric), F.lit(i)).otherwise(pos)
    cluster_no = F.regexp_extract("metric", r"cluster_(-?\d+)", 1).try_cast("double")
    order = F.when(is_cluster, F.lit(1000.0) + F.coalesce(cluster_no, F.lit(0.0))).otherwise(pos.cast("double"))
    return summary.select("section", "metric", F.when(is_cluster, cluster_line).otherwise(other).alias("line"), order.alias("ord"))


# Fixed texts of the two other reports.
TOP_HEADING, BOTTOM_HEADING = "Top Interview IDs by Similarity:", "Bottom Interview IDs by Similarity:"
DATASET_LINES = (
    ("Dataset Statistics:", ()),
    ("  Number of Interviews: {}", (("size", 0),)),
    ("  Average Similarity: {}", (("average_similarity", 4),)),
    ("  Similarity Range: {} to {}", (("min_similarity", 4), ("max_similarity", 4))),
    ("  Average Interviewer Length: {} characters", (("average_interviewer_length", 1),)),
    ("  Average Interviewee Length: {} characters", (("average_interviewee_length", 1),)),
    ("  Average Length Ratio: {}", (("average_ratio", 2),)),
    ("", ()),
    ("Cluster Information:", ()),
)
CLUSTER_LINES = (
    ("  Cluster {}:", (("cluster", None),)),
    ("    Size: {} interviews", (("size", 0),)),
    ("    Average Similarity: {}", (("average_similarity", 4),)),
    ("    Average Ratio: {}", (("average_ratio", 2),)),
)


def _line(template: str, fields) -> F.Column:
    texts = [F.col(c).cast("string") if d is None else _fixed(F.col(c).cast("double"), F.lit(d)) for c, d in fields]
    pieces = template.split("{}")
    cols = [F.lit(pieces[0])]
    for text, piece in zip(texts, pieces[1:]):
        cols += [F.coalesce(text, F.lit("nan")), F.lit(piece)]
    return F.concat(*cols)


def top_bottom_lines(slices: DataFrame, id_col: str = "id") -> DataFrame:
    """``(ord, line)`` of the top and bottom id list from the slices of F9, top first, each ascending."""
    body = slices.select(
        F.when(F.col("slice") == "top", 0.0).otherwise(1e15).alias("first"),
        F.col("position"),
        F.concat(F.lit("  ID: "), F.col(id_col).cast("string"), F.lit(", Similarity: "), _fixed(F.col("similarity"), F.lit(4))).alias("line"),
    ).select((F.col("first") + F.col("position") + 1).alias("ord"), "line")
    heads = slices.sparkSession.createDataFrame([(0.0, TOP_HEADING), (1e15 - 1, ""), (1e15, BOTTOM_HEADING)], "ord double, line string")
    return heads.unionByName(body)


def profile_lines(report: DataFrame) -> DataFrame:
    """``(ord, line)`` of the profile report from the rows of F11 (dataset row and one row per cluster)."""

    def lines(rows: DataFrame, templates, first) -> DataFrame:
        out = None
        for k, (template, fields) in enumerate(templates):
            part = rows.select((first + F.lit(k / 100)).alias("ord"), _line(template, fields).alias("line"))
            out = part if out is None else out.unionByName(part)
        return out

    dataset = lines(report.where(F.col("level") == "dataset"), DATASET_LINES, F.lit(0.0))
    return dataset.unionByName(
        lines(report.where((F.col("level") == "cluster") & F.col("cluster").isNotNull()), CLUSTER_LINES, F.col("cluster").cast("double") + 1.0)
    )


def write_report(lines: DataFrame, path: str, header: str | None = None) -> None:
    """Write report lines, in report order, as one text file (a handful of rows)."""
    df = lines.select(F.col("ord"), F.col("line").alias("value"))
    if header:
        df = lines.sparkSession.createDataFrame([(-1.0, header)], "ord double, value string").unionByName(df)
    df.repartition(1).sortWithinPartitions("ord").select("value").write.mode("overwrite").text(path)
