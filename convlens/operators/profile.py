"""Profiling of a per-transcript table (inventory F): histograms, percentiles,
trend, box statistics, cluster profiles and top/bottom slices.

Global statistics are one-row aggregates joined back as scalars (a one-row
broadcast has a proven size).  Per-cluster statistics are grouped
aggregations; no operator gathers rows of a group into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.functions.stats import safe_intercept, safe_slope
from convlens.operators.sequence import global_rank, running_sum

PROFILE_METRICS = ["similarity", "interviewer_length", "interviewee_length", "ratio"]


def require_columns(df: DataFrame, required: list[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")


def bin_index(value, lo, hi, bins: int):
    """1-based equal-width bin; the maximum falls in the last bin (closed right)."""
    raw = F.floor(F.try_divide(value - lo, hi - lo) * F.lit(bins)) + 1
    return F.least(F.coalesce(raw, F.lit(1)), F.lit(bins)).cast("int")


def histogram(df: DataFrame, col: str, bins: int = 19) -> DataFrame:
    """``(bin, lower, upper, count)`` for ``bins`` equal bins from min to max; empty bins have 0."""
    spark = df.sparkSession
    vals = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    mm = vals.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()  # scalar subquery
    lo, hi = mm["lo"], mm["hi"]
    counts = vals.groupBy(bin_index(F.col("v"), lo, hi, bins).alias("bin")).agg(F.count("*").cast("bigint").alias("count"))
    edges = spark.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    width = (hi - lo) / F.lit(bins)
    return edges.join(counts, "bin", "left").select(
        "bin",
        (lo + (F.col("bin") - 1) * width).alias("lower"),
        (lo + F.col("bin") * width).alias("upper"),
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
    )


def exact_percentiles(df: DataFrame, col: str, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, ``(by..., q, value)``.

    Spark's exact ``percentile`` keeps every distinct value of a group in one
    buffer; here equal values are counted first (a frequent value is combined
    map-side), the counts are summed in the order of ``(by, value)`` by
    ``running_sum``, and each requested position is the smallest value whose
    running count passes it.  No group is gathered into one task.
    """
    by = list(by or [])
    vals = df.select(*by, F.col(col).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    counted = vals.groupBy(*by, "__v").agg(F.count(F.lit(1)).alias("__c"))
    order = [*[F.col(b).asc_nulls_first() for b in by], F.col("__v").asc()]
    placed = running_sum(counted, order, "__c", "__before")
    sizes = placed.groupBy(*by).agg(F.sum("__c").alias("__n"), F.min("__before").alias("__start"))
    if by:
        d = placed.join(sizes.withColumnsRenamed({b: f"__g{k}" for k, b in enumerate(by)}), [F.col(b).eqNullSafe(F.col(f"__g{k}")) for k, b in enumerate(by)])
    else:
        one = sizes.select(F.struct("__n", "__start").alias("s")).scalar()  # scalar subquery
        d = placed.withColumn("__n", one["__n"]).withColumn("__start", one["__start"])
    upto = F.col("__before") - F.col("__start") + F.col("__c")
    ends, out = [], []
    for k, q in enumerate(qs):
        pos = F.lit(float(q)) * (F.col("__n") - 1)
        ends += [
            F.min(F.when(upto > F.floor(pos), F.col("__v"))).alias(f"__lo{k}"),
            F.min(F.when(upto > F.ceil(pos), F.col("__v"))).alias(f"__hi{k}"),
        ]
        frac = pos - F.floor(pos)
        value = F.col(f"__lo{k}") + frac * (F.col(f"__hi{k}") - F.col(f"__lo{k}"))
        out.append(F.struct(F.lit(float(q)).alias("q"), value.alias("value")))
    found = d.groupBy(*by).agg(F.max("__n").alias("__n"), *ends)
    return found.select(*by, F.explode(F.array(*out)).alias("__e")).select(*by, "__e.q", "__e.value")


def percentile(df: DataFrame, col: str, q: float = 0.95, by: list[str] | None = None, exact: bool = True) -> DataFrame:
    """percentile with linear interpolation (``exact``, distributed) or the
    mergeable approximate sketch (``percentile_approx``)."""
    name = f"p{int(round(q * 100))}"
    if exact:
        return exact_percentiles(df, col, [q], by).select(*(by or []), F.col("value").alias(name))
    return df.groupBy(*(by or [])).agg(F.percentile_approx(F.col(col), F.lit(q), 10000).cast("double").alias(name))


def winsorize(df: DataFrame, col: str, q: float = 0.95, out: str | None = None) -> DataFrame:
    """cap the upper side at the ``q`` percentile (a one-row scalar)."""
    cap = exact_percentiles(df, col, [q]).select("value").scalar()  # scalar subquery
    return df.withColumn(out or f"{col}_capped", F.least(F.col(col), cap))


def linear_trend(df: DataFrame, y: str, x: str) -> DataFrame:
    """least-squares line ``y = slope * x + intercept``."""
    return df.agg(safe_slope(y, x).alias("slope"), safe_intercept(y, x).alias("intercept"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """counts per value, sorted by value."""
    return df.groupBy(col).agg(F.count("*").cast("bigint").alias("count")).orderBy(col)


def box_stats(df: DataFrame, col: str, by: str) -> DataFrame:
    """quartiles, whiskers (most extreme point inside 1.5 IQR) and outlier count per group."""
    pct = exact_percentiles(df, col, [0.25, 0.5, 0.75], [by])
    q = pct.groupBy(by).agg(
        F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q3"),
    )
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn(
        "hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    )
    j = df.select(by, F.col(col).alias("v")).where(F.col("v").isNotNull()).join(q, by)
    inside = (F.col("v") >= F.col("lo_fence")) & (F.col("v") <= F.col("hi_fence"))
    stats = j.groupBy(by).agg(
        F.min(F.when(inside, F.col("v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("v"))).alias("upper_whisker"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("bigint").alias("n_outliers"),
    )
    return q.join(stats, by).select(by, "q1", "median", "q3", "lower_whisker", "upper_whisker", "n_outliers")


def cluster_profile(df: DataFrame, by: str = "cluster", metrics=PROFILE_METRICS, id_col: str = "id") -> DataFrame:
    """mean of each metric and the member count per cluster."""
    return df.groupBy(by).agg(*[F.avg(m).alias(m) for m in metrics], F.count(id_col).cast("bigint").alias("count"))


def normalize_profile(profile: DataFrame, columns: list[str]) -> DataFrame:
    """F8: min-max scale each column across the (few) profile rows; constant column -> null."""
    mm = profile.agg(F.struct(*[F.min(c).alias(f"min_{c}") for c in columns], *[F.max(c).alias(f"max_{c}") for c in columns])).scalar()
    out = profile
    for c in columns:
        lo, hi = mm[f"min_{c}"], mm[f"max_{c}"]
        out = out.withColumn(c, F.try_divide(F.col(c).cast("double") - lo, F.nullif(hi - lo, F.lit(0))))
    return out


def slice_size(n_rows: int, share: float = 0.1, minimum: int = 5) -> int:
    return max(int(n_rows * share), minimum)


def top_bottom(df: DataFrame, metric: str = "similarity", id_col: str = "id", share: float = 0.1, minimum: int = 5) -> DataFrame:
    """bottom and top ``n = max(int(share * N), minimum)`` rows by ``(metric, id)``.

    Both slices listed ascending, tagged ``slice`` = 'bottom' / 'top'; with
    N < 2n they overlap.  The position comes from a distributed exact rank
    (no single-partition window, no n-row buffer per task).
    """
    rows = df.where(F.col(metric).isNotNull())
    n_rows = rows.count()
    n = slice_size(n_rows, share, minimum)
    ranked = global_rank(rows, [F.col(metric).asc(), F.col(id_col).asc()], "__pos")
    bottom = ranked.where(F.col("__pos") < n).withColumn("slice", F.lit("bottom"))
    top = ranked.where(F.col("__pos") >= n_rows - n).withColumn("slice", F.lit("top"))
    return bottom.unionByName(top).withColumnRenamed("__pos", "position")


def slice_means(slices: DataFrame) -> DataFrame:
    """mean similarity, lengths / 100 and ratio per slice."""
    return slices.groupBy("slice").agg(
        F.avg("similarity").alias("similarity"),
        (F.avg("interviewer_length") / 100).alias("interviewer_length_100"),
        (F.avg("interviewee_length") / 100).alias("interviewee_length_100"),
        F.avg("ratio").alias("ratio"),
    )


def summary_report(df: DataFrame, by: str = "cluster") -> DataFrame:
    """dataset row (``level='dataset'``) and one row per cluster, in one rollup pass."""
    agg = df.rollup(by).agg(
        F.grouping(by).alias("__g"),
        F.count("*").cast("bigint").alias("size"),
        F.avg("similarity").alias("average_similarity"),
        F.min("similarity").alias("min_similarity"),
        F.max("similarity").alias("max_similarity"),
        F.avg("interviewer_length").alias("average_interviewer_length"),
        F.avg("interviewee_length").alias("average_interviewee_length"),
        F.avg("ratio").alias("average_ratio"),
    )
    return agg.withColumn("level", F.when(F.col("__g") == 1, F.lit("dataset")).otherwise(F.lit("cluster"))).drop("__g")
