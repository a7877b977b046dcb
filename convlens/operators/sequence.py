"""Order-dependent helpers that stay safe when one group is huge.

A plain ``Window.partitionBy(group).orderBy(...)`` sends every row of a group
to one task.  When one conversation (or document) holds a large share of all
rows, that task becomes the whole job.  The helpers here split each group into
buckets of the leading order column, scan inside buckets in parallel, scan the
tiny per-bucket totals, and add the bucket offset back with a join that AQE
turns into a broadcast when the offsets table is small (its size is checked at
run time by Spark, with a sort-merge join beyond the threshold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlens.session import cut_lineage

DEFAULT_BUCKET = 4096


def exclusive_prefix_sum(
    df: DataFrame,
    group: list[str],
    order: list[str],
    value,
    out: str,
    bucket_size: int = DEFAULT_BUCKET,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the rows before this one in its group.

    ``order[0]`` must be numeric; rows are bucketed by ``floor(order[0] / bucket_size)``.
    """
    val = F.col(value) if isinstance(value, str) else value
    bcol = "__bucket"
    vcol = "__v"
    d = df.withColumn(bcol, F.floor(F.col(order[0]) / F.lit(bucket_size))).withColumn(vcol, val.cast("bigint"))
    w_local = (
        Window.partitionBy(*group, bcol)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    d = d.withColumn("__local", F.coalesce(F.sum(vcol).over(w_local), F.lit(0)))
    totals = d.groupBy(*group, bcol).agg(F.sum(vcol).alias("__t"))
    w_bucket = Window.partitionBy(*group).orderBy(bcol).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__off", F.coalesce(F.sum("__t").over(w_bucket), F.lit(0))).drop("__t")
    return (
        d.join(offsets, on=[*group, bcol], how="inner")
        .withColumn(out, F.col("__local") + F.col("__off"))
        .drop(bcol, vcol, "__local", "__off")
    )


def ordinal(df: DataFrame, group: list[str], order: list[str], out: str, bucket_size: int = DEFAULT_BUCKET) -> DataFrame:
    """0-based position of each row inside its group (skew-safe ``row_number() - 1``)."""
    return exclusive_prefix_sum(df, group, order, F.lit(1), out, bucket_size)


def global_rank(df: DataFrame, order: list, out: str = "rank") -> DataFrame:
    """Exact 0-based position in a total order, without a single-partition window.

    ``orderBy`` range-partitions and sorts in parallel; each row's position is
    the number of rows in earlier partitions (a prefix sum over a table with
    one row per partition) plus its index inside its partition.  ``order``
    must be a total order (add a unique tie-breaker) so the result is
    deterministic across re-computation.
    """
    tagged = (
        df.orderBy(*order)
        .withColumn("__pid", F.spark_partition_id().cast("bigint"))
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    tagged = tagged.withColumn("__local", F.col("__mid") - F.shiftleft(F.col("__pid"), 33))
    # materialise the sorted, tagged rows once (reliable checkpoint in the shared
    # folder): the counts and the final join must see the same partitioning,
    # also after an executor loss, and the sort is not repeated
    tagged = cut_lineage(tagged)
    counts = tagged.groupBy("__pid").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    return (
        tagged.join(F.broadcast(offsets), "__pid")
        .withColumn(out, F.col("__off") + F.col("__local"))
        .drop("__pid", "__mid", "__local", "__off")
    )


def running_sum(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all earlier rows of the whole table.

    ``order`` is a total order over values of any type.  Rows are range
    partitioned and sorted once and written to the shared folder; the sum runs
    inside each range, and one number per range is summed over ranges.
    """
    tagged = cut_lineage(df.orderBy(*order).withColumn("__pid", F.spark_partition_id()))
    before = Window.partitionBy("__pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy("__pid").agg(F.sum(value).alias("__t"))
    ranges = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = totals.select("__pid", F.coalesce(F.sum("__t").over(ranges), F.lit(0)).alias("__off"))
    local = tagged.withColumn("__local", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return local.join(offsets, "__pid").withColumn(out, F.col("__local") + F.col("__off")).drop("__pid", "__local", "__off")
