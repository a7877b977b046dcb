"""Connected components of a distributed edge table: smallest label of the neighbours, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` -> ``(id, root)`` for every id with an edge; root is the smallest id of the component.

    Every round joins edges with labels and is written to the shared folder;
    only the number of changed labels reaches the driver.  A hub's edges are
    combined map-side; where a hub is hot in a join, the other side has one
    row per key, so AQE can split it.  Duplicate edges and loops are allowed.
    """
    e = edges.where(F.col("a") != F.col("b")).select("a", "b")
    sym = cut_lineage(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(
        sym.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root"))
    )
    while True:
        near = (
            sym.join(labels.select(F.col("id").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("root").alias("m"))
        )
        step = cut_lineage(
            labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        )
        up = step.select(F.col("id").alias("root"), F.col("root").alias("up"))
        labels = cut_lineage(
            step.join(up, "root", "left").select(
                "id", F.least("root", F.coalesce("up", "root")).alias("root"), "old"
            )
        )
        if labels.where(F.col("root") != F.col("old")).isEmpty():
            return labels.select("id", "root")
        labels = labels.select("id", "root")
