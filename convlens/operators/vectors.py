"""Embeddings, similarity and clustering (inventory E).

* Default embedder: hashed, IDF-weighted, L2-normalised term vectors of a fixed
  width, built from the long ``(id, term, n)`` table.  Terms are pre-aggregated
  per ``(id, bucket)`` before one bounded gather per id (at most ``dim``
  entries), so a huge document never becomes one huge group.
* Plug point: ``embed_with`` runs a caller's model over text chunks with
  ``mapInPandas`` (Arrow batches, model loaded once per Python worker) and
  mean-pools chunk vectors per text (E2).
* Similarity is JVM-side array arithmetic; clustering is MLlib ``KMeans``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from convlens.functions import vectors as V
from convlens.session import cut_lineage


# ---------------------------------------------------------------- E1 embedders
def hashed_embedding(counts: DataFrame, ids: DataFrame, dim: int = 256, idf: bool = True) -> DataFrame:
    """E1 default: ``(id, embedding ARRAY<DOUBLE>)`` of width ``dim``.

    ``counts`` is ``(id, term, n)``; ``ids`` lists every document (those
    without terms get the zero vector).  Weight = n * log((N+1)/(df+1)) (the
    MLlib IDF formula), hashed by ``pmod(hash(term), dim)``, then L2-normalised.
    """
    c = counts
    if idf:
        n_docs = ids.agg(F.count("*")).scalar()  # scalar subquery
        df = counts.groupBy("term").agg(F.count("*").alias("df"))
        # written, so that Spark knows its size: below the broadcast limit the counts aren't dealt by term
        w = cut_lineage(df.select("term", F.log((n_docs + 1) / (F.col("df") + 1)).alias("idf")))
        c = counts.join(w, "term").withColumn("w", F.col("n") * F.col("idf"))
    else:
        c = counts.withColumn("w", F.col("n").cast("double"))
    per_bucket = c.groupBy("id", F.pmod(F.hash("term"), F.lit(dim)).alias("b")).agg(F.sum("w").alias("w"))
    gathered = per_bucket.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("b", "w"))).alias("m"))
    # one pass over the sorted entries: the zeros before each, then the zeros behind the last
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    gap = lambda x, k: x["b"] - F.when(k > 0, F.get("m", k - 1)["b"]).otherwise(F.lit(-1)) - 1
    filled = F.flatten(F.transform("m", lambda x, k: F.concat(zeros(gap(x, k)), F.array(x["w"]))))
    dense = F.concat(filled, zeros(F.lit(dim - 1) - F.element_at("m", -1)["b"]))
    vec = ids.select("id").join(gathered, "id", "left").select(
        "id", F.when(F.col("m").isNull(), V.zeros(dim)).otherwise(dense).alias("raw")
    )
    norm = V.l2norm("raw")
    return vec.select(
        "id",
        F.when(norm > 0, F.transform("raw", lambda x: x / norm)).otherwise(F.col("raw")).alias("embedding"),
    )


def embed_with(
    df: DataFrame,
    id_col: str,
    chunk_col: str,
    embedder: Callable | None,
    dim: int,
    embedder_factory: Callable[[], Callable] | None = None,
) -> DataFrame:
    """E1 plug point: ``embedder(list[str]) -> sequence of float vectors`` on chunk rows.

    ``df`` has one row per (id, chunk); blank chunks get the zero vector.
    Output ``(id, chunk ..., embedding ARRAY<DOUBLE>)`` keeps the input columns.
    ``embedder_factory`` (instead of ``embedder``) is called once per task, so
    a model loads once per partition and serves all its Arrow batches.
    """
    if (embedder is None) == (embedder_factory is None):
        raise ValueError("pass exactly one of embedder / embedder_factory")
    schema = TY.StructType(list(df.schema.fields) + [TY.StructField("embedding", TY.ArrayType(TY.DoubleType()))])

    def run(batches):
        import numpy as np

        model = embedder if embedder is not None else embedder_factory()
        for pdf in batches:
            texts = pdf[chunk_col].fillna("").astype(str).tolist()
            keep = [i for i, t in enumerate(texts) if t.strip()]
            out = [[0.0] * dim for _ in texts]
            if keep:
                vecs = np.asarray(model([texts[i] for i in keep]), dtype="float64")
                for j, i in enumerate(keep):
                    out[i] = vecs[j].tolist()
            pdf = pdf.copy()
            pdf["embedding"] = out
            yield pdf

    return df.mapInPandas(run, schema)


def embed_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    embedder: Callable | None,
    dim: int,
    max_length: int = 128,
    token_count=None,
    embedder_factory: Callable | None = None,
) -> DataFrame:
    """E1 end to end with a plugged model: ``(id, embedding)`` for every row.

    A text longer than ``max_length - 2`` tokens is packed into sentence chunks
    (B15) and its chunk vectors are mean-pooled (E2); a shorter text is
    embedded in one piece; an empty or blank text gets the zero vector of
    width ``dim``.  Chunks are scored in Arrow batches by ``embed_with``.
    """
    from convlens.operators.transcripts import chunk_text

    chunks = chunk_text(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", max_length, token_count)
    rows = chunks.select("id", F.explode("chunks").alias("chunk"))
    pooled = mean_pool(embed_with(rows, "id", "chunk", embedder, dim, embedder_factory), ["id"], "embedding", "embedding")
    return df.select(F.col(id_col).alias("id")).join(pooled, "id", "left").select(
        "id", F.coalesce(F.col("embedding"), V.zeros(dim)).alias("embedding")
    )


# ---------------------------------------------------------------- E2 mean pooling
def mean_pool(df: DataFrame, keys: list[str], vec_col: str, out: str = "mean") -> DataFrame:
    """Element-wise mean of the vectors of each group (unweighted).

    Exploded to ``(keys, i, x)`` and averaged with partial aggregation, then
    gathered back per group (at most ``dim`` entries per group).
    """
    long = df.select(*keys, F.posexplode(F.col(vec_col).cast("array<double>")).alias("i", "x"))
    avg = long.groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    return avg.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(out)
    )


def mean_pool_long(df: DataFrame, keys: list[str], vec_col: str) -> DataFrame:
    """E2 in long form ``(keys, dim_index, value)``."""
    long = df.select(*keys, F.posexplode(F.col(vec_col).cast("array<double>")).alias("dim_index", "x"))
    return long.groupBy(*keys, F.col("dim_index").cast("bigint").alias("dim_index")).agg(F.avg("x").alias("value"))


# ---------------------------------------------------------------- E3 similarity
def term_cosine(labelled_tokens: DataFrame, a: str = "interviewer", b: str = "interviewee") -> DataFrame:
    """E3 on sparse term counts: ``(id, similarity)`` between two speakers.

    ``labelled_tokens`` is ``(id, speaker, term)``; the dot product is an
    equi-join on ``(id, term)`` of the two speakers' counts.  Zero vector -> 0.
    """
    return count_cosine(labelled_tokens.groupBy("id", "speaker", "term").agg(F.count("*").alias("n")), a, b)


def count_cosine(counts: DataFrame, a: str = "interviewer", b: str = "interviewee") -> DataFrame:
    """E3 from combined counts ``(id, speaker, term, n)``."""
    tc = counts.withColumn("n", F.col("n").cast("double"))
    left = tc.where(F.col("speaker") == a).select("id", "term", F.col("n").alias("na"))
    right = tc.where(F.col("speaker") == b).select("id", "term", F.col("n").alias("nb"))
    dotp = left.join(right, ["id", "term"]).groupBy("id").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    norms = tc.groupBy("id").agg(
        F.sqrt(F.sum(F.when(F.col("speaker") == a, F.col("n") * F.col("n")))).alias("norm_a"),
        F.sqrt(F.sum(F.when(F.col("speaker") == b, F.col("n") * F.col("n")))).alias("norm_b"),
    )
    return norms.join(dotp, "id", "left").select(
        "id",
        F.coalesce(
            F.try_divide(F.coalesce("dot", F.lit(0.0)), F.nullif(F.col("norm_a") * F.col("norm_b"), F.lit(0.0))),
            F.lit(0.0),
        ).alias("similarity"),
    )


# ---------------------------------------------------------------- E4 clustering
def kmeans_clusters(df: DataFrame, id_col: str, vec_col: str, k: int = 5, seed: int = 42, max_iter: int = 20, keep_vector: bool = False):
    """MLlib k-means with ``k = min(k, n)``; returns ``(model, (id, cluster))``, with ``keep_vector`` also the vector."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = df.count()
    k_eff = max(1, min(k, n))
    kept = [id_col, vec_col] if keep_vector else [id_col]
    data = df.select(*kept, array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = KMeans(k=k_eff, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="cluster").fit(data)
    assigned = model.transform(data).select(*kept, F.col("cluster").cast("int").alias("cluster"))
    return model, assigned


def centroids_frame(spark, model) -> DataFrame:
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster int, centroid array<double>")


# ---------------------------------------------------------------- E5-E9
def centroid_distance(df: DataFrame, cluster_col: str, vec_col: str, centroids: DataFrame) -> DataFrame:
    """E5: Euclidean distance of each member to its cluster centroid.

    ``centroids`` is ``(cluster, centroid)``: one row per cluster, joined by key
    (AQE broadcasts it when its run-time size is under the threshold).
    """
    return df.join(centroids.withColumnRenamed("cluster", cluster_col), cluster_col).withColumn(
        "distance", V.euclidean(F.col(vec_col), F.col("centroid"))
    ).drop("centroid")


def representatives(dist: DataFrame, cluster_col: str, id_col: str, n: int = 3) -> DataFrame:
    """``(cluster, rank, id)`` of the ``n`` members nearest the centroid (ties by id).

    ``row_number() <= n`` becomes a per-partition group limit before the
    shuffle, so even a huge cluster ships only ``n`` rows per task.
    """
    w = Window.partitionBy(cluster_col).orderBy(F.col("distance"), F.col(id_col))
    return (
        dist.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .select(cluster_col, F.col("rank").cast("bigint").alias("rank"), id_col)
    )


def cluster_table(assigned: DataFrame, reps: DataFrame, cluster_col: str, id_col: str) -> DataFrame:
    """``(cluster_id, size, representative_ids ARRAY)``; empty clusters are absent."""
    sizes = assigned.groupBy(cluster_col).agg(F.count("*").cast("bigint").alias("size"))
    rep = reps.groupBy(cluster_col).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(id_col).cast("string").alias("v")))), lambda s: s["v"]).alias(
            "representative_ids"
        )
    )
    return sizes.join(rep, cluster_col, "left").select(
        F.col(cluster_col).cast("int").alias("cluster_id"), "size", "representative_ids"
    )


def attach_cluster(individual: DataFrame, assigned: DataFrame, id_col: str = "id") -> DataFrame:
    """Left join of the cluster assignment onto the individual table."""
    return individual.join(assigned.dropDuplicates([id_col]), id_col, "left")


def collection_summary(individual: DataFrame, cluster_col: str | None = "cluster") -> DataFrame:
    """``(section, metric, value)`` rows: count, similarity mean/min/max,
    mean lengths, mean ratio (nulls ignored) and the size of each cluster."""
    stats = individual.agg(
        F.count("*").cast("double").alias("number_of_transcripts"),
        F.avg("similarity").alias("average_similarity"),
        F.min("similarity").alias("min_similarity"),
        F.max("similarity").alias("max_similarity"),
        F.avg("interviewer_length").alias("average_interviewer_length"),
        F.avg("interviewee_length").alias("average_interviewee_length"),
        F.avg("ratio").alias("average_ratio"),
    )
    names = stats.columns
    long = stats.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")
    ).select(F.lit("individual").alias("section"), "m.metric", "m.value")
    if cluster_col is None or cluster_col not in individual.columns:
        return long
    sizes = individual.where(F.col(cluster_col).isNotNull()).groupBy(cluster_col).agg(F.count("*").cast("double").alias("value")).select(
        F.lit("cluster").alias("section"),
        F.concat(F.lit("cluster_"), F.col(cluster_col).cast("string")).alias("metric"),
        "value",
    )
    return long.unionByName(sizes)
