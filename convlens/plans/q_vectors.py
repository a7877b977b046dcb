"""Driver queries for inventory E (embeddings, similarity, clustering)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convlens.functions import vectors as V
from convlens.operators import bow as B
from convlens.operators import transcripts as TR
from convlens.operators import vectors as VO
from convlens.plans import pipelines as PL
from convlens.plans.q_transcripts import conv_parts
from convlens.plans.registry import query, table, union_tables
from convlens.plans.sqlparts import INDIVIDUAL_CTE


def individual(spark, sf, with_cluster: bool = True):
    ind = PL.individual_table(conv_parts(spark, sf))
    if with_cluster:
        ind = ind.withColumn("cluster", F.pmod(F.col("id"), F.lit(5)).cast("int"))
    return ind


EMB_LONG = """
el AS (SELECT vec_id, label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
cen AS (SELECT label, i, avg(x) AS cx FROM el GROUP BY label, i),
dist AS (SELECT el.vec_id, el.label, sqrt(sum((el.x - cen.cx) * (el.x - cen.cx))) AS distance
         FROM el JOIN cen USING (label, i) GROUP BY el.vec_id, el.label),
reps AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM dist)
"""


@query("e1_embed_hashed", None)
def e1(spark, sf):
    docs = table(spark, sf, "documents")
    # texts are dealt by id once: counts, buckets and vectors of a document then need no other shuffle
    dealt = docs.select("doc_id", "text").repartition("doc_id")
    counts = B.term_counts(B.tokenize(dealt, "doc_id", "text"))
    ids = docs.select(F.col("doc_id").alias("id"))
    return VO.hashed_embedding(counts, ids, dim=64).withColumnRenamed("id", "doc_id")


def _stub_embedder(texts):
    """Deterministic stand-in model: letter-frequency vector of width 26."""
    import numpy as np

    out = np.zeros((len(texts), 26))
    for r, t in enumerate(texts):
        letters = np.frombuffer(t.lower().encode("ascii", "ignore"), np.uint8)
        out[r] = np.bincount(letters, minlength=123)[97:123]
    return out


@query("e1_embed_plugin", None)
def e1_plugin(spark, sf):
    return VO.embed_texts(table(spark, sf, "documents"), "doc_id", "text", _stub_embedder, 26, max_length=128).withColumnRenamed(
        "id", "doc_id"
    )


@query("e2_mean_pool", """
SELECT label, i AS dim_index, avg(x) AS value
FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i""")
def e2(spark, sf):
    return VO.mean_pool_long(table(spark, sf, "embeddings"), ["label"], "embedding")


@query("e2_mean_pool_array", """
WITH m AS (SELECT label, i, avg(x) AS v FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i)
SELECT label, count(*)::BIGINT AS dims, sum(v) AS total, max(v) AS largest FROM m GROUP BY label""")
def e2_array(spark, sf):
    pooled = VO.mean_pool(table(spark, sf, "embeddings"), ["label"], "embedding", "mean")
    return pooled.select(
        "label",
        F.size("mean").cast("bigint").alias("dims"),
        F.aggregate("mean", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.array_max("mean").alias("largest"),
    )


@query("e3_cosine", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id, b.vec_id AS next_id,
       CASE WHEN sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) = 0 THEN 0.0
            ELSE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) END AS similarity
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1""")
def e3(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    a = e.alias("a")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"), F.col("embedding").alias("nb"))
    return a.join(b, "vec_id").select("vec_id", "next_id", V.cosine(F.col("embedding"), F.col("nb")).alias("similarity"))


@query("e3_speaker_similarity", "WITH " + INDIVIDUAL_CTE + "SELECT id, similarity FROM ind")
def e3_speakers(spark, sf):
    return individual(spark, sf, False).select("id", "similarity")


@query("e4_kmeans", None)
def e4(spark, sf):
    e = table(spark, sf, "embeddings")
    _, assigned = VO.kmeans_clusters(e, "vec_id", "embedding", k=5, seed=42)
    return assigned


@query("e4_nearest_centroid", "SELECT vec_id, true AS nearest FROM embeddings")
def e4_nearest(spark, sf):
    """Every vector lies in the cluster whose centre is nearest, and no centre is without members."""
    e = table(spark, sf, "embeddings")
    model, assigned = VO.kmeans_clusters(e, "vec_id", "embedding", k=5, seed=42)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    far = lambda c: F.aggregate(F.zip_with("embedding", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    rows = e.select("vec_id", "embedding").join(assigned.select("vec_id", "cluster"), "vec_id")
    dist = rows.select("vec_id", "cluster", F.transform(centres, far).alias("d"))
    return dist.select("vec_id", (F.get("d", F.col("cluster").cast("int")) <= F.array_min("d") + 1e-9).alias("nearest"))


def _centroid_dist(spark, sf):
    e = table(spark, sf, "embeddings").withColumnRenamed("label", "cluster")
    cents = VO.mean_pool(e, ["cluster"], "embedding", "centroid")
    return VO.centroid_distance(e, "cluster", "embedding", cents)


@query("e5_centroid_distance", "WITH " + EMB_LONG + "SELECT vec_id, label, distance FROM dist")
def e5(spark, sf):
    return _centroid_dist(spark, sf).select("vec_id", F.col("cluster").alias("label"), "distance")


@query("e6_representatives", "WITH " + EMB_LONG + "SELECT label, rank::BIGINT AS rank, vec_id FROM reps WHERE rank <= 3")
def e6(spark, sf):
    return VO.representatives(_centroid_dist(spark, sf), "cluster", "vec_id", 3).withColumnRenamed("cluster", "label")


@query("e7_cluster_table", "WITH " + EMB_LONG + """
SELECT s.label AS cluster_id, s.size, r.ids AS representative_ids
FROM (SELECT label, count(*)::BIGINT AS size FROM embeddings GROUP BY label) s
JOIN (SELECT label, string_agg(vec_id::VARCHAR, ',' ORDER BY rank) AS ids FROM reps WHERE rank <= 3 GROUP BY label) r USING (label)""")
def e7(spark, sf):
    dist = _centroid_dist(spark, sf)
    reps = VO.representatives(dist, "cluster", "vec_id", 3)
    assigned = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    t = VO.cluster_table(assigned, reps, "cluster", "vec_id")
    return t.select("cluster_id", "size", F.array_join("representative_ids", ",").alias("representative_ids"))


@query("e8_attach_cluster", "WITH " + INDIVIDUAL_CTE + """
SELECT id, interviewer_length::BIGINT AS interviewer_length, interviewee_length::BIGINT AS interviewee_length, ratio, similarity, cluster FROM ind""")
def e8(spark, sf):
    ind = individual(spark, sf, False)
    assigned = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("id"), F.pmod(F.col("conv_id"), F.lit(5)).cast("int").alias("cluster")
    )
    return VO.attach_cluster(ind, assigned)


@query("e9_collection_summary", "WITH " + INDIVIDUAL_CTE + """,
s AS (SELECT count(*)::DOUBLE AS number_of_transcripts, avg(similarity) AS average_similarity, min(similarity) AS min_similarity,
             max(similarity) AS max_similarity, avg(interviewer_length) AS average_interviewer_length,
             avg(interviewee_length) AS average_interviewee_length, avg(ratio) AS average_ratio FROM ind)
SELECT 'individual' AS section, metric, value FROM (UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE value)
UNION ALL
SELECT 'cluster' AS section, 'cluster_' || cluster::VARCHAR AS metric, count(*)::DOUBLE AS value FROM ind GROUP BY cluster""")
def e9(spark, sf):
    return VO.collection_summary(individual(spark, sf))


@query("e10_transcript_analysis", None)
def e10(spark, sf):
    """The three tables of the whole analysis, rows as JSON."""
    with_cluster, clusters, summary = PL.transcript_analysis(conv_parts(spark, sf), k=5, seed=42, dim=64)
    return union_tables({"individual": with_cluster, "clusters": clusters, "summary": summary})
