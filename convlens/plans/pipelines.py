"""Compositions of operators: the reference's end-to-end entry points as Spark plans.

* ``individual_table``   – per-transcript lengths, ratio and speaker similarity
* ``feature_table``      – G1: every per-transcript feature joined by id
* ``transcript_analysis``– E10: individual table + clusters + cluster table + summary
* ``visualize_tables``   – F12: the tables behind the reference's charts
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.functions import text as T
from convlens.functions import vectors as V
from convlens.operators import align as G
from convlens.operators import bow as B
from convlens.operators import profile as P
from convlens.operators import sentiment as S
from convlens.operators import transcripts as TR
from convlens.operators import vectors as VO
from convlens.session import cut_lineage


def speaker_counts(labelled: DataFrame) -> DataFrame:
    """``(id, speaker, term, n)``: the one token table of the labelled parts, written to the shared folder.

    A token never straddles two parts.  Similarity, vocabulary, word lengths
    and the built-in embedder all read these combined counts.
    """
    tokens = labelled.where(F.col("speaker").isNotNull()).select(
        "id", "speaker", F.explode(T.tokens(F.col("text"))).alias("term")
    )
    return cut_lineage(tokens.groupBy("id", "speaker", "term").agg(F.count(F.lit(1)).alias("n")))


def speaker_vectors(
    counts: DataFrame, ids: DataFrame, speaker: str = "interviewee", stop_words=None, min_df: float = 2, max_df: float = 0.95
) -> DataFrame:
    """``(id, term, n)`` of one speaker over the pruned vocabulary; the documents are all ``ids``."""
    mine = B.remove_stop_words(counts.where(F.col("speaker") == speaker).select("id", "term", "n"), stop_words)
    return B.prune(mine, B.vocabulary(mine, ids.agg(F.count("*")).scalar(), min_df, max_df))


def individual_table(
    parts: DataFrame, labelled: DataFrame | None = None, stats: DataFrame | None = None, counts: DataFrame | None = None,
    similarity: DataFrame | None = None,
) -> DataFrame:
    """``(id, interviewer_length, interviewee_length, ratio, similarity)`` per transcript.

    Similarity is the cosine of the two speakers' term-count vectors unless a
    table ``(id, similarity)`` is given.  ``stats`` (from ``text_stats``) and
    ``counts`` (from ``speaker_counts``) are reused when the caller has them.
    """
    labelled = labelled if labelled is not None else TR.label_parts(parts)
    st = stats if stats is not None else TR.text_stats(labelled)
    sim = similarity
    if sim is None:
        sim = VO.count_cosine(counts if counts is not None else speaker_counts(labelled))
    return st.join(sim, "id", "left").select(
        "id",
        "interviewer_length",
        "interviewee_length",
        T.length_ratio("interviewee_length", "interviewer_length").alias("ratio"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def feature_table(parts: DataFrame, lexicon, fillers=None, stop_words=None, clusters: DataFrame | None = None) -> DataFrame:
    """G1: one feature row per transcript, every block joined on ``id``.

    Columns: filler_pct, speaker_balance, total_word_count, word_length_2..7,
    word_length_8_plus, average/minimum/maximum_sentence_sentiment,
    similarity, interviewer_length, interviewee_length, ratio, and ``cluster``
    when ``clusters (id, cluster)`` is given (E4).  Tokens are counted once;
    each block is an aggregation keyed by id, so the joins are co-partitioned.
    """
    labelled = TR.label_parts(parts)
    stats = TR.text_stats(labelled, fillers=fillers or T.DEFAULT_FILLERS)
    ids = stats.select("id")
    counts = speaker_counts(labelled)
    feats = TR.transcript_features(parts, fillers, labelled, stats).select("id", "filler_pct", "speaker_balance")
    wl = B.word_length_features(speaker_vectors(counts, ids, "interviewee", stop_words), ids, "id")
    # base-form sentiment straight from sentence pieces (no sentence text gather)
    sent = S.sentiment_summary(S.score_pieces(TR.sentence_pieces(parts), lexicon), ids)
    table = G.assemble([feats, wl, sent, individual_table(parts, labelled, stats, counts)], "id")
    return table if clusters is None else VO.attach_cluster(table, clusters)


def speaker_embeddings(
    labelled: DataFrame, ids: DataFrame, dim: int, embedder=None, embedder_factory=None, max_length: int = 128, token_count=None
) -> DataFrame:
    """``(id, interviewer, interviewee)`` vectors, written to the shared folder.

    With an ``embedder`` (or a factory, called once per task) each speaker's
    joined text goes through it in sentence chunks (E1, B15, E2); without one
    the built-in hashed embedder reads the token table.
    """
    names = [n for n, _ in TR.SPEAKERS]
    if embedder is None and embedder_factory is None:
        counts = speaker_counts(labelled).select(F.struct("id", "speaker").alias("id"), "term", "n")
        both = F.explode(F.array(*[F.lit(n) for n in names])).alias("speaker")
        keys = ids.select("id", both).select(F.struct("id", "speaker").alias("id"))
        vec = VO.hashed_embedding(counts, keys, dim=dim).select("id.id", "id.speaker", "embedding")
    else:
        texts = cut_lineage(TR.speaker_texts(labelled))
        vec = None
        for n in names:
            one = VO.embed_texts(texts, "id", f"{n}_text", embedder, dim, max_length, token_count, embedder_factory)
            one = one.select("id", F.lit(n).alias("speaker"), "embedding")
            vec = one if vec is None else vec.unionByName(one)
    return cut_lineage(
        vec.groupBy("id").agg(*[F.first(F.when(F.col("speaker") == n, F.col("embedding")), ignorenulls=True).alias(n) for n in names])
    )


def transcript_analysis(
    parts: DataFrame, k: int = 5, seed: int = 42, dim: int = 256, embedder=None, embedder_factory=None, max_length: int = 128, token_count=None
):
    """Similarity of the two speakers' vectors, k-means on the interviewee's, cluster table and summary.

    Both speakers are embedded once, by the caller's model or the built-in
    embedder; similarity and clusters come from the same vectors.  Returns
    ``(individual_with_cluster, cluster_table, summary)``.
    """
    spark = parts.sparkSession
    labelled = TR.label_parts(parts)
    stats = TR.text_stats(labelled)
    emb = speaker_embeddings(labelled, stats.select("id"), dim, embedder, embedder_factory, max_length, token_count)
    similarity = emb.select("id", V.cosine("interviewer", "interviewee").alias("similarity"))
    ind = individual_table(parts, labelled, stats, similarity=similarity)
    # the vector stays with its row through the assignment, so nothing is joined back
    model, member = VO.kmeans_clusters(emb, "id", "interviewee", k=k, seed=seed, keep_vector=True)
    dist = VO.centroid_distance(member, "cluster", "interviewee", VO.centroids_frame(spark, model))
    dist = cut_lineage(dist.select("id", "cluster", "distance"))
    clusters = VO.cluster_table(dist, VO.representatives(dist, "cluster", "id", 3), "cluster", "id")
    with_cluster = cut_lineage(VO.attach_cluster(ind, dist.select("id", "cluster")))
    return with_cluster, clusters, VO.collection_summary(with_cluster)


def visualize_tables(individual: DataFrame) -> dict[str, DataFrame]:
    """the tables behind every chart of the reference, keyed by chart name."""
    P.require_columns(individual, ["id", "similarity", "interviewer_length", "interviewee_length", "ratio"])
    has_clusters = "cluster" in individual.columns
    capped = P.winsorize(individual, "ratio", 0.95, "ratio_capped")
    out = {
        "similarity_histogram": P.histogram(individual, "similarity", 19),
        "ratio_p95": P.percentile(individual, "ratio", 0.95),
        "ratio_trend": P.linear_trend(capped, "similarity", "ratio_capped"),
        "top_bottom": P.top_bottom(individual),
    }
    out["top_bottom_means"] = P.slice_means(out["top_bottom"])
    if has_clusters:
        prof = P.cluster_profile(individual)
        out["cluster_sizes"] = P.value_counts(individual, "cluster")
        out["cluster_similarity_box"] = P.box_stats(individual, "similarity", "cluster")
        out["cluster_ratio_box"] = P.box_stats(individual, "ratio", "cluster")
        out["cluster_profile"] = prof
        out["cluster_profile_normalized"] = P.normalize_profile(prof, [*P.PROFILE_METRICS, "count"])
    out["summary"] = P.summary_report(individual) if has_clusters else P.summary_report(individual.withColumn("cluster", F.lit(None).cast("int")))
    return out
