"""Golden checks from the reference's stored individual table (copied by value
into tests/fixtures) against the numbers of its published reports."""

import os

import pytest
from pyspark.sql import functions as F

from convlens.operators import profile as P
from convlens.operators import vectors as VO
from convlens.sources import readers as R


@pytest.fixture(scope="module")
def individual(spark, fixtures_dir):
    df = spark.read.option("header", True).option("inferSchema", True).csv(os.path.join(fixtures_dir, "individual_analysis.csv"))
    df = df.withColumn("cluster", F.col("cluster").cast("int"))
    R.load_checked(df)
    return df.cache()


def test_collection_summary(individual):
    got = {r["metric"]: r["value"] for r in VO.collection_summary(individual).collect()}
    assert got["number_of_transcripts"] == 137
    assert round(got["average_similarity"], 4) == 0.8565
    assert round(got["min_similarity"], 4) == 0.7446
    assert round(got["max_similarity"], 4) == 0.9389
    assert round(got["average_interviewer_length"], 1) == 498.7
    assert round(got["average_interviewee_length"], 1) == 3865.2
    assert round(got["average_ratio"], 2) == 7.80
    assert [got[f"cluster_{i}"] for i in range(5)] == [22, 21, 34, 29, 31]


def test_ratio_p95(individual):
    assert abs(P.percentile(individual, "ratio", 0.95).first()[0] - 13.59995) < 1e-4


def test_top_bottom_slices(individual):
    s = P.top_bottom(individual).orderBy("slice", "position").collect()
    bottom = [(r["id"], round(r["similarity"], 4)) for r in s if r["slice"] == "bottom"]
    top = [(r["id"], round(r["similarity"], 4)) for r in s if r["slice"] == "top"]
    assert len(bottom) == 13 and len(top) == 13
    assert bottom[:3] == [("p83", 0.7446), ("p63", 0.7625), ("p74", 0.7678)]
    assert bottom[-1] == ("p72", 0.8115)
    assert top[0] == ("p52", 0.9120)
    assert top[-3:] == [("p67", 0.9336), ("p45", 0.9357), ("p47", 0.9389)]


def test_cluster_report(individual):
    rep = {r["cluster"]: r for r in P.summary_report(individual).where(F.col("level") == "cluster").collect()}
    expected = {0: (22, 0.8531, 6.32), 1: (21, 0.8602, 7.93), 2: (34, 0.8764, 8.63), 3: (29, 0.8585, 7.78), 4: (31, 0.8328, 7.88)}
    for c, (size, sim, ratio) in expected.items():
        assert rep[c]["size"] == size
        assert round(rep[c]["average_similarity"], 4) == sim
        assert round(rep[c]["average_ratio"], 2) == ratio


def test_histogram_counts_all_rows(individual):
    h = P.histogram(individual, "similarity", 19).collect()
    assert len(h) == 19 and sum(r["count"] for r in h) == 137


def test_box_stats_and_profile(individual):
    b = {r["cluster"]: r for r in P.box_stats(individual, "similarity", "cluster").collect()}
    assert set(b) == {0, 1, 2, 3, 4}
    for r in b.values():
        assert r["lower_whisker"] <= r["q1"] <= r["median"] <= r["q3"] <= r["upper_whisker"]
    prof = P.cluster_profile(individual)
    norm = P.normalize_profile(prof, ["similarity", "count"]).collect()
    assert min(r["similarity"] for r in norm) == 0.0 and max(r["similarity"] for r in norm) == 1.0


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([("a", 1.0)], "id string, similarity double")
    with pytest.raises(ValueError, match="interviewer_length"):
        R.load_checked(df)
