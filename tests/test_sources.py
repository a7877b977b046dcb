"""Readers and writers (A1-A8) on small files in a scratch folder."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from convlens.operators import transcripts as TR
from convlens.operators import vectors as VO
from convlens.sources import readers as R
from convlens.sources import writers as W


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="convlens-src-")


def test_transcript_csv_first_two_columns(spark, scratch):
    path = os.path.join(scratch, "t.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('Participant,Transcript,extra\n')
        f.write('p1,"Interviewer: Hi, there|Interviewee: Well  yes",x\n')
        f.write('pp1,"Interviewer: a\nb|Interviewee: ""quoted""",y\n')
    df = R.read_transcripts(spark, path)
    assert df.columns == ["id", "transcript"]
    rows = {r["id"]: r["transcript"] for r in df.collect()}
    assert rows["pp1"] == 'Interviewer: a\nb|Interviewee: "quoted"'
    parsed = {r["id"]: r for r in TR.parse_transcript(df).collect()}
    assert parsed["p1"]["interviewee_text"] == "Well  yes"


def test_transcript_table_needs_two_columns(spark):
    with pytest.raises(ValueError):
        TR.read_transcript_table(spark.createDataFrame([("a",)], "only string"))


def test_scores_schema(spark, scratch):
    path = os.path.join(scratch, "scores.csv")
    with open(path, "w") as f:
        f.write("Participant,Overall,Excited\np5,5.5,4.0\npp5,3.25,2.0\n")
    s = R.read_scores(spark, path)
    assert s.columns == ["id", "Overall", "Excited"]
    assert dict(s.dtypes)["id"] == "string" and dict(s.dtypes)["Overall"] == "double"


def test_whole_text_and_csv_roundtrip(spark, scratch):
    tdir = os.path.join(scratch, "texts")
    os.makedirs(tdir)
    for i, txt in enumerate(["Interviewer: x\nline two", "é ü"]):
        with open(os.path.join(tdir, f"{i}.txt"), "w", encoding="utf-8") as f:
            f.write(txt)
    texts = sorted(r["text"] for r in R.read_whole_text(spark, tdir).collect())
    assert texts == ["Interviewer: x\nline two", "é ü"]

    df = spark.createDataFrame([("a", 0.5, ["x", "y"])], "id string, filler_pct double, reps array<string>")
    out = os.path.join(scratch, "out")
    W.write_csv(df, out)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["id", "filler%", "reps"]
    assert back.first()["reps"] == '["x","y"]'


def test_report_lines_format(spark, scratch):
    ind = spark.createDataFrame(
        [("a", 0.85652, 445.0, 3000, 7.0, 0), ("b", 0.9, 445.5, 3001, 8.605, 1)],
        "id string, similarity double, interviewer_length double, interviewee_length long, ratio double, cluster int",
    )
    lines = {r["metric"]: r["line"] for r in W.report_lines(VO.collection_summary(ind)).collect()}
    assert lines["average_similarity"] == "  Average Similarity: 0.8783"
    assert lines["average_interviewer_length"] == "  Average Interviewer Length: 445.2 characters"
    assert lines["cluster_1"] == "  Cluster 1: 1 transcripts"
    path = os.path.join(scratch, "report")
    W.write_report(W.report_lines(VO.collection_summary(ind)), path, header="Summary")
    text = spark.read.text(path).collect()
    assert text[0]["value"] == "Summary" and len(text) == 1 + 9
