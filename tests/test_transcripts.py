"""Transcript parsing and text features on hand-written rows (FIXTURES §3)."""

from pyspark.sql import functions as F

from convlens.functions import text as T
from convlens.operators import transcripts as TR


def _tdf(spark, rows):
    return spark.createDataFrame(rows, "id string, transcript string")


def _features(spark, rows, fillers=None):
    df = _tdf(spark, rows)
    feats = TR.transcript_features(TR.parts_from_transcripts(df), fillers)
    return {r["id"]: r.asDict() for r in feats.collect()}


def _texts(spark, rows):
    parts = TR.label_parts(TR.parts_from_transcripts(_tdf(spark, rows)))
    return {r["id"]: (r["interviewer_text"], r["interviewee_text"]) for r in TR.speaker_texts(parts).collect()}


def test_other_label_inside_turn_is_kept(spark):
    t = _texts(spark, [("a", "Interviewee: Um  good. Interviewer: x")])
    assert t["a"] == ("", "Um  good. Interviewer: x")


def test_unlabelled_turn_dropped_from_speakers_kept_for_sentences(spark):
    rows = [("a", "Interviewer: So how|noise| Interviewee: yes")]
    assert _texts(spark, rows)["a"] == ("So how", "yes")
    sents = TR.sentence_table(TR.parts_from_transcripts(_tdf(spark, rows))).collect()
    assert [r["sentence"] for r in sents] == ["So how noise  yes"]


def test_empty_transcript(spark):
    f = _features(spark, [("e", "")])["e"]
    assert f["interviewer_length"] == 0 and f["interviewee_length"] == 0
    assert f["interviewer_words"] == 0 and f["interviewee_words"] == 0
    assert f["speaker_balance"] == 0.0 and f["filler_pct"] == 0.0
    assert f["ratio"] is None


def test_one_speaker_only(spark):
    f = _features(spark, [("o", "Interviewer: hello")])["o"]
    assert f["speaker_balance"] == 0.0
    assert f["interviewee_length"] == 0
    assert f["ratio"] == 0.0


def test_double_space_breaks_a_phrase(spark):
    rows = [("two", "Interviewee: you  know"), ("one", "Interviewee: you know")]
    counts = TR.filler_counts(TR.label_parts(TR.parts_from_transcripts(_tdf(spark, rows))))
    got = {(r["id"], r["filler"]): r["n"] for r in counts.collect()}
    assert got[("two", "you know")] == 0
    assert got[("one", "you know")] == 1


def test_filler_regex_entries(spark):
    counts = TR.filler_counts(TR.label_parts(TR.parts_from_transcripts(_tdf(spark, [("f", "Interviewee: uh uhh um umm uhm")]))))
    got = {r["filler"]: r["n"] for r in counts.collect()}
    assert got["uh"] == 2 and got["um"] == 2


def test_phrase_across_two_turns_of_the_same_speaker(spark):
    rows = [("x", "Interviewee: well you|Interviewer: hm|Interviewee: know it")]
    counts = TR.filler_counts(TR.label_parts(TR.parts_from_transcripts(_tdf(spark, rows))))
    got = {r["filler"]: r["n"] for r in counts.collect()}
    # joined interviewee text is "well you know it"
    assert got["you know"] == 1


def test_label_removed_everywhere_in_own_turn(spark):
    t = _texts(spark, [("r", "Interviewer: a Interviewer: b")])
    assert t["r"] == ("a  b", "")


def test_null_transcript_gives_empty_features(spark):
    f = _features(spark, [("n", None)])["n"]
    assert f["interviewer_length"] == 0 and f["ratio"] is None


def test_chunk_packing(spark):
    sents = F.array(*[F.lit(f"s{i}") for i in range(6)])
    counts = F.array(*[F.lit(n) for n in [5, 5, 7, 20, 3, 3]])
    row = spark.range(1).select(T.pack_chunks(sents, counts, 12).alias("c")).first()
    assert row["c"] == ["s0 s1", "s2", "s3", "s4 s5"]


def test_chunk_text_short_text_is_one_chunk(spark):
    df = spark.createDataFrame([("a. b. c",), ("",)], "t string")
    rows = TR.chunk_text(df, "t", 128).collect()
    assert rows[0]["chunks"] == ["a. b. c"]
    assert rows[1]["chunks"] == []


def test_sentence_split_keeps_punctuation(spark):
    df = spark.createDataFrame([("Hi there! How are you?  Fine.",)], "t string")
    assert df.select(T.split_sentences("t").alias("s")).first()["s"] == ["Hi there!", "How are you?", "Fine."]
    assert df.select(T.split_sentences_runs("t").alias("s")).first()["s"] == ["Hi there", "How are you", "Fine"]


def test_word_count_of_empty_is_zero(spark):
    df = spark.createDataFrame([("",), ("  a  b ",)], "t string")
    assert [r[0] for r in df.select(T.word_count("t")).collect()] == [0, 2]
