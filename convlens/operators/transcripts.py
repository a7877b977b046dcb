"""Transcript parsing and per-transcript text features (inventory B).

Data model
----------
A transcript is a string of turns separated by ``|``; a turn starts with a
speaker label.  Two inputs reach the same long form, the *parts* table
``(id, turn, sub, part)``, without a shuffle:

* ``parts_from_transcripts``: ``(id, transcript)`` rows, one per transcript
  (the reference's CSV model), exploded with ``posexplode``;
* ``parts_from_conversations``: one row per turn ``(conv_id, turn, role, text)``;
  the label is prefixed by role and the turn is split on ``|`` like the joined
  transcript would be.

All per-transcript features are computed from the parts table by aggregation
(sums of per-part values plus a correction for the single space that joins two
parts), so a huge conversation is partially aggregated in parallel and never
collected into one task.  Only operators whose output *is* one string per
transcript (``speaker_texts``) gather a group.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.functions import text as T
from convlens.operators import phrases
from convlens.operators.sequence import DEFAULT_BUCKET, exclusive_prefix_sum, ordinal

SPEAKERS = (("interviewer", T.INTERVIEWER_LABEL), ("interviewee", T.INTERVIEWEE_LABEL))

# Role of a conversation turn -> label written in front of it (fixed mapping
# used to read a chat table as an interview; roles without a label stay unlabelled).
DEFAULT_ROLE_LABELS = {"user": "Interviewer: ", "assistant": "Interviewee: "}


# ---------------------------------------------------------------- sources of parts
def parts_from_transcripts(df: DataFrame, id_col: str = "id", text_col: str = "transcript") -> DataFrame:
    """B1 on the string form: one row per raw turn ``(id, turn, sub, part)``."""
    return df.select(
        F.col(id_col).alias("id"),
        F.posexplode(T.split_turns(F.coalesce(F.col(text_col), F.lit("")))).alias("turn", "part"),
    ).select("id", F.col("turn").cast("bigint").alias("turn"), F.lit(0).cast("bigint").alias("sub"), "part")


def labelled_turn_text(role_col="role", text_col="text", role_labels=None):
    labels = role_labels or DEFAULT_ROLE_LABELS
    label = F.lit("")
    expr = None
    for role, lab in labels.items():
        cond = F.col(role_col) == F.lit(role)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    label = expr.otherwise(F.lit("")) if expr is not None else label
    return F.concat(label, F.coalesce(F.col(text_col), F.lit("")))


def parts_from_conversations(
    conv: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_labels=None
) -> DataFrame:
    """A1 + B1 on the long form: each turn becomes ``label + text`` split on ``|``.

    Equal to splitting the ``|``-joined transcript, without building it.
    """
    return conv.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.posexplode(T.split_turns(labelled_turn_text(role_labels=role_labels))).alias("sub", "part"),
    ).select("id", "turn", F.col("sub").cast("bigint").alias("sub"), "part")


def transcripts_from_conversations(
    conv: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_labels=None
) -> DataFrame:
    """A1 view ``(id, transcript)`` of a turn table: labelled turns joined by ``|`` in turn order.

    This output is one string per conversation, so it gathers each
    conversation; feature operators never need it (they use the parts table).
    """
    turns = conv.select(
        F.col(id_col).alias("id"),
        F.struct(F.col(turn_col).alias("k"), labelled_turn_text(role_labels=role_labels).alias("t")).alias("kt"),
    )
    return turns.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("kt")), lambda x: x["t"]), T.TURN_DELIMITER).alias(
            "transcript"
        )
    )


def read_transcript_table(df: DataFrame) -> DataFrame:
    """A1 column rule: first two columns by position become ``id, transcript``."""
    if len(df.columns) < 2:
        raise ValueError(f"a transcript table needs at least 2 columns, got {df.columns}")
    a, b = df.columns[:2]
    return df.select(F.col(a).cast("string").alias("id"), F.col(b).cast("string").alias("transcript"))


# ---------------------------------------------------------------- B2/B3 classify and strip
def label_parts(parts: DataFrame, speakers=SPEAKERS) -> DataFrame:
    """B2 + B3: add ``speaker`` (null when unlabelled) and the label-free, stripped ``text``."""
    spk = T.speaker_of("part", speakers)
    text = None
    for name, label in speakers:
        branch = T.strip_label("part", label)
        cond = F.col("speaker") == F.lit(name)
        text = F.when(cond, branch) if text is None else text.when(cond, branch)
    return parts.withColumn("speaker", spk).withColumn("text", text)


def split_transcript(df: DataFrame, text_col: str = "transcript") -> DataFrame:
    """B1 as a column: ``turns ARRAY<STRING>``."""
    return df.withColumn("turns", T.split_turns(F.col(text_col)))


def parse_transcript(df: DataFrame, text_col: str = "transcript", speakers=SPEAKERS) -> DataFrame:
    """B4 on the string form, row-local: one text per speaker, turns joined by a space."""
    out = df
    for name, label in speakers:
        turns = T.split_turns(F.coalesce(F.col(text_col), F.lit("")))
        mine = F.filter(turns, _is_speaker(name, speakers))
        out = out.withColumn(f"{name}_text", F.array_join(F.transform(mine, _stripper(label)), " "))
    return out


def _is_speaker(name, speakers):
    return lambda p: T.speaker_of(p, speakers) == F.lit(name)


def _stripper(label):
    return lambda p: T.strip_label(p, label)


def parse_one_speaker(df: DataFrame, text_col: str = "transcript", name: str = "interviewee") -> DataFrame:
    """Only one speaker's text (label list of one)."""
    label = dict(SPEAKERS)[name]
    turns = T.split_turns(F.coalesce(F.col(text_col), F.lit("")))
    mine = F.filter(turns, lambda p: T.strip_ws(p).startswith(label))
    return df.withColumn(f"{name}_text", F.array_join(F.transform(mine, lambda p: T.strip_label(p, label)), " "))


def clean_labels(df: DataFrame, text_col: str = "transcript", out: str = "clean_text") -> DataFrame:
    """Drop both labels anywhere (with the whitespace after); unlabelled text kept."""
    return df.withColumn(out, T.clean_speaker_labels(F.col(text_col)))


def speaker_texts(labelled: DataFrame, speakers=SPEAKERS) -> DataFrame:
    """B4 from the parts table: ``(id, interviewer_text, interviewee_text)``.

    Gathers each transcript's turns (the output is one string per speaker).
    A transcript without a turn of a speaker gets ''.
    """
    aggs = []
    for name, _ in speakers:
        kt = F.when(F.col("speaker") == F.lit(name), F.struct("turn", "sub", "text"))
        aggs.append(
            F.array_join(F.transform(F.array_sort(F.collect_list(kt)), lambda x: x["text"]), " ").alias(f"{name}_text")
        )
    return labelled.groupBy("id").agg(*aggs)


# ---------------------------------------------------------------- B7-B12 features
def _speaker_sum(name: str, value) -> F.Column:
    return F.sum(F.when(F.col("speaker") == F.lit(name), value).otherwise(F.lit(0)))


def text_stats(labelled: DataFrame, speakers=SPEAKERS, fillers=None, filler_speaker: str = "interviewee") -> DataFrame:
    """B7, B9 (+ in-part filler hits): one aggregation per transcript.

    length(join(parts, ' ')) = sum(length(part)) + (n_parts - 1) for n_parts > 0.
    With ``fillers``, ``part_filler_hits`` sums the dictionary's hits inside
    each part of ``filler_speaker`` (phrases across parts are added by
    ``cross_part_filler_hits``).
    """
    aggs = []
    for name, _ in speakers:
        n = _speaker_sum(name, F.lit(1))
        chars = _speaker_sum(name, F.length("text"))
        aggs += [
            F.when(n > 0, chars + n - 1).otherwise(F.lit(0)).cast("bigint").alias(f"{name}_length"),
            _speaker_sum(name, T.word_count("text")).cast("bigint").alias(f"{name}_words"),
        ]
    if fillers is not False and fillers is not None:
        aggs.append(_speaker_sum(filler_speaker, T.filler_hits("text", fillers)).cast("bigint").alias("part_filler_hits"))
    return labelled.groupBy("id").agg(*aggs)


def length_features(labelled: DataFrame) -> DataFrame:
    """B7 + B8: ``(id, interviewer_length, interviewee_length, ratio)``; ratio null if interviewer is empty."""
    s = text_stats(labelled)
    return s.select(
        "id",
        "interviewer_length",
        "interviewee_length",
        T.length_ratio("interviewee_length", "interviewer_length").alias("ratio"),
    )


def speaker_balance(labelled: DataFrame) -> DataFrame:
    """B9 + B10: interviewee words / all words, 0 when there are no words."""
    s = text_stats(labelled)
    return s.select(
        "id",
        "interviewer_words",
        "interviewee_words",
        T.share("interviewee_words", F.col("interviewer_words") + F.col("interviewee_words")).alias("speaker_balance"),
    )


def _reach(fillers) -> tuple[list[tuple[str, str]], bool]:
    """What can match across the space between two parts: pairs of neighbouring
    words of the multi-word literals, and whether a regex entry might (one that
    can match white space or looks at its surroundings)."""
    pairs, always = [], False
    for name, pattern in fillers or T.DEFAULT_FILLERS:
        if pattern is not None:
            always = always or any(x in pattern for x in (" ", r"\s", r"\W", r"\S", ".", "[^", "^", "$", "(?", r"\A", r"\z", r"\Z", r"\D"))
        else:
            words = name.lower().split(" ")
            pairs += list(zip(words, words[1:]))
    return sorted(set(pairs)), always


def filler_counts(labelled: DataFrame, speaker: str = "interviewee", fillers=None, bucket_size: int = DEFAULT_BUCKET) -> DataFrame:
    """``(id, filler, n)`` hits of each dictionary entry in one speaker's joined text.

    Counted per part (patterns are literals, compiled once) and summed, then
    corrected for the runs of parts that an entry can reach across.  A large
    dictionary of literals is counted by tokens instead (``phrases``), with
    equal results.
    """
    entries = list(fillers or T.DEFAULT_FILLERS)
    if len(entries) > MANY_FILLERS and all(p is None and phrases.plain(n) for n, p in entries):
        return _phrase_fillers(labelled, speaker, [n for n, _ in entries], bucket_size)
    table = T.filler_table(fillers)
    mine = labelled.where(F.col("speaker") == F.lit(speaker))
    lowered = F.lower(F.col("text"))
    per_part = mine.select(
        "id",
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("filler"), T.regex_count(lowered, rx).alias("n")) for n, rx in table])
        ).alias("h"),
    ).select("id", F.col("h.filler").alias("filler"), F.col("h.n").cast("bigint").alias("n"))
    counts = per_part.groupBy("id", "filler").agg(F.sum("n").alias("n"))
    cross = _cross_part_hits(mine, fillers, bucket_size)
    if cross is None:
        return counts
    return counts.join(cross, ["id", "filler"], "left").select(
        "id", "filler", (F.col("n") + F.coalesce(F.col("x"), F.lit(0))).cast("bigint").alias("n")
    )


MANY_FILLERS = 50


def _phrase_fillers(labelled: DataFrame, speaker: str, names: list[str], bucket_size: int) -> DataFrame:
    """``filler_counts`` of literals by their tokens.

    Two parts are joined only where the last word of one and the first of the
    next are neighbours in an entry: the pairs meet in a hash join.
    """
    mine = labelled.where(F.col("speaker") == F.lit(speaker))
    lowered = {n: n.lower() for n in names}
    hits = phrases.phrase_counts(mine, ["id"], "text", list(lowered.values()))
    last, first = F.regexp_extract(F.lower("text"), r"(?U)(\w+)\z", 1), F.regexp_extract(F.lower("text"), r"(?U)^(\w+)", 1)
    pairs = set()
    for n in lowered.values():
        words = n.split(" ")
        for a, b in zip(words, words[1:]):
            x, y = re.search(r"(\w+)\Z", a), re.match(r"\w+", b)
            if x and y:
                pairs.add((x[1], y[0]))
    extra = None
    if pairs:
        near = labelled.sparkSession.createDataFrame(sorted(pairs), "left_word string, right_word string")
        ordered = ordinal(mine.select("id", "turn", "sub", "text"), ["id"], ["turn", "sub"], "ord", bucket_size)
        rows = ordered.select("id", "ord", "text", last.alias("last"), first.alias("first"))
        next_ = rows.select("id", (F.col("ord") - 1).alias("ord"), F.col("first").alias("next"))
        borders = rows.join(next_, ["id", "ord"]).join(near, (F.col("last") == F.col("left_word")) & (F.col("next") == F.col("right_word")), "left_semi").select("id", "ord")
        to_next = borders.withColumn("on", F.lit(True))
        to_prev = borders.select("id", (F.col("ord") + 1).alias("ord"), F.lit(True).alias("back"))
        runs = rows.join(to_next, ["id", "ord"], "left").join(to_prev, ["id", "ord"], "left").where("on OR back")
        runs = runs.select("id", "ord", "text", F.when(F.col("back"), 0).otherwise(1).alias("start"))
        numbered = exclusive_prefix_sum(runs, ["id"], ["ord"], "start", "earlier", bucket_size)
        inside = phrases.phrase_counts(runs, ["id"], "text", list(lowered.values())).select("id", "phrase", (-F.col("n")).alias("n"))
        whole = numbered.groupBy("id", (F.col("earlier") + F.col("start")).alias("run")).agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text")
        )
        extra = phrases.phrase_counts(whole, ["id"], "text", list(lowered.values())).unionByName(inside)
    counts = (hits if extra is None else hits.unionByName(extra)).groupBy("id", "phrase").agg(F.sum("n").alias("n"))
    named = labelled.sparkSession.createDataFrame(list(lowered.items()), "filler string, phrase string")
    # every entry of every speaker, as in the other form
    every = mine.select("id").distinct().withColumn("filler", F.explode(F.split(F.lit("\u0001".join(names)), "\u0001"))).join(named, "filler")
    return every.join(counts, ["id", "phrase"], "left").select("id", "filler", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _cross_part_hits(mine: DataFrame, fillers, bucket_size: int = DEFAULT_BUCKET) -> DataFrame | None:
    """``(id, filler, x)``: hits of the joined text less the hits of its parts; None when no entry can span parts.

    Matching restarts cleanly at the space between two parts unless an entry
    can reach across it.  Parts are therefore joined only into runs whose
    inner borders some entry can reach across: the last word before the border
    and the first word behind it are neighbours in a literal.  A run's text is
    counted as a whole, so overlapping hits and hits over three or more parts
    come out as in the joined text.  Only a dictionary with a regex that can
    match white space makes one run of all parts of a speaker.
    """
    pairs, always = _reach(fillers)
    if not pairs and not always:
        return None
    ordered = ordinal(mine.select("id", "turn", "sub", "text"), ["id"], ["turn", "sub"], "ord", bucket_size)
    lowered = F.lower(F.col("text"))

    def hits(test) -> F.Column:
        if always:
            return F.array(F.lit(0))
        return F.filter(F.array(*[F.when(test(k), F.lit(k)) for k in range(len(pairs))]), lambda x: x.isNotNull())

    rows = ordered.select(
        "id", "ord", "text",
        hits(lambda k: lowered.endswith(pairs[k][0])).alias("tails"),
        hits(lambda k: lowered.startswith(pairs[k][1])).alias("heads"),
    )
    before = rows.where(F.size("tails") > 0).select("id", (F.col("ord") + 1).alias("ord"), F.col("tails").alias("before"))
    after = rows.where(F.size("heads") > 0).select("id", (F.col("ord") - 1).alias("ord"), F.col("heads").alias("after"))
    linked = rows.join(before, ["id", "ord"], "left").join(after, ["id", "ord"], "left")
    to_prev = F.coalesce(F.arrays_overlap("before", "heads"), F.lit(False))
    to_next = F.coalesce(F.arrays_overlap("after", "tails"), F.lit(False))
    runs = linked.where(to_prev | to_next).select("id", "ord", "text", F.when(to_prev, 0).otherwise(1).alias("start"))
    numbered = exclusive_prefix_sum(runs, ["id"], ["ord"], "start", "earlier", bucket_size)
    joined = numbered.groupBy("id", (F.col("earlier") + F.col("start")).alias("run")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: F.lower(x["text"])).alias("parts")
    )
    whole = F.array_join("parts", " ")

    def extra(rx: str):
        own = F.aggregate(F.transform("parts", lambda p: T.regex_count(p, rx)), F.lit(0), lambda s, n: s + n)
        return (T.regex_count(whole, rx) - own).cast("bigint")

    each = F.array(*[F.struct(F.lit(n).alias("filler"), extra(rx).alias("x")) for n, rx in T.filler_table(fillers)])
    found = joined.select("id", F.explode(each).alias("h")).where(F.col("h.x") != 0)
    return found.groupBy("id", F.col("h.filler").alias("filler")).agg(F.sum("h.x").alias("x"))


def cross_part_filler_hits(labelled: DataFrame, speaker: str = "interviewee", fillers=None, bucket_size: int = DEFAULT_BUCKET) -> DataFrame | None:
    """``(id, cross_hits)``: hits of the joined text less those of its parts; None when no entry can span parts."""
    cross = _cross_part_hits(labelled.where(F.col("speaker") == F.lit(speaker)), fillers, bucket_size)
    return None if cross is None else cross.groupBy("id").agg(F.sum("x").alias("cross_hits"))


def filler_percent(labelled: DataFrame, speaker: str = "interviewee", fillers=None, stats: DataFrame | None = None) -> DataFrame:
    """Total filler hits / whitespace words of the speaker, 0 when no words."""
    st = stats if stats is not None else text_stats(labelled, fillers=fillers or T.DEFAULT_FILLERS, filler_speaker=speaker)
    cross = cross_part_filler_hits(labelled, speaker, fillers)
    hits = F.col("part_filler_hits")
    if cross is not None:
        st = st.join(cross, "id", "left")
        hits = hits + F.coalesce(F.col("cross_hits"), F.lit(0))
    words = F.col(f"{speaker}_words")
    return st.select(
        "id",
        hits.cast("bigint").alias("filler_hits"),
        words.cast("bigint").alias("words"),
        T.share(hits, words).alias("filler_pct"),
    )


# ---------------------------------------------------------------- B13 sentences (long form)
def sentence_pieces(parts: DataFrame, bucket_size: int = DEFAULT_BUCKET) -> DataFrame:
    """``(id, sentence_no, turn, sub, j, piece)``: every piece of every sentence.

    All raw turns (labelled or not) have their labels removed (B6); a part is
    split after ``[.!?]`` + whitespace into pieces, and a part that ends with a
    terminator closes its last sentence at the space that joins it to the
    next part.  The sentence number of a piece is a skew-safe prefix sum of
    boundaries over the parts before it, so numbering equals a split of the
    joined text.
    """
    cleaned = parts.select("id", "turn", "sub", T.clean_speaker_labels(F.col("part")).alias("c"))
    with_b = cleaned.select(
        "id",
        "turn",
        "sub",
        T.sentence_pieces("c").alias("pieces"),
        T.ends_with_terminator("c").alias("ends"),
    ).withColumn("nb", F.size("pieces") - 1 + F.when(F.col("ends"), 1).otherwise(0))
    numbered = exclusive_prefix_sum(with_b, ["id"], ["turn", "sub"], "nb", "base", bucket_size)
    return numbered.select("id", "turn", "sub", "base", F.posexplode("pieces").alias("j", "piece")).select(
        "id", (F.col("base") + F.col("j")).alias("sentence_no"), "turn", "sub", "j", "piece"
    )


def sentence_table(parts: DataFrame, bucket_size: int = DEFAULT_BUCKET) -> DataFrame:
    """``(id, sentence_no, sentence)`` of the whole transcript.

    Turns are joined by a space and split after ``[.!?]`` + whitespace; blank
    sentences are dropped.  ``sentence_no`` is the position in the split
    (blank ones included).  Pieces of one sentence are gathered per
    ``(id, sentence_no)`` to build its text; scores that do not need the text
    use ``sentence_pieces`` directly.
    """
    pieces = sentence_pieces(parts, bucket_size).select("id", "sentence_no", F.struct("turn", "sub", "piece").alias("tp"))
    sent = pieces.groupBy("id", "sentence_no").agg(
        T.strip_ws(F.array_join(F.transform(F.array_sort(F.collect_list("tp")), lambda x: x["piece"]), " ")).alias(
            "sentence"
        )
    )
    return sent.where(F.col("sentence") != F.lit(""))


def sentences_of_text(df: DataFrame, text_col: str, out: str = "sentences") -> DataFrame:
    """B13 on one text column, row-local."""
    return df.withColumn(out, T.split_sentences(F.col(text_col)))


def sentences_by_runs(df: DataFrame, text_col: str, out: str = "sentences") -> DataFrame:
    """Split on runs of ``[.!?]``, punctuation dropped."""
    return df.withColumn(out, T.split_sentences_runs(F.col(text_col)))


def chunk_text(df: DataFrame, text_col: str, max_length: int = 128, token_count=None, out: str = "chunks") -> DataFrame:
    """Greedy packing of B14 sentences into chunks of at most ``max_length - 2`` tokens.

    Only a text of more than ``max_length - 2`` tokens is chunked; a shorter one
    is a single chunk (the whole text), an empty one has no chunk.  The token
    count is a Column function of a sentence (default: whitespace tokens).
    """
    count = token_count or T.word_count
    limit = max_length - 2
    sents = T.split_sentences_runs(F.col(text_col))
    counts = F.transform(sents, lambda s: count(s))
    packed = T.pack_chunks(sents, counts, limit)
    whole = F.when(T.is_blank(F.col(text_col)) | F.col(text_col).isNull(), F.array().cast("array<string>")).otherwise(
        F.array(F.col(text_col))
    )
    return df.withColumn(out, F.when(count(F.coalesce(F.col(text_col), F.lit(""))) > limit, packed).otherwise(whole))


# ---------------------------------------------------------------- one row per transcript
def transcript_features(
    parts: DataFrame, fillers=None, labelled: DataFrame | None = None, stats: DataFrame | None = None, bucket_size: int = DEFAULT_BUCKET
) -> DataFrame:
    """Lengths, ratio, word counts, speaker balance and filler share per transcript.

    One aggregation per transcript for all per-part sums (``text_stats``),
    plus the cross-part phrase correction joined by id.
    """
    labelled = labelled if labelled is not None else label_parts(parts)
    st = stats if stats is not None else text_stats(labelled, fillers=fillers or T.DEFAULT_FILLERS)
    cross = cross_part_filler_hits(labelled, "interviewee", fillers, bucket_size)
    hits = F.col("part_filler_hits")
    if cross is not None:
        st = st.join(cross, "id", "left")
        hits = hits + F.coalesce(F.col("cross_hits"), F.lit(0))
    return st.select(
        "id",
        "interviewer_length",
        "interviewee_length",
        T.length_ratio("interviewee_length", "interviewer_length").alias("ratio"),
        "interviewer_words",
        "interviewee_words",
        T.share("interviewee_words", F.col("interviewer_words") + F.col("interviewee_words")).alias("speaker_balance"),
        hits.cast("bigint").alias("filler_hits"),
        T.share(hits, F.col("interviewee_words")).alias("filler_pct"),
    )


def transcript_features_rowwise(df: DataFrame, text_col: str = "transcript", fillers=None) -> DataFrame:
    """The same features as ``transcript_features`` on the string form, row-local.

    Each transcript row is parsed and measured in place (no shuffle), which
    suits streams of whole transcripts.  Equal to the long form (see tests).
    """
    parsed = parse_transcript(df, text_col)
    er, ee = F.col("interviewer_text"), F.col("interviewee_text")
    return parsed.select(
        "id",
        F.length(er).cast("bigint").alias("interviewer_length"),
        F.length(ee).cast("bigint").alias("interviewee_length"),
        T.length_ratio(F.length(ee), F.length(er)).alias("ratio"),
        T.word_count(er).cast("bigint").alias("interviewer_words"),
        T.word_count(ee).cast("bigint").alias("interviewee_words"),
        T.share(T.word_count(ee), T.word_count(er) + T.word_count(ee)).alias("speaker_balance"),
        T.filler_hits(ee, fillers).cast("bigint").alias("filler_hits"),
        T.share(T.filler_hits(ee, fillers), T.word_count(ee)).alias("filler_pct"),
    )
