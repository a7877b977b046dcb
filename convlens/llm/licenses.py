"""License scans (native): a positional rare-token index over licence templates.

A template is a sequence of words with mandatory key phrases inside it.
Document frequencies of the template words over the whole corpus give each
template its anchors: the rarest different words of its key phrases.  A
file's places of an anchor, shifted back by the anchor's offset, are postings
of possible template starts; the postings of a template's anchors are
intersected, and a start stays if every mandatory key phrase stands there.  Its
coverage is the share of the template's words at their places.  A label is
given from ``LEAST`` coverage on.

A phrase holds all its anchors, so which words are the anchors decides the
work, never the result.  All of it happens inside a row: after the frequencies
(one small aggregate) nothing is shuffled, and only DataFrame functions run.

Words: the text with A-Z lower-cased, cut by ``WORD``.  Defined results: a
null text is empty and has no words, no labels, null places and score 0; an
empty table gives an empty one (frequencies of an empty corpus are 0 and ties
go to the earlier word).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANCHORS = 2
LEAST = 0.8


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]  # mandatory key phrases as (offset, length)
    base: bool = False

    @staticmethod
    def of(label: str, text: str, *keys: str, base: bool = False) -> Template:
        words = tuple(text.split())
        spans = []
        for key in keys or (text,):
            k = tuple(key.split())
            at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
            spans.append((at, len(k)))
        return Template(label, words, tuple(spans), base)


BASE = (
    Template.of("gpl", "gnu general public license", base=True),
    Template.of("apache", "apache license", base=True),
    Template.of("cc-by", "cc by", base=True),
    Template.of("mit", "mit license", base=True),
)
#: Common notices, as words; the key phrases are what a notice of that licence cannot lack.
NOTICES = (
    Template.of("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template.of("mit-notice", "released under the mit license", "mit license"),
    Template.of("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template.of("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template.of("lgpl", "gnu lesser general public license"),
    Template.of("agpl", "gnu affero general public license"),
    Template.of("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template.of("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template.of("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    Template.of("cc0", "cc0 1 0"),
    Template.of("mpl-2.0", "mozilla public license version 2 0", "mozilla public license"),
    Template.of("bsd", "redistribution and use in source and binary forms", "source and binary forms"),
    Template.of("isc", "permission to use copy modify and or distribute this software", "distribute this software"),
    Template.of("mit-text", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    Template.of("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template.of("proprietary", "all rights reserved"),
)
TEMPLATES = BASE + NOTICES


def words_of(text: Column) -> Column:
    """The matches of ``WORD``, cut out by what stands between them: that class is plain ASCII, and its runs are found many
    times faster than those of its complement."""
    lower = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)

    def inner(parts: Column) -> Column:
        # only the ends can be empty, both of them in an empty text
        before = F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0)
        behind = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
        return F.slice(parts, before + 1, F.greatest(F.size(parts) - before - behind, F.lit(0)))

    # an array of one, so that the parts are cut once
    return F.get(F.transform(F.array(F.split(lower, BETWEEN)), inner), 0)


def document_frequencies(docs: DataFrame, text_col: str, templates=TEMPLATES) -> dict[str, int]:
    """Documents that hold each key-phrase word, over all documents; at most as many rows as the templates have words."""
    known = sorted({t.words[a + j] for t in templates for a, n in t.keys for j in range(n)})
    words = words_of(F.col(text_col))
    found = docs.select(F.explode(F.array_intersect(F.array(*[F.lit(w) for w in known]), words)).alias("w"))
    counted = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counted.get(w, 0) for w in known}


def anchors(template: Template, df: dict[str, int], most: int = ANCHORS) -> list[tuple[str, int]]:
    """The rarest different words (highest IDF) of the key phrases, each with its first offset in a key phrase."""
    places: dict[str, int] = {}
    for a, n in template.keys:
        for j in range(a, a + n):
            places.setdefault(template.words[j], j)
    ranked = sorted(places.items(), key=lambda x: (df.get(x[0], 0), x[1]))
    return ranked[:most]


def _places(words: Column, word: str, offset: int) -> Column:
    """Places of a word, shifted back by its offset in the template."""
    every = F.sequence(F.lit(0), F.size(words) - 1)
    return F.transform(F.filter(every, lambda i: F.get(words, i) == word), lambda i: i - offset)


def _starts(words: Column, template: Template, df: dict[str, int]) -> Column:
    """Word places, from 0, at which all key phrases of the template stand, ascending."""
    rare = anchors(template, df)
    postings = None
    for word, offset in rare:
        at = _places(words, word, offset)
        postings = at if postings is None else F.array_intersect(postings, at)

    def stands(s: Column) -> Column:
        ok = F.lit(True)
        for a, k in template.keys:
            phrase = F.array(*[F.lit(w) for w in template.words[a : a + k]])
            ok = ok & (s + a >= 0) & (s + a + k <= F.size(words)) & (F.slice(words, F.greatest(s + a + 1, F.lit(1)), F.lit(k)) == phrase)
        return ok

    held = F.array_contains(words, rare[0][0])
    none = F.array().cast("array<int>")
    return F.when(held, F.filter(postings, stands)).otherwise(none)


def _coverage(words: Column, template: Template, starts: Column) -> Column:
    """The largest share of the template's words that stand at their places, over the given starts; 0 without one."""

    def share(s: Column) -> Column:
        hits = F.lit(0)
        for j, w in enumerate(template.words):
            hits = hits + F.when((s + j >= 0) & (F.get(words, F.greatest(s + j, F.lit(0))) == w), 1).otherwise(0)
        return hits.cast("double") / len(template.words)

    return F.coalesce(F.array_max(F.transform(starts, share)), F.lit(0.0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """One row per document: ``id, n_words, n_base, first_word, last_word, base_labels, labels, score, places``.

    ``places`` lists every label with its starts; ``score`` is the largest
    coverage among the labels given.
    """
    df = document_frequencies(docs, text_col, templates)
    rows = docs.select(F.col(id_col).alias("i"), words_of(F.col(text_col)).alias("w"))
    known = F.array(*[F.lit(w) for w in sorted({anchors(t, df)[0][0] for t in templates})])
    w = F.col("w")
    found = []
    for t in templates:
        starts = _starts(w, t, df)
        found.append(F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), starts.alias("starts"), _coverage(w, t, starts).alias("coverage")))
    empty = F.array().cast("array<struct<label:string,base:boolean,starts:array<int>,coverage:double>>")
    hit = rows.select("i", F.size("w").cast("long").alias("n_words"), F.when(F.arrays_overlap(w, known), F.array(*found)).otherwise(empty).alias("f"))
    given = hit.withColumn("f", F.filter("f", lambda x: (F.size(x["starts"]) > 0) & (x["coverage"] >= least)))
    base = given.withColumn("b", F.flatten(F.transform(F.filter("f", lambda x: x["base"]), lambda x: x["starts"])))
    names = lambda f: F.array_join(F.array_sort(F.array_distinct(F.transform(f, lambda x: x["label"]))), ",")
    return base.select(
        F.col("i").alias(id_col),
        "n_words",
        F.size("b").cast("long").alias("n_base"),
        F.array_min("b").cast("long").alias("first_word"),
        F.array_max("b").cast("long").alias("last_word"),
        names(F.filter("f", lambda x: x["base"])).alias("base_labels"),
        names(F.col("f")).alias("labels"),
        F.coalesce(F.array_max(F.transform("f", lambda x: x["coverage"])), F.lit(0.0)).alias("score"),
        F.transform("f", lambda x: F.struct(x["label"].alias("label"), x["starts"].alias("starts"))).alias("places"),
    )
