"""Subword counts against the tokenizers library with the same vocabulary; chunks against a plain packing."""

import random
import re

import pytest

from convlens.operators import subwords as W
from tests.conftest import SF_SMALL


def library(vocabulary):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    ids = {v: k for k, v in enumerate(sorted(vocabulary | {"[UNK]"}))}
    t = Tokenizer(models.WordPiece(ids, unk_token="[UNK]", max_input_chars_per_word=W.LONGEST))
    t.normalizer = normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=True, lowercase=True)
    t.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    return t


ODD = [
    "", " ", "Élan vital, n'est-ce pas?", "naïvé café", "a\x00b\x0bc\x0cd\u0085e", "漢字かな交じり文", "x" * 99, "x" * 100, "x" * 101, "##ing ##", "$5.00 + 3% = £9",
    "soft­hyphen zero​width �", "İstanbul STRASSE ß", "tab\tnew\nline\r sep　wide", "``´", "emoji 😀👍🏽 ok", "a--b__c", "१२३ ٣",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")


def test_counts_equal_the_library(spark, docs):
    vocabulary = W.piece_vocabulary(docs, "text", size=3000) - {"##q", "z"}
    texts = [r.text for r in docs.collect()]
    rnd = random.Random(2)
    texts += ODD + ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(160, 0x24F), rnd.randint(0x300, 0x36F), rnd.randint(0x2000, 0x206F), rnd.randint(0x3000, 0x9FFF)])) for _ in range(12)) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r.i: r.n_tokens for r in W.subword_counts(df, "text", vocabulary).collect()}
    want = [len(e.ids) for e in library(vocabulary).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [got[k] for k in range(len(texts))] == want
    pieces = W.Pieces({"un", "##aff", "##able", "##a", "able"})
    assert pieces.of_word("unaffable") == ["un", "aff", "able"] and pieces.of_word("unx") is None


def test_chunks_equal_a_plain_packing(spark, docs):
    vocabulary = W.piece_vocabulary(docs, "text", size=2000)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    tok = library(vocabulary)
    extra = [(-1, None), (-2, "  "), (-3, "..."), (-4, "word " * 300), (-5, "One two. Three!")]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    for r in W.chunk_subwords(df, "text", vocabulary, max_length=64).collect():
        text, want = r.text or "", []
        if text.strip():
            if count(text) <= 62:
                want = [(text, count(text))]
            else:
                now, n = [], 0
                for s in [s.strip(" \t\n\r\x0b\x0c") for s in re.split(r"[.!?]+", text)]:
                    if not s:
                        continue
                    k = count(s)
                    if now and n + k > 62:
                        want.append((" ".join(now), n))
                        now, n = [], 0
                    now, n = [*now, s], n + k
                want += [(" ".join(now), n)] if now else []
        assert [tuple(c) for c in r.chunks] == want, r.doc_id
    assert W.subword_counts(df.limit(0), "text", vocabulary).count() == 0


def test_vocabulary_holds_every_character(spark):
    df = spark.createDataFrame([("abc abd", 1), (None, 2), ("É#", 3)], "text string, k int")
    v = W.piece_vocabulary(df, "text", size=2)
    assert {"a", "b", "c", "d", "e", "#", "##a", "##b", "##c", "##d", "##e", "###"} <= v and len(v) == 14 and "ab" in v
