import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from convlens.llm import bpe, token_blocks

SCHEMA = "doc_id long, text string, i int, t string, part int, ids string"


def odd_texts():
    rnd = random.Random(4)
    out = [
        "", None, "a" * 3000, "ab" * 2000, " " * 2000 + "x", "\n\n \t" * 300, "é" * 900, "日本語" * 300, "🙂👍🏽" * 100, "don't I'll",
        "x" * 257, "x" * 256, "<|endoftext|> a<|startoftext|>b", "Hello, World's!  é ́x", "İstanbul ΑΣ ΣΑΣ", "\x0b a\x0cb\x85c d",
        "Étude, naïve; Ärger: straße! ªº ×÷", "a.b,c.", "...", "A'S 'T", "x́. y",
    ]
    out += ["".join(rnd.choice("aab éßn\n\t'sd1٣日!?🙂,.") for _ in range(rnd.randint(0, 200))) for _ in range(80)]
    out += ["".join(rnd.choice("theinrsaéñ") for _ in range(rnd.randint(260, 900))) for _ in range(20)]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(k, t, 1, "x", 2, "y") for k, t in enumerate(odd_texts())]
    rows += [(None, "null id", 1, "x", 2, "y"), (3, "ab" * 2000, 1, "x", 2, "y")]
    return spark.createDataFrame(rows, SCHEMA)


def test_bpe_equals_tiktoken_and_decodes(spark, table):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    got = bpe.encode(table, path, P.PATTERN, ids=True).collect()
    assert len(got) == table.count()
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.encode(table.limit(0), path, P.PATTERN).count() == 0


def test_bpe_merges_a_smaller_rank_as_soon_as_it_appears():
    # joining "b" and "c" makes a pair of smaller rank than the next "b", "c"
    ranks = {bytes([b]): 300 + b for b in range(256)} | {b"bc": 7, b"abc": 1, b"abcb": 3}
    enc = bpe.Bpe(ranks, r".+")
    text = "abc" * 200 + "bcb" * 50

    def slow(piece):
        parts = [bytes([b]) for b in piece]
        while True:
            ranked = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not ranked:
                return [ranks[p] for p in parts]
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    for t in (text, "abcbc", "bcbcabcb" * 60, "abcb"):
        assert list(enc.encode_batch([t])[0]) == slow(t.encode())


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("most", [1, 2, 300, 49408, 2**32])
def test_blocks_round_trip(n, most):
    rng = np.random.default_rng(n + most)
    x = rng.integers(0, most, n, dtype=np.uint64).astype(np.uint32)
    if n > 300:
        x[rng.integers(0, n, n // 20)] = most - 1
    data, starts = token_blocks.pack(x.astype(np.uint64))
    assert (token_blocks.unpack(data, starts, n) == x).all()
    if len(starts) > 2:  # any block alone
        k = len(starts) // 2
        one = token_blocks.unpack(data[int(starts[k]) :], starts[k : k + 2] - starts[k], 256)
        assert (one[: len(x[256 * k : 256 * k + 256])] == x[256 * k : 256 * k + 256]).all()


def test_outliers_go_to_exception_lists():
    x = np.full(256, 5, np.uint64)
    x[[3, 200]] = 49000
    data, _ = token_blocks.pack(x)
    assert data[4] == 0 and len(data) == 7 + 2 * 5


def test_shards_against_the_tokenizer(spark, table):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    shards = token_blocks.write_shards(table, path, end=2, shard=500)
    assert shards.count() > 3
    got = sorted(token_blocks.read_shards(shards).collect(), key=lambda r: r.start)
    rows = sorted(table.collect(), key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.text or ""))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    start = 0
    for r, row in zip(got, rows, strict=True):
        ids = [*tok.encode(row.text or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_blocks.read_shards(token_blocks.write_shards(table.limit(0), path, end=2)).count() == 0
