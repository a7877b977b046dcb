"""Subword tokens by greedy longest match (inventory B15, E1).

A text is cleaned (control characters dropped), lower-cased, stripped of
accents and cut at white space, punctuation and ideographs; every word is then
taken apart into the longest pieces of a vocabulary, ``##`` marking those that
continue a word; a word that cannot be, or has over ``LONGEST`` characters, is
one unknown token.  That is the uncased WordPiece scheme, so counts equal those
of its usual implementations for the same vocabulary.

Counting is a map: a task takes every different stretch between white space
apart once.  The vocabulary is a set of strings that the caller gives, or
``piece_vocabulary`` of the corpus.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.functions import text as T
from convlens.session import cut_lineage, scratch, ship_package

LONGEST = 100
_CONTROL = ("Cc", "Cf", "Co", "Cs")
REMEMBERED = 200_000  # stretches whose pieces a task keeps

# White space of the scheme; other white space characters are control characters and vanish.
SPACE = r"\x20\t\n\r   -     　"
_SPACES = re.compile(f"[{SPACE}]+")
_IDEOGRAPH = re.compile("([一-鿿㐀-䶿\U00020000-\U0002a6df\U0002a700-\U0002b73f\U0002b740-\U0002b81f\U0002b920-\U0002ceaf豈-﫿\U0002f800-\U0002fa1f])")


def _punctuation(c: str) -> bool:
    return ("!" <= c <= "/") or (":" <= c <= "@") or ("[" <= c <= "`") or ("{" <= c <= "~") or unicodedata.category(c)[0] == "P"


def words_of(stretch: str) -> list[str]:
    """Words of a stretch without white space."""
    if not stretch.isascii():
        kept = [c for c in stretch if c != "�" and unicodedata.category(c) not in _CONTROL]
        stretch = _IDEOGRAPH.sub(r" \1 ", "".join(kept))
        stretch = "".join([c for c in unicodedata.normalize("NFD", stretch) if unicodedata.category(c) != "Mn"])
    elif not stretch.isprintable():
        stretch = "".join([c for c in stretch if c.isprintable()])
    out: list[str] = []
    for part in stretch.lower().split(" "):
        if part.isalnum():
            out.append(part)
            continue
        word = ""
        for c in part:
            if _punctuation(c):
                out += [word, c] if word else [c]
                word = ""
            else:
                word += c
        out += [word] if word else []
    return out


class Pieces:
    """Greedy longest match over a vocabulary."""

    def __init__(self, vocabulary: set[str]):
        self.heads = {v for v in vocabulary if not v.startswith("##")}
        self.tails = {v[2:] for v in vocabulary if v.startswith("##")}
        # a literal "##..." can also begin a word
        self.heads |= {v for v in vocabulary if v.startswith("##")}
        self.most = max((len(v) for v in vocabulary), default=0)
        self.memo: dict[str, int] = {}

    def of_word(self, word: str) -> list[str] | None:
        """Pieces of a word; None where there are none."""
        if len(word) > LONGEST:
            return None
        out, at = [], 0
        while at < len(word):
            known = self.tails if at else self.heads
            end = next((e for e in range(min(len(word), at + self.most), at, -1) if word[at:e] in known), None)
            if end is None:
                return None
            out.append(word[at:end])
            at = end
        return out

    def count(self, text: str) -> int:
        total = 0
        for stretch in _SPACES.split(text):
            n = self.memo.get(stretch)
            if n is None:
                n = sum(len(p) if (p := self.of_word(w)) is not None else 1 for w in words_of(stretch))
                if len(self.memo) < REMEMBERED:
                    self.memo[stretch] = n
            total += n
        return total


def piece_vocabulary(df: DataFrame, text_col: str, size: int = 8000, reach: int = 6) -> set[str]:
    """Every character of the corpus, alone and as a continuation, and its ``size`` most frequent beginnings, ends and whole
    words (ties in code-point order)."""
    ship_package(df.sparkSession)
    stretches = F.split(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"[{SPACE}]+", " "), " ")
    counted = df.select(F.explode(stretches).alias("s")).where(F.col("s") != "").groupBy("s").agg(F.count(F.lit(1)).alias("n"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            pieces, times = [], []
            for s, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in words_of(s):
                    heads = {w[:k] for k in range(1, reach + 1)} | ({w} if len(w) <= LONGEST else set())
                    found = sorted(heads) + sorted({"##" + w[k:] for k in range(max(1, len(w) - reach), len(w))})
                    found += [c for c in w] + ["##" + c for c in w]
                    pieces += found
                    times += [n] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(times, pa.int64())], names=["piece", "n"])

    pieces = counted.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    one = F.length(F.regexp_replace("piece", r"^##(?=.)", "")) == 1
    with scratch(df.sparkSession):
        rows = cut_lineage(pieces.withColumn("one", one))  # written: both parts read it
        single = rows.where("one").select("piece")  # at most twice the characters there are
        frequent = rows.where("NOT one").orderBy(F.desc("n"), "piece").limit(size).select("piece")
        return {r["piece"] for r in single.unionByName(frequent).collect()}


def _counts(df: DataFrame, texts: str, vocabulary: set[str]) -> DataFrame:
    """``df`` with the column ``__n array<int>``: tokens of every string of the array column ``texts``."""
    import pyarrow as pa

    ship_package(df.sparkSession)
    names = [*df.columns, "__n"]
    at = df.columns.index(texts)

    def run(batches):
        pieces = Pieces(vocabulary)
        for batch in batches:
            n = [None if row is None else [pieces.count(t or "") for t in row] for row in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.list_(pa.int32()))], names=names)

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("__n", ArrayType(IntegerType()))]))


def subword_counts(df: DataFrame, text_col: str, vocabulary: set[str], out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of a text; 0 for null."""
    counted = _counts(df.withColumn("__t", F.array(F.col(text_col))), "__t", vocabulary)
    return counted.withColumn(out, F.col("__n")[0]).drop("__t", "__n")


def chunk_subwords(df: DataFrame, text_col: str, vocabulary: set[str], max_length: int = 128, out: str = "chunks") -> DataFrame:
    """B15 with subword counts: a text of over ``max_length - 2`` tokens is packed greedily into chunks of whole sentences, a
    shorter one is one chunk, a blank one none; ``chunks array<struct<chunk, n_tokens>>``."""
    import pyarrow as pa
    from pyspark.sql.types import StructField, StructType

    ship_package(df.sparkSession)
    limit = max_length - 2
    # the whole text first, then its sentences
    every = F.concat(F.array(F.coalesce(F.col(text_col), F.lit(""))), T.split_sentences_runs(F.coalesce(F.col(text_col), F.lit(""))))
    kind = "array<struct<chunk:string,n_tokens:int>>"
    names = [*df.columns, "__c"]

    def run(batches):
        pieces = Pieces(vocabulary)
        for batch in batches:
            ends, chunks, counts = [0], [], []
            for whole, *sentences in batch.column(len(names) - 1).to_pylist():
                for text, n in pack(whole, pieces.count(whole), sentences, pieces, limit):
                    chunks.append(text)
                    counts.append(n)
                ends.append(len(chunks))
            packed = pa.StructArray.from_arrays([pa.array(chunks, pa.string()), pa.array(counts, pa.int32())], names=["chunk", "n_tokens"])
            packed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), packed)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=names)

    schema = StructType([*df.schema.fields, StructField("__c", StructType.fromDDL(f"c {kind}")["c"].dataType)])
    packed = df.withColumn("__t", every).mapInArrow(run, schema)
    blank = F.col(text_col).isNull() | T.is_blank(F.col(text_col))
    return packed.withColumn(out, F.when(blank, F.expr(f"cast(array() as {kind})")).otherwise(F.col("__c"))).drop("__c")


def pack(whole: str, total: int, sentences: list[str], pieces: Pieces, limit: int) -> list[tuple[str, int]]:
    """Chunks of a text and their tokens: the whole one where it fits, else sentences joined while they fit."""
    if total <= limit:
        return [(whole, total)]
    out: list[tuple[str, int]] = []
    held: list[str] = []
    n = 0
    for s in sentences:
        k = pieces.count(s)
        if held and n + k > limit:
            out.append((" ".join(held), n))
            held, n = [], 0
        held.append(s)
        n += k
    return out + ([(" ".join(held), n)] if held else [])
