"""Character-sequence dataset preparation (inventory L).

The reference joins all texts into one string and slides a window over it.
Here no global string is built: each text learns its offset in the joined
corpus (a distributed prefix sum), the vocabulary is a small distinct set,
encoding translates characters through a hash table, and windows are generated
per text with ``sequence`` + ``slice`` (lazy, no buffering).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlens.operators.sequence import running_sum


def chars(c):
    """Characters of a string as ARRAY<STRING>."""
    return F.split(c, "", -1)


def char_offsets(df: DataFrame, id_col: str, text_col: str, sep: str = " ") -> DataFrame:
    """L1: ``(id, offset, length)``, the position of each text in the
    ``sep``-joined corpus ordered by ``id`` (of any type)."""
    d = df.select(F.col(id_col).alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("length"))
    d = d.withColumn("__w", F.col("length") + F.lit(len(sep)))
    return running_sum(d, ["id"], "__w", "offset").select("id", "offset", "length")


def joined_texts(df: DataFrame, id_col: str, text_col: str, sep: str = " ") -> DataFrame:
    """L1: the ``sep``-joined corpus as a table ``(id, offset, text)`` in its order.

    The corpus is never one string: writing the texts in the order of their
    offsets with ``sep`` between them gives it.
    """
    d = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("__w", (F.length("text") + F.lit(len(sep))).cast("bigint"))
    return running_sum(d, ["id"], "__w", "offset").select("id", "offset", "text")


def char_vocabulary(df: DataFrame, text_col: str, extra: str = "") -> DataFrame:
    """L2: distinct characters sorted by code point, numbered from 0.

    The distinct set is bounded by the alphabet, so the final numbering is a
    window over a small table.
    """
    # distinct inside each row first: a row contributes at most its alphabet
    ch = df.select(F.explode(F.array_distinct(chars(F.col(text_col)))).alias("ch")).where(F.col("ch") != "")
    if extra:
        ch = ch.unionByName(df.sparkSession.createDataFrame([(c,) for c in extra], "ch string"))
    distinct = ch.distinct()
    return distinct.withColumn("idx", (F.row_number().over(Window.orderBy("ch")) - 1).cast("int"))


#: Code point that stands for id 0 while encoding: the private planes 15 and 16 hold 131,068 ids.
_FIRST = 0xF0000
_PRIVATE = "[\U000f0000-\U0010ffff]"


def _alphabet(vocab: DataFrame) -> list[str]:
    """Characters by id, "" for an id that is not given; a vocabulary is bounded by the alphabet."""
    rows = vocab.select("ch", "idx").collect()
    out = [""] * (max((r["idx"] for r in rows), default=-1) + 1)
    for r in rows:
        out[r["idx"]] = r["ch"]
    return out


def encode(df: DataFrame, text_col: str, vocab: DataFrame, out: str = "ids") -> DataFrame:
    """L3: characters -> ids; unknown characters map to null."""
    known = [(k, c) for k, c in enumerate(_alphabet(vocab)) if c]
    text = F.col(text_col)
    # one hash lookup a character; what is not in the vocabulary stays as it is, below the private planes
    marked = F.translate(text, "".join(c for _, c in known), "".join(chr(_FIRST + k) for k, _ in known))
    number = lambda c: F.ascii(c) - F.lit(_FIRST)
    fast = F.transform(F.filter(chars(marked), lambda c: c != ""), lambda c: F.when(number(c) >= 0, number(c)))
    # a text with characters of the private planes themselves: looked up one by one
    table = F.create_map(*[F.lit(x) for k, c in known for x in (c, k)]) if known else F.create_map().cast("map<string,int>")
    slow = F.transform(F.filter(chars(text), lambda c: c != ""), lambda c: F.element_at(table, c))
    return df.withColumn(out, F.when(text.rlike(_PRIVATE), slow).otherwise(fast))


def decode(df: DataFrame, ids_col: str, vocab: DataFrame, out: str = "text") -> DataFrame:
    """L3 inverse: ids -> string (unknown ids dropped)."""
    table = F.array(*[F.lit(c) for c in _alphabet(vocab)]).cast("array<string>")
    return df.withColumn(out, F.array_join(F.transform(F.col(ids_col), lambda i: F.when(i >= 0, F.get(table, i))), ""))


def windows(df: DataFrame, keys: list[str], ids_col: str, block_size: int, stride: int = 1) -> DataFrame:
    """L4: ``(keys, pos, x, y)``: x = ids[pos : pos+block], y shifted by one.

    Windows start at 0, stride, ... up to n - block - 1; none when n <= block.
    """
    n = F.size(ids_col)
    starts = F.when(n > block_size, F.sequence(F.lit(0), n - block_size - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return df.select(*keys, ids_col, F.explode(starts).alias("pos")).select(
        *keys,
        F.col("pos").cast("bigint").alias("pos"),
        F.slice(F.col(ids_col), F.col("pos") + 1, block_size).alias("x"),
        F.slice(F.col(ids_col), F.col("pos") + 2, block_size).alias("y"),
    )


def corpus_windows(
    df: DataFrame, id_col: str, text_col: str, vocab: DataFrame, block_size: int, stride: int = 1, sep: str = " ", chunk: int = 1 << 16
) -> DataFrame:
    """L4 over the joined corpus (L1), windows across texts included: ``(pos, x, y)``.

    The corpus is cut into chunks of ``chunk`` positions.  Every text sends
    each chunk the characters that lie in it, and each chunk the first
    ``block_size + 1`` characters behind it as well, so a chunk's windows are
    complete and no row holds more than a chunk and a block.
    """
    size = max(chunk, block_size + 1)
    placed = joined_texts(df, id_col, text_col, sep)
    last = placed.agg(F.max(F.col("offset") + F.length("text"))).scalar()  # the corpus ends with its last text
    own = placed.withColumn("total", last).select(
        "offset", "total", F.when(F.col("offset") + F.length("text") < F.col("total"), F.concat("text", F.lit(sep))).otherwise(F.col("text")).alias("t")
    )
    end = F.col("offset") + F.length("t")
    # chunk k needs positions k * size to (k + 1) * size + block_size
    first = F.greatest(F.floor((F.col("offset") - block_size) / size), F.lit(0).cast("long"))
    pieces = own.where(F.length("t") > 0).withColumn("k", F.explode(F.sequence(first, F.floor((end - 1) / size))))
    start = F.greatest(F.col("offset"), F.col("k") * size)
    stop = F.least(end, (F.col("k") + 1) * size + block_size)
    cut = pieces.withColumn("start", start).withColumn("n", (stop - start).cast("int")).where(F.col("n") > 0)
    cut = cut.select("k", "total", "start", F.substr("t", (F.col("start") - F.col("offset") + 1).cast("int"), F.col("n")).alias("piece"))
    whole = cut.groupBy("k", "total").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "").alias("piece")
    )
    ids = encode(whole, "piece", vocab, "ids")
    base = F.col("k") * size
    low = F.ceil(base / stride) * stride
    high = F.least(base + size - 1, F.col("total") - block_size - 1)
    starts = F.when(low <= high, F.sequence(low, high, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    at = (F.col("pos") - base + 1).cast("int")
    return ids.select("k", "ids", F.explode(starts).alias("pos")).select(
        "pos", F.slice("ids", at, block_size).alias("x"), F.slice("ids", at + 1, block_size).alias("y")
    )


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    """L5."""
    vocab.select("ch", "idx").write.mode("overwrite").parquet(path)


def load_vocabulary(spark, path: str) -> DataFrame:
    """L5."""
    return spark.read.parquet(path).select("ch", F.col("idx").cast("int").alias("idx"))


def remove_unknown(df: DataFrame, text_col: str, vocab: DataFrame, out: str = "safe_text") -> DataFrame:
    """Drop characters outside the vocabulary and flag rows that changed."""
    known = F.lit("".join(_alphabet(vocab)))
    unknown = F.call_function("translate", F.col(text_col), known, F.lit(""))
    safe = F.call_function("translate", F.col(text_col), unknown, F.lit(""))
    return df.withColumn(out, safe).withColumn("changed", F.length(out) != F.length(text_col))


def sample_prompt(c, n: int = 20):
    """First ``n`` characters, or half the text when it is not longer than ``n``."""
    t = F.coalesce(c, F.lit(""))
    return F.when(F.length(t) > n, F.substring(t, 1, n)).otherwise(F.substring(t, 1, F.floor(F.length(t) / 2).cast("int")))
