"""Token ids as patched frame-of-reference blocks in shard files.

A shard holds whole documents.  Its ids are cut into blocks of ``BLOCK``: a
block stores its minimum, and every id less the minimum in as many bits as a
chosen share of the block's ids needs (``SHARE``); the ids that need more keep
their low bits in place and stand in full in the block's exception list.  An
index gives the start of every block, so a block can be read on its own.

Shard (little-endian)::

    magic "PFR1" | documents u32 | blocks u32 | ids u64
    document ids i64 each | null flags u8 each | ids per document u64 each
    block starts u64 each, and the end
    block: minimum u32 | width u8 | exceptions u16
           packed BLOCK x width bits | places u8 each | full differences u32 each

Documents are sorted by id over all shards by a range partitioning; every
partition writes its shards in order, one row (partition, number, ids before
it in the partition, image) per shard, through Spark's own writer and commit
protocol, so a lost executor leaves no torn file.  Where a document's ids
start in the whole follows from the partitions' totals when shards are read:
one number per partition, never one per document.

Defined results: a null text is empty and has the end id only; null ids come
first; rows that repeat an id are documents of their own, in the order of
their text; an empty table has no shards and gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import os
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convlens.llm.arrow import gather, prepare, slices, sums
from convlens.session import cut_lineage

BLOCK = 256
SHARE = 0.9
SHARD = 1 << 18  # ids from which a shard is closed
CACHE = 300_000
HEAD = struct.Struct("<4sIIQ")


#: Bits of every number below 2 ** 16.
BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)

# -- blocks ---------------------------------------------------------------


def pack(ids: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of the ids as bytes, and the start of every block with the end."""
    n = -(-len(ids) // BLOCK)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.uint64)
    full = np.empty(n * BLOCK, np.uint64)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1]
    full = full.reshape(n, BLOCK)
    least = full.min(1)
    diff = full - least[:, None]
    if int(diff.max()) < len(BITS):
        bits = BITS[diff]
    else:
        bits = np.frexp(diff.astype(np.float64))[1].astype(np.uint8)
    nth = int(np.ceil(share * BLOCK)) - 1
    # the count of ids that some width holds grows with the width: the first width that holds the share
    held = np.stack([(bits <= w).sum(1, dtype=np.int64) for w in range(int(bits.max()) + 1)])
    width = (held <= nth).sum(0)
    patch = bits > width[:, None].astype(np.uint8)
    extra = patch.sum(1)
    sizes = 7 + 32 * width + 5 * extra
    ends = np.cumsum(sizes)
    at = ends - sizes
    out = np.zeros(int(ends[-1]), np.uint8)
    head = np.zeros((n, 7), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(n, 4)
    head[:, 4] = width
    head[:, 5:] = extra.astype("<u2").view(np.uint8).reshape(n, 2)
    out[at[:, None] + np.arange(7)] = head
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            body = _pack_bits(diff[rows], int(w))
            out[(at[rows] + 7)[:, None] + np.arange(32 * w)] = body
    row, col = np.nonzero(patch)
    if len(row):
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        lists = at[row] + 7 + 32 * width[row]
        out[lists + rank] = col.astype(np.uint8)
        values = diff[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(lists + extra[row] + 4 * rank)[:, None] + np.arange(4)] = values
    return out, np.concatenate([at, ends[-1:]]).astype(np.uint64)


def _pack_bits(diff: np.ndarray, w: int) -> np.ndarray:
    """Low w bits of every number: rows x 32 * w bytes."""
    low = np.ascontiguousarray((diff & np.uint64((1 << w) - 1)).T)
    words = np.zeros((4 * w, diff.shape[0]), np.uint64)
    for i in range(BLOCK):
        k, shift = divmod(i * w, 64)
        words[k] |= low[i] << np.uint64(shift)
        if shift + w > 64:
            words[k + 1] |= low[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8)


def unpack(data: np.ndarray, starts: np.ndarray, n_ids: int) -> np.ndarray:
    n = len(starts) - 1
    out = np.empty((n, BLOCK), np.uint64)
    at = starts[:-1].astype(np.int64)
    if not n:
        return np.zeros(0, np.uint32)
    head = data[at[:, None] + np.arange(7)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4").ravel().astype(np.uint64)
    width = head[:, 4].astype(np.int64)
    extra = np.ascontiguousarray(head[:, 5:]).view("<u2").ravel().astype(np.int64)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if not w:
            out[rows] = 0
            continue
        body = np.ascontiguousarray(data[(at[rows] + 7)[:, None] + np.arange(32 * w)])
        words = np.ascontiguousarray(body.view("<u8").T)
        mask, part = np.uint64((1 << int(w)) - 1), np.empty((BLOCK, len(rows)), np.uint64)
        for i in range(BLOCK):
            k, shift = divmod(i * int(w), 64)
            x = words[k] >> np.uint64(shift)
            if shift + w > 64:
                x = x | (words[k + 1] << np.uint64(64 - shift))
            part[i] = x & mask
        out[rows] = part.T
    row = np.repeat(np.arange(n), extra)
    if len(row):
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        lists = at[row] + 7 + 32 * width[row]
        place = data[lists + rank]
        values = np.ascontiguousarray(data[(lists + extra[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
        out[row, place] = values
    return (out + least[:, None]).ravel()[:n_ids].astype(np.uint32)


# -- shards ---------------------------------------------------------------


def write_shard(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    data, starts = pack(ids)
    names = np.array([0 if x is None else x for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], np.uint8)
    head = HEAD.pack(b"PFR1", len(doc_ids), len(starts) - 1, len(ids))
    return b"".join([head, names.tobytes(), null.tobytes(), counts.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), data.tobytes()])


def read_shard(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    magic, docs, blocks, n = HEAD.unpack_from(image)
    if magic != b"PFR1":
        raise ValueError("not a token shard")
    at = HEAD.size
    names = np.frombuffer(image, "<i8", docs, at)
    at += 8 * docs
    null = np.frombuffer(image, np.uint8, docs, at)
    at += docs
    counts = np.frombuffer(image, "<u8", docs, at).astype(np.int64)
    at += 8 * docs
    starts = np.frombuffer(image, "<u8", blocks + 1, at)
    at += 8 * (blocks + 1)
    ids = unpack(np.frombuffer(image, np.uint8, offset=at), starts, n)
    return [None if z else int(x) for x, z in zip(names, null, strict=True)], counts, ids


# -- texts ----------------------------------------------------------------


#: Words of these letters, with or without punctuation behind, encode like their lower-cased letters and the
#: punctuation one after the other.
PLAIN = r"^(?P<a>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<b>[.,;:!?]*)$"


class WordEncoder:
    """Ids of texts by a tokenizer of the tokenizers library that lower-cases and whose matches never hold white space.

    Texts are cut at ASCII white space in Arrow, and plain words into letters
    and punctuation; the tokenizer encodes each different piece of a batch
    once, and a bounded table keeps pieces seen earlier in this Python worker.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.place: dict[str, int] = {}
        self.lens = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces: ``flat``, and where each piece begins in it and how many it has."""
        at = np.fromiter((self.place.get(p, -1) for p in pieces), np.int64, len(pieces))
        new = np.flatnonzero(at < 0)
        found: list[list[int]] = []
        for k in range(0, len(new), 20_000):
            part = [pieces[i] for i in new[k : k + 20_000]]
            found.extend([e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)])
        at[new] = len(self.lens) + np.arange(len(new))
        lens = np.concatenate([self.lens, np.fromiter(map(len, found), np.int64, len(found))])
        flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), np.uint32)])
        begin = np.cumsum(lens) - lens
        room = min(len(new), CACHE - len(self.place))
        if room > 0:
            base = len(self.lens)
            self.place.update({pieces[i]: base + k for k, i in enumerate(new[:room])})
            self.lens = lens[: base + room]
            self.flat = flat[: int(self.lens.sum())]
        return flat, begin[at], lens[at]

    def encode(self, texts, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of texts one after the other, each text closed by ``end``; ids per text."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        per = pc.list_value_length(split).to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        parts = pc.extract_regex(words, PLAIN)
        plain = parts.is_valid()
        first = pc.if_else(plain, pc.utf8_lower(pc.struct_field(parts, "a")), words)
        second = pc.if_else(plain, pc.struct_field(parts, "b"), "")
        pieces = pa.concat_arrays([first, second.cast(first.type)]).dictionary_encode()
        flat, begin, lens = self._pieces(pieces.dictionary.to_pylist())
        # ids of every different word (its two pieces), and of the end as the last of them
        both = pieces.indices.to_numpy().reshape(2, len(words)).T.ravel()
        flat, _ = gather(flat, begin, lens, both)
        n_word = lens[both].reshape(-1, 2).sum(1)
        flat, n_word = np.concatenate([flat, np.array([end], np.uint32)]), np.concatenate([n_word, [1]])
        # the words of every text, then its end
        order = np.full(int(per.sum()) + len(per), len(words), np.int32)
        keep = np.ones(len(order), bool)
        keep[np.cumsum(per + 1) - 1] = False
        order[keep] = coded.indices.to_numpy()
        out, n = gather(flat, np.cumsum(n_word) - n_word, n_word, order)
        return out, sums(n, per + 1)


@functools.lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_shards(docs: DataFrame, path: str, end: int, id_col="doc_id", text_col="text", shard: int = SHARD) -> DataFrame:
    """The table of shards, in the shared folder: ``part, number, before, n_ids, image``."""
    import pyarrow as pa

    prepare(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        encoder, part = word_encoder(path), TaskContext.get().partitionId()
        number, before = 0, 0
        names: list[int | None] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close():
            nonlocal number, before, names, held
            counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            row = [part, number, before, len(ids), write_shard(names, counts, ids)]
            number, before, names, held = number + 1, before + len(ids), [], []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=["part", "number", "before", "n_ids", "image"]
            )

        for batch in batches:
            texts = batch.column(1)
            lengths = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in texts], np.int64)
            for a, b in slices(lengths, 8 << 20):
                ids, counts = encoder.encode(texts.slice(a, b - a), end)
                own, ends = batch.column(0).slice(a, b - a).to_pylist(), np.cumsum(counts)
                for x, y in slices(counts, shard):
                    names.extend(own[x:y])
                    held.append((counts[x:y], ids[ends[x] - counts[x] : ends[y - 1]]))
                    if sum(len(z) for _, z in held) >= shard:
                        yield close()
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    ordered = rows.repartitionByRange(F.col("i").asc_nulls_first()).sortWithinPartitions(F.col("i").asc_nulls_first(), "t")
    return cut_lineage(ordered.mapInArrow(run, "part int, number int, before long, n_ids long, image binary"))


def read_shards(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the shards alone: ``id, start, n_tokens, ids_crc32``."""
    import pyarrow as pa

    totals = shards.groupBy(F.col("part").alias("p")).agg(F.sum("n_ids").alias("n"))
    base = cut_lineage(totals.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("base")))
    placed = shards.join(base, F.col("part") == F.col("p")).select((F.col("base") + F.col("before")).alias("at"), "image")

    def run(batches):
        for batch in batches:
            for at, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, counts, ids = read_shard(image.as_py())
                ends = np.cumsum(counts)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(ends - counts + at), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["i", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(run, "i long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("i", id_col)
