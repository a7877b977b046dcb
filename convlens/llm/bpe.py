"""Byte-level BPE encoding and decoding on padded numpy matrices.

A text is cut by the split pattern; every piece is encoded on its own.  Only
the different pieces of a batch are encoded, and a bounded table of pieces
seen earlier is kept per Python worker.

``encode_pieces`` puts pieces into matrices by length (2, 4, 8, ... bytes),
padded at the right.  Each round every row merges its leftmost pair of
minimum rank, shifts the rest of the row left and renews the two ranks beside
the merge; rows without a mergeable pair leave the matrix.  Ranks come from an
open-addressing hash table over pairs of ids.  A row of over ``LONG`` bytes
has a matrix of its own, in which one round merges all places of the minimum
rank up to the first merge that makes a smaller rank: the same merges in the
same order, with as many rounds as different ranks instead of as many as
bytes.

Defined results: a null or empty text has no ids; ids decode to the text's
UTF-8 bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np

from convlens.llm.arrow import gather, prepare, slices, sums

NONE = np.int32(2**31 - 1)
LONG = 256
CACHE = 100_000  # pieces kept per Python worker


class PairTable:
    """(left id, right id) -> id of the merged token, by linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2 + 1))))
        self.shift = np.uint64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        at, todo = self._home(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            slots, first = np.unique(at[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[slots], self.values[slots] = keys[placed], values[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            at[todo] = np.where(self.keys[at[todo]] == -1, at[todo], (at[todo] + 1) & self.mask)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = self._home(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class Bpe:
    """Encoder and decoder for a table of ranks (token bytes -> id, merged in the order of the ids)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        self.pairs = PairTable(np.array(keys, np.int64), np.array(values, np.int32))
        self.whole = ranks
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_len = np.array([len(t) for t in tokens], np.int64)
        self.token_at = np.concatenate([[0], np.cumsum(self.token_len)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.seen: dict[str, np.ndarray] = {}

    # -- pieces ----------------------------------------------------------

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.whole.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > LONG:
                out[i] = self._long(p)
            else:
                by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
        for width, rows in by_width.items():
            step = max(1, (1 << 20) // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out  # type: ignore[return-value]

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        n = len(pieces)
        lens = np.array([len(p) for p in pieces], np.int64)
        inside = np.arange(width) < lens[:, None]
        ids = np.full((n, width), -1, np.int32)
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full((n, width), NONE, np.int32)  # ranks[:, j]: of the pair j, j + 1
        pair = inside[:, 1:]
        ranks[:, :-1][pair] = self.pairs.get(ids[:, :-1][pair], ids[:, 1:][pair])
        done: list[np.ndarray | None] = [None] * n
        row = np.arange(n)
        cols = np.arange(width)
        while len(row):
            at = ranks.argmin(1)  # the leftmost minimum
            best = ranks[np.arange(len(row)), at]
            end = best == NONE
            if end.any():
                for r, x, m in zip(row[end], ids[end], lens[end], strict=True):
                    done[r] = x[:m]
                live = ~end
                ids, ranks, lens, row, at, best = ids[live], ranks[live], lens[live], row[live], at[live], best[live]
                if not len(row):
                    break
                used = int(lens.max())
                if used < ids.shape[1]:
                    ids, ranks = ids[:, :used], ranks[:, :used]
                    cols = cols[:used]
            k = np.arange(len(row))
            shift = np.minimum(cols + (cols > at[:, None]), len(cols) - 1)  # compaction
            ids = np.take_along_axis(ids, shift, 1)
            ranks = np.take_along_axis(ranks, shift, 1)
            ids[k, at] = best
            lens = lens - 1
            right = at + 1 < lens
            ranks[k, at] = NONE
            ranks[k[right], at[right]] = self.pairs.get(best[right], ids[k[right], at[right] + 1])
            left = at > 0
            ranks[k[left], at[left] - 1] = self.pairs.get(ids[k[left], at[left] - 1], best[left])
            ranks[k, lens - 1] = NONE
            if len(cols) > 1:
                ranks[:, -1] = NONE
        return done  # type: ignore[return-value]

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.get(ids[:-1], ids[1:])
        while len(ranks):
            best = ranks.min()
            if best == NONE:
                break
            at = np.flatnonzero(ranks == best)
            if len(at) > 1:  # of overlapping places the left one, run by run
                run = np.cumsum(np.concatenate([[True], np.diff(at) > 1]))
                first = np.concatenate([[0], np.flatnonzero(np.diff(run)) + 1])
                at = at[(np.arange(len(at)) - first[run - 1]) % 2 == 0]
            while True:
                drop = np.zeros(len(ids), bool)
                drop[at + 1] = True
                new = ids.copy()
                new[at] = best
                new = new[~drop]
                fresh = self.pairs.get(new[:-1], new[1:])
                if len(at) == 1:
                    break
                where = at - np.arange(len(at))  # the merged ids in `new`
                low = np.zeros(len(at), bool)
                inner = where < len(fresh)
                low[inner] |= fresh[where[inner]] < best
                inner = where > 0
                low[inner] |= fresh[where[inner] - 1] < best
                if not low[:-1].any():
                    break
                at = at[: int(low.argmax()) + 1]
            ids, ranks = new, fresh
        return ids

    # -- texts -----------------------------------------------------------

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and the number of ids of each text."""
        index: dict[str, int] = {}
        order: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            found = self.split(text) if text else ()
            counts[k] = len(found)
            order.extend([index.setdefault(p, len(index)) for p in found])
        pieces = list(index)
        known = [self.seen.get(p) for p in pieces]
        new = [i for i, x in enumerate(known) if x is None]
        for i, ids in zip(new, self.encode_pieces([pieces[i].encode() for i in new]), strict=True):
            known[i] = ids
            if len(self.seen) < CACHE and len(pieces[i]) <= 64:
                self.seen[pieces[i]] = ids.copy()
        if not pieces:
            return np.zeros(0, np.int32), counts
        lens = np.array([len(x) for x in known], np.int64)
        flat, per = gather(np.concatenate(known), np.cumsum(lens) - lens, lens, np.array(order, np.int64))
        return flat, sums(per, counts)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.token_bytes, self.token_at, self.token_len, ids)[0].tobytes()


@functools.lru_cache(maxsize=2)
def load_tiktoken(path: str, pattern: str) -> Bpe:
    """The encoder of a rank file, once per Python process; opened where the task runs."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Bpe(ranks, pattern)


def encode(docs, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False):
    """One row per document: ``id, n_tokens, ids_sha256, decoded_sha256`` (of the ids as little-endian 32 bits and of
    the bytes they decode to), and with ``ids`` the ids themselves as ``array<int>``.  A map without shuffle."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    prepare(docs.sparkSession)

    def run(batches):
        bpe = load_tiktoken(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(np.array([len(t or "") for t in texts]), 3_000_000):
                flat, counts = bpe.encode_batch(texts[a:b])
                ends = np.cumsum(counts)
                one = [flat[e - n : e] for e, n in zip(ends, counts, strict=True)]
                cols = [
                    batch.column(0).slice(a, b - a),
                    pa.array(counts, pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in one], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in one], pa.string()),
                ]
                names = ["i", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    cols.append(pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if ids else "")
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema).withColumnRenamed("i", id_col)
