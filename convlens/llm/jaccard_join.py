"""N-gram Jaccard self-join: a MinHash LSH forest proposes, exact shingle sets decide.

Texts are lower-cased and cut into words (``\\w+``); a document's set holds its
shingles of five words (one shorter shingle if it has fewer words).

1. *Sketch* (a map): every text becomes a hash of its whole shingle set, and
   ``TREES * DEPTH`` minimum hashes.  Documents with equal sets are one class
   of copies; from here on one representative (smallest id) stands for it.
2. *Forest*: a tree's label of a document is its run of ``DEPTH`` minimum
   hashes, and sorted labels are the prefix trie.  ``prefix_depth`` shortens
   the matched prefix from ``DEPTH`` until the chance that a pair at the
   threshold meets in some tree reaches the target recall; the subtrees at
   that depth are the units of work.  Subtrees of one document are dropped
   before sketches move.  Inside a subtree prefixes are shortened step by step
   and documents that an estimate puts within reach of the threshold are
   joined, which ends as soon as the subtree is one group.  A subtree of over
   ``BLOCK`` documents becomes all pairs of its blocks, so nothing is capped.
   What leaves a subtree is one edge per document, never its pairs.
3. *Exact verification*: connected groups of candidates meet with their texts,
   again in pairs of blocks when a group is large, and every pair inside is
   decided on its exact shingle sets by a product of incidence matrices.  Only
   each document's number of links and one edge per document leave a block.

The estimate's cut lies so far below the threshold (over seven standard
deviations) that recall is set by the forest.

Defined results: a null text counts as empty; a text without a word has no
shingles, no links and a class of its own; rows that repeat an id and text
are copies of each other, rows of one id with different texts are documents of
their own; rows with a null id take part like others, and are known by a hash
of their text: a class of null ids only has a null ``class_id``; ids that are
no whole numbers count as null; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.llm.arrow import binary_matrix, prepare, runs, slices
from convlens.llm.components import connected_components
from convlens.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 20, 8
RECALL = 0.999
CUT = 0.55  # estimated similarity below which a candidate is not followed
BLOCK = 2048  # sketches a block
TEXTS = 512  # texts a block


def prefix_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold still meets with the target recall."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _numbers(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, k, dtype=np.uint64)


class Shingler:
    """Texts -> 64-bit hashes of their shingles."""

    def __init__(self, words: int = WORDS):
        import xxhash

        self.n = words
        self.word = re.compile(r"\w+").findall
        self.hash = xxhash.xxh3_64_intdigest
        self.mult = _numbers(words, 11) | np.uint64(1)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct shingles of every text."""
        index: dict[str, int] = {}
        order: list[int] = []
        counts = []
        for t in texts:
            found = self.word(t.lower()) if t else ()
            counts.append(len(found))
            order.extend([index.setdefault(w, len(index)) for w in found])
        table = np.fromiter((self.hash(w) for w in index), np.uint64, len(index))
        flat = table[np.array(order, np.int64)] if order else np.zeros(0, np.uint64)
        out, at = [], 0
        for n in counts:
            h = flat[at : at + n]
            at += n
            if n == 0:
                out.append(h)
                continue
            k = min(self.n, n)
            mixed = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                mixed = (mixed ^ h[j : n - k + 1 + j]) * self.mult[j]
                mixed ^= mixed >> np.uint64(29)
            mixed.sort()
            keep = np.ones(len(mixed), bool)
            keep[1:] = mixed[1:] != mixed[:-1]
            out.append(mixed[keep])
        return out


def set_hash(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch(sets: list[np.ndarray], trees: int, depth: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest bytes of the minimum hashes (texts x trees * depth), and a key of each tree's first ``keep`` ones."""
    full = [i for i, s in enumerate(sets) if len(s)]
    low = np.zeros((len(sets), trees * depth), np.uint8)
    keys = np.zeros((len(sets), trees), np.int64)
    mult, add = _numbers(trees * depth, 23) | np.uint64(1), _numbers(trees * depth, 29)
    mix = _numbers(depth, 31) | np.uint64(1)
    lens = np.array([len(sets[i]) for i in full], np.int64)
    for a, b in slices(lens, 1 << 15):
        rows = full[a:b]
        flat = np.concatenate([sets[i] for i in rows])
        starts = np.cumsum(lens[a:b]) - lens[a:b]
        least = np.empty((len(rows), trees * depth), np.uint32)
        for k in range(trees * depth):
            v = ((flat * mult[k] + add[k]) >> np.uint64(32)).astype(np.uint32)
            least[:, k] = np.minimum.reduceat(v, starts)
        low[rows] = least.astype(np.uint8)
        wide = least.reshape(len(rows), trees, depth).astype(np.uint64)
        key = np.arange(trees, dtype=np.uint64)[None, :] + np.zeros((len(rows), 1), np.uint64)
        for j in range(keep):
            key = (key ^ wide[:, :, j]) * mix[j]
            key ^= key >> np.uint64(31)
        keys[rows] = key.view(np.int64)
    return low, keys


def _id(id_col: str):
    return F.expr(f"try_cast(`{id_col}` AS BIGINT)").alias("i")


def _text_hash(id_col: str, text_col: str):
    """The text's name where there is no id; null beside one."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return F.when(F.expr(f"try_cast(`{id_col}` AS BIGINT)").isNull(), F.md5(text)).alias("th")


def _short_hash(text_col: str):
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("t8")


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, trees: int, depth: int, keep: int) -> DataFrame:
    """``i, th and t8 (hashes of the text), h (hash of the set, null without a shingle), low, keys`` per row; a map without shuffle."""
    import pyarrow as pa

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(np.array([len(t or "") for t in texts]), 4_000_000):
                sets = shingler.sets(texts[a:b])
                low, keys = sketch(sets, trees, depth, keep)
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * trees)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        batch.column(2).slice(a, b - a),
                        batch.column(3).slice(a, b - a),
                        pa.array([set_hash(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([x.tobytes() for x in low], pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                    ],
                    names=["i", "th", "t8", "h", "low", "keys"],
                )

    return docs.select(_id(id_col), F.col(text_col).alias("t"), _text_hash(id_col, text_col), _short_hash(text_col)).mapInArrow(
        run, "i long, th string, t8 long, h binary, low binary, keys array<long>"
    )


def join_subtree(low: np.ndarray, label: np.ndarray, keep: int, cut: float) -> np.ndarray:
    """Row of the group of every row, for rows sorted by label: from the longest prefix to ``keep``, rows of one
    prefix are joined when the share of equal minimum hashes reaches ``cut``."""
    n, root = len(low), np.arange(len(low))
    need = cut * low.shape[1]
    for d in range(label.shape[1], keep - 1, -1):
        new = np.ones(n, bool)
        if d > keep:
            new[1:] = (label[1:, :d] != label[:-1, :d]).any(1)
        else:
            new[1:] = False
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], n], strict=True):
            if b - a > 1 and (root[a:b] != root[a]).any():
                _join(low[a:b], root[a:b], need)
        if (root == root[0]).all():
            break
    return root


def _join(low: np.ndarray, root: np.ndarray, need: float) -> None:
    left = np.ones(len(low), bool)
    while left.any():
        start = int(left.argmax())
        name = root[start]
        todo = list(np.flatnonzero(left & (root == name)))
        left[todo] = False
        while todo:
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            row = todo.pop()
            near = rest[(low[rest] == low[row]).sum(1) >= need]
            if len(near):
                more = np.flatnonzero(left & np.isin(root, np.unique(root[near])))
                root[more] = name
                left[more] = False
                todo.extend(more)


def _blocks(rows: DataFrame, key: str, size: str, most: int) -> DataFrame:
    """Rows of groups of over ``most`` rows go to every pair of blocks of their group that holds their block."""
    parts = F.ceil(F.col(size) / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64("i"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    out = rows.withColumn("parts", parts).withColumn("own", own).withColumn("other", other)
    return out.select(
        F.col(key).alias("key"),
        F.least("own", "other").alias("p"),
        F.greatest("own", "other").alias("q"),
        "own",
        *[c for c in rows.columns if c not in (key, size)],
    )


def candidate_edges(reps: DataFrame, trees: int, depth: int, keep: int, cut: float, block: int) -> DataFrame:
    """``(a, b)``: one edge per document and subtree, to the first document of its group there."""
    import pyarrow as pa

    own = reps.select("i", F.explode("keys").alias("key"))
    sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    met = own.join(sizes, "key").join(reps.select("i", "low"), "i")
    dealt = _blocks(met.select("key", "n", "i", "low"), "key", "n", block)
    near = dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    width = trees * depth

    def run(batches):
        for table, starts in runs(batches, 3):
            ids = table.column("i").to_numpy()
            low = binary_matrix(table.column("low"), width)
            a_out, b_out = [], []
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                if b - a < 2:
                    continue
                x = low[a:b]
                # the tree is the one in whose label all rows agree on the kept prefix
                same = (x.reshape(b - a, trees, depth)[:, :, :keep] == x[:1].reshape(1, trees, depth)[:, :, :keep]).all((0, 2))
                label = x.reshape(b - a, trees, depth)[:, int(same.argmax())]
                order = np.lexsort(label.T[::-1])
                root = join_subtree(x[order], label[order], keep, cut)
                mine = ids[a:b][order]
                away = root != np.arange(b - a)
                a_out.append(mine[away])
                b_out.append(mine[root[away]])
            if a_out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], names=["a", "b"]
                )

    cols = near.select("key", "p", "q", "i", "low")
    return cols.mapInArrow(run, "a long, b long")


def shared_counts(sets: list[np.ndarray], most: int = 1 << 22) -> np.ndarray:
    """Sizes of all pairwise intersections, by a product of 0/1 matrices over the shingles of two or more sets."""
    n = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    common = counts > 1
    column = np.cumsum(common) - 1
    here = common[inverse]
    row, col = row[here], column[inverse[here]]
    out = np.zeros((n, n), np.float64)
    step = max(1, most // max(n, 1))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for a in range(0, int(common.sum()), step):
        x, y = np.searchsorted(col, [a, a + step])
        m = np.zeros((n, min(step, int(common.sum()) - a)), np.float32)
        m[row[x:y], col[x:y] - a] = 1
        out += m @ m.T
    return out


def _verified(rows: DataFrame, words: int, threshold: float) -> DataFrame:
    """Blocks with texts -> ``i, links (weighted by copies), root`` per document and block pair."""
    import pyarrow as pa

    def run(batches):
        shingler = Shingler(words)
        for table, starts in runs(batches, 3):
            ids, own, copies, p, q = (table.column(c).to_numpy() for c in ("i", "own", "copies", "p", "q"))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                h = table.column("h").slice(a, b - a).to_pylist()
                sets = shingler.sets(table.column("t").slice(a, b - a).to_pylist())
                # an id may bear several texts: only the one with the representative's set counts, once
                first: dict[int, int] = {}
                for k in range(b - a):
                    if set_hash(sets[k]) == h[k]:
                        first.setdefault(int(ids[a + k]), k)
                pick = np.array(sorted(first.values()), np.int64)
                if len(pick) < 2:
                    continue
                sets = [sets[k] for k in pick]
                size = np.array([len(s) for s in sets], np.float64)
                shared = shared_counts(sets)
                link = shared >= threshold * (size[:, None] + size[None, :] - shared) - 1e-9
                np.fill_diagonal(link, False)
                if p[a] != q[a]:
                    side = own[a + pick]
                    link &= side[:, None] != side[None, :]
                weight = link.astype(np.float64) @ copies[a + pick]
                mine = ids[a + pick]
                root = _groups(link)
                some = link.any(1)
                out.append((mine[some], weight[some].astype(np.int64), mine[root[some]]))
            if out:
                cols = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["i", "links", "root"])

    cols = rows.select("key", "p", "q", "i", "own", "copies", "h", "t")
    return cols.mapInArrow(run, "i long, links long, root long")


def _groups(link: np.ndarray) -> np.ndarray:
    root = np.arange(len(link))
    left = np.ones(len(link), bool)
    for start in range(len(link)):
        if not left[start]:
            continue
        todo = [start]
        left[start] = False
        while todo:
            near = np.flatnonzero(link[todo.pop()] & left)
            root[near] = start
            left[near] = False
            todo.extend(near)
    return root


def _classes(docs: DataFrame, id_col: str, text_col: str, words, threshold, trees, depth, recall, cut, block, texts) -> tuple[DataFrame, DataFrame]:
    """``i, th, t8, h`` per row, and ``h, class, class_id, n_links, n_copies`` per different shingle set."""
    prepare(docs.sparkSession)
    keep = prefix_depth(threshold, trees, depth, recall)
    rows = cut_lineage(sketches(docs, id_col, text_col, words, trees, depth, keep))
    # a representative goes by a number of its own, k: different texts may bear one id; where no row has an id, by its text
    reps = cut_lineage(
        rows.where(F.col("h").isNotNull())
        .groupBy("h")
        .agg(
            F.min("i").alias("id"),
            F.min("th").alias("th"),
            F.count(F.lit(1)).alias("copies"),
            F.first("low").alias("low"),
            F.first("keys").alias("keys"),
        )
        .withColumn("k", F.monotonically_increasing_id())
    )
    edges = cut_lineage(candidate_edges(reps.select(F.col("k").alias("i"), "low", "keys"), trees, depth, keep, cut, block).distinct())
    groups = connected_components(edges)
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    own = reps.select(F.col("k").alias("i"), "id", "th", "h", "copies")
    members = cut_lineage(groups.withColumnRenamed("id", "i").join(sizes, "root").join(own, "i"))
    text = docs.select(_id(id_col).alias("id"), F.col(text_col).alias("t"), _text_hash(id_col, text_col))
    # the written table of bare ids is small enough for Spark to broadcast up to its threshold in bytes, so that
    # texts without a candidate stay where they are; beyond the threshold the same join shuffles
    named = members.where(F.col("id").isNotNull())
    found = text.drop("th").join(cut_lineage(named.select("id").distinct()), "id", "left_semi")
    nameless = members.where(F.col("id").isNull()).drop("id")
    # a text that null ids repeat is moved once a task
    bare = text.where(F.col("id").isNull()).select("th", "t").join(cut_lineage(nameless.select("th").distinct()), "th", "left_semi")
    shown = ("root", "n", "i", "h", "copies", "t")
    both = named.join(found, "id").select(*shown).unionByName(
        nameless.join(bare.groupBy("th").agg(F.first("t").alias("t")), "th").select(*shown)
    )
    dealt = _blocks(both, "root", "n", texts)
    checked = cut_lineage(
        _verified(dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q"), words, threshold)
    )
    linked = connected_components(checked.select(F.col("i").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "i")
    smallest = linked.join(own, "i").groupBy("root").agg(F.min("id").alias("class_id"))
    classes = linked.join(smallest, "root").select("i", "class_id", F.col("root").alias("class"))
    links = checked.groupBy("i").agg(F.sum("links").alias("links"))
    joined = links.join(classes, "i").withColumnRenamed("i", "k")
    decided = reps.select("h", "id", "k", "copies").join(joined, "k", "left").select(
        "h",
        F.coalesce("class", "k").alias("class"),
        F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.col("copies").alias("n_copies"),
    )
    return rows.select("i", "th", "t8", "h"), decided


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    cut: float = CUT,
    block: int = BLOCK,
    texts: int = TEXTS,
) -> DataFrame:
    """One row per document: ``id, class_id, n_links, n_copies``.

    ``class_id`` is the smallest id of the documents that links connect;
    ``n_links`` counts the other documents with a Jaccard similarity of
    ``threshold`` or more, copies included; ``n_copies`` the documents with
    the same shingle set, itself included.
    """
    rows, decided = _classes(docs, id_col, text_col, words, threshold, trees, depth, recall, cut, block, texts)
    out = rows.select("i", "h").join(decided, "h", "left")
    return out.select(
        F.col("i").alias(id_col),
        F.when(F.col("h").isNull(), F.col("i")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def drop_near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    cut: float = CUT,
    block: int = BLOCK,
    texts: int = TEXTS,
) -> DataFrame:
    """``docs`` with one row of every class, that of the smallest id (null ids last) and, of its texts, the smallest hash;
    columns unchanged.

    Decided by id and text, so that another text under the id of a near copy
    stays.  Texts without a word all stay.
    """
    rows, decided = _classes(docs, id_col, text_col, words, threshold, trees, depth, recall, cut, block, texts)
    counted = rows.where(F.col("h").isNotNull()).groupBy("i", "th", "t8", "h").agg(F.count(F.lit(1)).alias("n"))
    marked = cut_lineage(counted.join(decided.select("h", "class"), "h").select("i", "th", "t8", "n", "class"))
    best = marked.groupBy("class").agg(F.min(F.struct(F.col("i").isNull().alias("no"), "i", "th", "t8")).alias("b"))
    same = F.col("i").eqNullSafe(F.col("b.i")) & F.col("th").eqNullSafe(F.col("b.th")) & (F.col("t8") == F.col("b.t8"))
    placed = marked.join(best, "class")
    key = docs.select("*", _id(id_col).alias("__i"), _text_hash(id_col, text_col).alias("__th"), _short_hash(text_col).alias("__t8"))
    extra = ("__i", "__th", "__t8")

    def meets(pairs: DataFrame):
        return (key["__t8"] == pairs["t8"]) & key["__i"].eqNullSafe(pairs["i"]) & key["__th"].eqNullSafe(pairs["th"])

    # written tables of a few numbers a row: broadcast up to Spark's threshold in bytes
    gone = cut_lineage(placed.where(~same).select("i", "th", "t8"))
    again = cut_lineage(placed.where(same & (F.col("n") > 1)).select("i", "th", "t8"))
    left = key.join(gone, meets(gone), "left_anti")
    if again.isEmpty():
        return left.drop(*extra)
    # rows that repeat id and text: one of them
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = key.join(again, meets(again), "left_semi").groupBy(*extra).agg(F.min_by(row, F.xxhash64(row)).alias("row")).select("row.*")
    return left.join(again, meets(again), "left_anti").drop(*extra).unionByName(one)
