"""Personal data: fixed patterns, and a skip-chain conditional random field that adds what they miss.

*Patterns* find e-mail addresses, IP addresses, card and phone numbers, and drop
matches that fail a check of their digits.

*The field* labels tokens: runs of characters without white space that hold a
digit or an @.  Neighbouring tokens form chains.  Labels are none, email, ip,
and the first or a further token of a card or a phone.  A token's own
potential comes from its shape, its digits and the word before its chain,
a chain's from pairs of labels.  *Skip factors* join tokens of a document that repeat or
resemble each other (the same last seven digits, or the same characters):
all of such a group hang on one more variable, the group's kind, with the
potential ``skip`` for agreeing with it; one variable a group, never its pairs.
Loopy message passing alternates between chains (forward and backward sums)
and groups for ``ROUNDS`` rounds.

It is trained here, with the patterns' matches as labels: chain weights by
maximum likelihood on at most ``SAMPLE`` different chains, half of them with an
entity, taken in the order of a hash; ``skip`` is the logarithm of the odds,
over all documents and ``PRIOR``, that neighbours in a group bear one kind.  Chains that a
dropped match touches are left out of both: what they are is what the field is
to tell.

Spans that the field adds must pass the check of digits of their kind, and
cover no match of a pattern.

Defined results: a null or empty text has no spans; without a match in any
document there is no field and the patterns' spans are all; spans are given in
code points from 0, the end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import pairwise
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlens.llm.arrow import prepare, slices
from convlens.session import cut_lineage, scratch

KINDS = ("email", "ip", "card", "phone")
#: Labels of the field: kind (0 none, then KINDS from 1) and whether it continues the token before.
LABELS = ((0, False), (1, False), (2, False), (3, False), (3, True), (4, False), (4, True))
KIND_OF = np.array([k for k, _ in LABELS])
FIRST = {"email": 1, "ip": 2, "card": 3, "phone": 5}
SAMPLE = 6_000
LONGEST = 32  # tokens of a chain that training takes at once
ROUNDS = 4
STEPS = 80
DECAY = 1e-4
PRIOR = (1000, 1)  # agreeing and other neighbours that the skip potential starts from
FORBIDDEN = -1e4

_EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# behind a digit a match can't begin: the run of digits would have begun it, so long runs are read once
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_SPACE = "\x20\\x09-\\x0D"
# tokens begin where a run of characters does, so that a run without digits is read once
_TOKEN = re.compile(rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """The check of a kind on the text of a span."""
    digits = "".join(_DIGITS.findall(text))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "ip":
        parts = _DIGITS.findall(text)
        return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)
    return bool(_EMAIL_TAIL.search(text))


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern, from each @ to both sides, so that long runs without one cost nothing."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        tail = _EMAIL_TAIL.match(text, at)
        begin = at
        if tail:
            while begin > last and _EMAIL_HEAD.match(text, begin - 1):
                begin -= 1
        if begin < at:
            out.append((begin, tail.end()))
            last = tail.end()
        at = text.find("@", max(at + 1, last))
    return out


def matches(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Spans of the patterns by kind and start, and those that the checks dropped."""
    good, bad = [("email", a, b) for a, b in _emails(text)], []
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            if valid(kind, m.group()):
                good.append((kind, m.start(), m.end()))
            elif kind != "card" or m.end() - m.start() >= 13:
                bad.append(m.span())
    return good, bad


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in "\"'<[{,;:":
        a += 1
    while a < b and text[b - 1] in ".,;:!?\"'>]}":
        b -= 1
    if text[b - 1 : b] == ")" and "(" not in text[a:b]:
        b -= 1
    return a, b


def shape(token: str) -> str:
    return _LETTERS.sub("a", _DIGITS.sub(lambda m: f"9{min(len(m.group()), 20)}", token))


@dataclass
class Tokens:
    """Tokens of one text: places, whether each continues the chain of the one before, features and group keys."""

    places: list[tuple[int, int]]
    joined: list[bool]
    features: list[list[int]]
    keys: list[str | None]


def _hash(name: str) -> int:
    return crc32(name.encode("utf-8", "surrogatepass"))


def tokens(text: str) -> Tokens:
    found = [m.span() for m in _TOKEN.finditer(text)]
    places = [_trimmed(text, a, b) for a, b in found]
    joined = [False] * len(found)
    for k in range(1, len(found)):
        joined[k] = text[found[k - 1][1] : found[k][0]].isspace()
    words = [text[a:b] for a, b in places]
    features, keys, before = [], [], []
    for k, w in enumerate(words):
        digits = "".join(_DIGITS.findall(w))
        if not joined[k]:
            before = text[max(0, found[k][0] - 64) : found[k][0]].split()
        names = [
            "all",
            f"shape {shape(w)}",
            f"starts {w[:1] if w[:1] in '+(@' else ''}",
            f"digits {min(len(digits), 20)} {len(digits) == len(w)}",
            f"at {'@' in w} dots {min(w.count('.'), 4)}",
            f"luhn {13 <= len(digits) <= 19 and luhn(digits)}",
            f"octets {valid('ip', w)}",
            # the word before the chain; neighbouring tokens speak through the chain alone
            f"word {before[-1].lower() if before else ''}",
        ]
        features.append([_hash(x) for x in names])
        keys.append(digits[-7:] if len(digits) >= 7 and "@" not in w else w.lower() if len(w) >= 4 else None)
    return Tokens(places, joined, features, keys)


WIDTH = 8  # features of a token


def _chains(joined: list[bool]) -> list[tuple[int, int]]:
    starts = [k for k, j in enumerate(joined) if not j]
    return list(zip(starts, [*starts[1:], len(joined)], strict=True))


def _groups(keys: list[str | None]) -> list[list[int]]:
    by: dict[str, list[int]] = {}
    for k, key in enumerate(keys):
        if key is not None:
            by.setdefault(key, []).append(k)
    return [g for g in by.values() if len(g) > 1]


def silver(text: str, t: Tokens) -> tuple[list[int], list[bool]]:
    """Labels of the tokens by the patterns, and which of them a dropped match touches."""
    good, bad = matches(text)
    labels, open_ = [0] * len(t.places), [False] * len(t.places)
    begins = np.array([a for a, _ in t.places], np.int64)
    ends = np.array([b for _, b in t.places], np.int64)

    def touched(a, b):
        return range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(begins, b, "left")))

    for kind, a, b in good:
        first = FIRST[kind]
        for n, k in enumerate(touched(a, b)):
            if labels[k] == 0:
                labels[k] = first if n == 0 or first < 3 else first + 1
    for a, b in bad:
        for k in touched(a, b):
            open_[k] = True
    return labels, open_


def _learnable(docs: DataFrame, text_col: str) -> DataFrame:
    """``h, entity, features array<long>, labels array<int>`` per chain of known labels; with a null ``entity`` the counts
    of agreeing and of all neighbours in groups, one row a task."""
    import pyarrow as pa

    def run(batches):
        agree = both = 0
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                if not text or not _ANY.search(text):
                    continue
                t = tokens(text)
                labels, open_ = silver(text, t)
                for a, b in _chains(t.joined):
                    if any(open_[a:b]):
                        continue
                    for c in range(a, b, LONGEST):
                        part = [x for f in t.features[c : min(b, c + LONGEST)] for x in f]
                        marks = labels[c : min(b, c + LONGEST)]
                        out.append((_hash(repr((part, marks))), any(marks), part, marks))
                for group in _groups(t.keys):
                    known = [KIND_OF[labels[k]] for k in group if not open_[k]]
                    for x, y in pairwise(known):
                        if x or y:
                            agree += int(x == y)
                            both += 1
            if out:
                types = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["h", "entity", "features", "labels"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([0]), pa.array([None], pa.bool_()), pa.array([[]], pa.list_(pa.int64())), pa.array([[agree, both]], pa.list_(pa.int32()))],
            names=["h", "entity", "features", "labels"],
        )

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "h long, entity boolean, features array<long>, labels array<int>")


class Chains:
    """Forward and backward sums of many chains at once, the longest first, place by place."""

    def __init__(self, lens: np.ndarray):
        self.start = np.cumsum(lens) - lens
        order = np.argsort(-lens, kind="stable")
        self.lens, self.at = lens[order], self.start[order]
        steps = int(self.lens[0]) if len(lens) else 0
        self.alive = np.searchsorted(-self.lens, -np.arange(steps), "left")

    def marginals(self, score: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logarithms of the sums up to and from every place, and of every chain's total (of its first place's row)."""
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        for t, n in enumerate(self.alive):
            here = self.at[:n] + t
            if t == 0:
                ahead[here] = score[here] + begin
            else:
                ahead[here] = score[here] + _logsum(ahead[here - 1][:, :, None] + move[None], 1)
        for t in range(len(self.alive) - 1, 0, -1):
            here = self.at[: self.alive[t]] + t
            behind[here - 1] = _logsum(move[None] + (score[here] + behind[here])[:, None, :], 2)
        return ahead, behind, _logsum(ahead + behind, 1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _allowed() -> tuple[np.ndarray, np.ndarray]:
    """Pairs of labels that may follow each other, and labels that may begin a chain."""
    n = len(LABELS)
    move, begin = np.zeros((n, n)), np.zeros(n)
    for y, (kind, further) in enumerate(LABELS):
        if further:
            begin[y] = FORBIDDEN
            move[:, y] = [0.0 if k == kind else FORBIDDEN for k, _ in LABELS]
    return move, begin


@dataclass
class Field:
    names: np.ndarray  # hashes of the features, sorted
    weights: np.ndarray  # feature x label, the last row zero
    move: np.ndarray
    begin: np.ndarray
    skip: float

    def own(self, features: np.ndarray) -> np.ndarray:
        """Potentials of tokens from their features (tokens x WIDTH); unknown features count nothing."""
        at = np.searchsorted(self.names, features)
        at[at == len(self.names)] = 0
        at = np.where(self.names[at] == features, at, len(self.names))
        return self.weights[at].sum(axis=1)

    def beliefs(self, features: np.ndarray, lens: np.ndarray, groups: list[list[int]]) -> np.ndarray:
        """Marginals of the tokens' labels after loopy message passing."""
        own, chains = self.own(features), Chains(lens)
        member = np.array([k for g in groups for k in g], np.int64)
        group = np.repeat(np.arange(len(groups)), [len(g) for g in groups]).astype(np.int64)
        kinds = len(KINDS) + 1
        agree = np.where(np.arange(kinds)[:, None] == KIND_OF[None], self.skip, 0.0)  # kind of the group x label
        told = np.zeros((len(member), len(LABELS)))  # messages from groups to tokens
        for k in range(ROUNDS if len(member) else 1):
            score = own.copy()
            score[member] += told  # a token has one group at most
            ahead, behind, total = chains.marginals(score, self.move, self.begin)
            belief = ahead + behind - total[:, None]
            if k + 1 == ROUNDS or not len(member):
                break
            said = _logsum((belief[member] - told)[:, None, :] + agree[None], 2)  # to the group, without what it told
            said -= said.max(axis=1, keepdims=True)
            sums = np.zeros((len(groups), kinds))
            np.add.at(sums, group, said)
            told = _logsum((sums[group] - said)[:, :, None] + agree[None], 1)
            told -= told.max(axis=1, keepdims=True)
        return np.exp(belief)


def train(chains: list[tuple[list[int], list[int]]], skip: float) -> Field:
    """Chain weights by maximum likelihood (gradients from forward and backward sums, steps scaled by their history)."""
    lens = np.array([len(y) for _, y in chains], np.int64)
    features = np.array([x for f, _ in chains for x in f], np.int64).reshape(-1, WIDTH)
    labels = np.array([y for _, marks in chains for y in marks], np.int64)
    names, flat = np.unique(features, return_inverse=True)
    flat = flat.ravel()
    order = np.argsort(flat, kind="stable")
    cuts = np.searchsorted(flat[order], np.arange(len(names)))
    token = np.repeat(np.arange(len(features)), WIDTH)[order]
    n = len(LABELS)
    move, begin = _allowed()
    forbidden = move < 0
    field = Field(names, np.zeros((len(names) + 1, n)), move, begin, skip)
    steps = Chains(lens)
    second = np.ones(len(features), bool)
    second[steps.start] = False
    second = np.flatnonzero(second)
    seen_w = np.full((len(names), n), 1e-8)
    seen_m = np.full((n, n), 1e-8)
    truth = np.eye(n)[labels]
    for _ in range(STEPS):
        score = field.own(features)
        ahead, behind, total = steps.marginals(score, field.move, field.begin)
        rest = truth - np.exp(ahead + behind - total[:, None])
        up = np.add.reduceat(rest[token], cuts, axis=0) - DECAY * len(chains) * field.weights[:-1]
        pair = ahead[second - 1][:, :, None] + field.move[None] + (score[second] + behind[second])[:, None, :]
        pair = np.exp(pair - total[second][:, None, None]).sum(axis=0)
        seen = np.zeros((n, n))
        np.add.at(seen, (labels[second - 1], labels[second]), 1)
        turn = seen - pair - DECAY * len(chains) * np.where(forbidden, 0, field.move)
        seen_w += up * up
        seen_m += turn * turn
        field.weights[:-1] += 0.5 * up / np.sqrt(seen_w)
        field.move += np.where(forbidden, 0, 0.5 * turn / np.sqrt(seen_m))
    return field


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Field | None:
    """The field learned from the patterns' matches in ``docs``; None without any."""
    prepare(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _fit(docs, text_col, sample)


def _fit(docs: DataFrame, text_col: str, sample: int) -> Field | None:
    rows = cut_lineage(_learnable(docs, text_col))
    counts = rows.where(F.col("entity").isNull()).agg(F.sum(F.col("labels")[0]).alias("agree"), F.sum(F.col("labels")[1]).alias("both")).first()
    # a chain counts once however often it is copied, so that no hot document fills the sample
    once = rows.where(F.col("entity").isNotNull()).dropDuplicates(["h", "features", "labels"])
    part = lambda with_entity: once.where(F.col("entity") == with_entity).orderBy("h", "labels", "features").limit(sample // 2)
    chains = [(list(r["features"]), list(r["labels"])) for r in part(True).collect()]
    if not chains:
        return None
    chains += [(list(r["features"]), list(r["labels"])) for r in part(False).collect()]
    agree, both = counts["agree"] or 0, counts["both"] or 0
    return train(chains, max(0.0, float(np.log((agree + PRIOR[0]) / (both - agree + PRIOR[1])))))


def added(text: str, t: Tokens, belief: np.ndarray, good: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the field's labels that pass their check and meet no match of a pattern.

    Labels that make a span which fails its check are read up to the last token at which it passes; the token behind
    takes its best label among those that begin something new.  A token holds a digit or an @, so no check passes over
    more than 20 tokens.
    """
    fresh = [y for y, (_, further) in enumerate(LABELS) if not further]
    best, out = belief.argmax(axis=1), []
    k = 0
    while k < len(best):
        kind, further = LABELS[best[k]]
        if further:  # what it continues was cut before it
            kind, _ = LABELS[fresh[int(belief[k, fresh].argmax())]]
        end = k + 1
        while kind and end < min(len(best), k + 20) and t.joined[end] and LABELS[best[end]] == (kind, True):
            end += 1
        if kind:
            a = t.places[k][0]
            stop = next((x for x in range(end, k, -1) if valid(KINDS[kind - 1], text[a : t.places[x - 1][1]])), None)
            if stop:
                out.append((KINDS[kind - 1], a, t.places[stop - 1][1]))
                end = stop
            else:
                end = k + 1
        k = end
    taken = sorted((a, b) for _, a, b in good)
    begins = np.array([a for a, _ in taken], np.int64)
    reach = np.maximum.accumulate(np.array([0, *[b for _, b in taken]], np.int64))
    return [s for s in out if reach[np.searchsorted(begins, s[2], "left")] <= s[1]]


def find(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, base, spans``, both ``array<struct<kind, begin, end>>`` by kind and begin; ``spans``
    holds the patterns' matches and what the field adds."""
    import pyarrow as pa

    prepare(docs.sparkSession)
    kind_type = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            every = batch.column(1).to_pylist()
            for a, b in slices(np.array([len(x or "") for x in every]), 8_000_000):
                base: list[list] = []
                spans: list[list] = []
                cut, groups, lens, features, owners = [], [], [], [], []
                at = 0
                for k, text in enumerate(every[a:b]):
                    good = matches(text)[0] if text and _ANY.search(text) else []
                    base.append(good)
                    spans.append(list(good))
                    if field is None or not text or not _ANY.search(text):
                        continue
                    t = tokens(text)
                    owners.append((k, text, t))
                    cut.append((at, at + len(t.places)))
                    groups += [[at + x for x in g] for g in _groups(t.keys)]
                    lens += [y - x for x, y in _chains(t.joined)]
                    features += t.features
                    at += len(t.places)
                if at:
                    belief = field.beliefs(np.array(features, np.int64), np.array(lens, np.int64), groups)
                    for (k, text, t), (x, y) in zip(owners, cut, strict=True):
                        spans[k] += added(text, t, belief[x:y], base[k])
                rank = {kind: n for n, kind in enumerate(KINDS)}
                sorted_ = lambda rows: [sorted(r, key=lambda s: (rank[s[0]], s[1], s[2])) for r in rows]  # noqa: B023, E731
                as_rows = lambda rows: pa.array([[{"kind": x, "begin": y, "end": z} for x, y, z in r] for r in sorted_(rows)], span)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), as_rows(base), as_rows(spans)], names=["i", "base", "spans"])

    s = "array<struct<kind:string,begin:long,end:long>>"
    found = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"i {kind_type}, base {s}, spans {s}")
    return found.withColumnRenamed("i", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the patterns' spans, and all spans as text."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
