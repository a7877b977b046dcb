"""Pure Column expressions over text.

Every function here maps Columns to a Column: no action, no shuffle, fully
inside whole-stage codegen (higher-order functions included).  The operators in
``convlens.operators`` compose them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convlens.functions.common import as_col

# Fixed values that must equal the reference for equal results.
INTERVIEWER_LABEL = "Interviewer:"
INTERVIEWEE_LABEL = "Interviewee:"
TURN_DELIMITER = "|"

# Sentence boundary: a terminator followed by whitespace (the terminator stays
# with the sentence before it).
SENTENCE_BOUNDARY = r"([.!?])\s+"
SENTENCE_MARK = "\u0001"

# Word characters that mean the same in Java and RE2 (Unicode letters/digits).
WORD_CHARS = r"[\p{L}\p{N}_]"
NO_WORD_CHARS = r"[^\p{L}\p{N}_]"
TOKEN_PATTERN = WORD_CHARS + "{2,}"


def strip_ws(c) -> Column:
    """Python ``str.strip()`` (ASCII whitespace; Spark ``trim`` only drops spaces)."""
    return F.regexp_replace(as_col(c), r"^\s+|\s+$", "")


def is_blank(c) -> Column:
    return strip_ws(c) == F.lit("")


def words(c) -> Column:
    """Whitespace tokens, like Python ``str.split()``; empty text gives []."""
    return F.filter(F.split(as_col(c), r"\s+"), lambda w: w != F.lit(""))


def word_count(c) -> Column:
    """Number of whitespace tokens; 0 for empty text (``size(split(''))`` is 1)."""
    return F.size(words(c))


def split_turns(c, delimiter: str = TURN_DELIMITER) -> Column:
    """Split a transcript into raw turns; empty parts are kept (Python semantics)."""
    return F.split(as_col(c), _regex_quote(delimiter), -1)


def speaker_of(part, labels=(("interviewer", INTERVIEWER_LABEL), ("interviewee", INTERVIEWEE_LABEL))) -> Column:
    """Speaker name of a raw turn by its label prefix (tested in order, case-sensitive).

    Null for an unlabelled turn.
    """
    stripped = strip_ws(part)
    expr = None
    for name, label in labels:
        cond = stripped.startswith(label)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def strip_label(part, label: str) -> Column:
    """Remove every occurrence of the turn's own label, then strip whitespace."""
    return strip_ws(F.replace(as_col(part), F.lit(label), F.lit("")))


def clean_speaker_labels(c, labels=(INTERVIEWER_LABEL, INTERVIEWEE_LABEL)) -> Column:
    """Drop labels anywhere in the text together with the whitespace after them."""
    out = as_col(c)
    for label in labels:
        out = F.regexp_replace(out, _regex_quote(label) + r"\s*", "")
    return out


def char_length(c) -> Column:
    return F.length(as_col(c))


def length_ratio(num, den) -> Column:
    """num / den as DOUBLE, null when den is 0 or null."""
    return F.try_divide(as_col(num).cast("double"), F.nullif(as_col(den).cast("double"), F.lit(0.0)))


def share(part, total) -> Column:
    """part / total, 0 when total is 0."""
    return F.coalesce(F.try_divide(as_col(part).cast("double"), as_col(total).cast("double")), F.lit(0.0))


# ---------------------------------------------------------------- fillers
# The default filler dictionary, in the reference's order.
# A value of None means "the phrase itself, as a literal between word boundaries".
DEFAULT_FILLERS = [
    ("uh", r"\buh+\b"),
    ("um", r"\bum+\b"),
    ("like", None),
    ("you know", None),
    ("i mean", None),
    ("sort of", None),
    ("kind of", None),
    ("might", None),
    ("maybe", None),
    ("just", None),
    ("really", None),
    ("so", None),
    ("actually", None),
    ("basically", None),
]


def filler_regex(name: str, pattern: str | None) -> str:
    # (?U): word borders are Unicode ones whatever the Java version's default
    return "(?U)" + (pattern if pattern is not None else r"\b" + _regex_quote(name) + r"\b")


def filler_table(fillers=None) -> list[tuple[str, str]]:
    """(name, java regex) pairs of a filler dictionary."""
    return [(n, filler_regex(n, p)) for n, p in (fillers or DEFAULT_FILLERS)]


def regex_count(c, pattern: str) -> Column:
    """Non-overlapping matches of ``pattern`` (like ``len(re.findall)``)."""
    return F.regexp_count(as_col(c), F.lit(pattern))


def filler_hits(c, fillers=None) -> Column:
    """Total hits of a filler dictionary in lower-cased text (within one text)."""
    lowered = F.lower(as_col(c))
    total = F.lit(0)
    for _, rx in filler_table(fillers):
        total = total + regex_count(lowered, rx)
    return total


# ---------------------------------------------------------------- sentences
def sentence_pieces(c) -> Column:
    """Raw pieces between sentence boundaries, empty ones kept (for numbering)."""
    marked = F.regexp_replace(as_col(c), SENTENCE_BOUNDARY, "$1" + SENTENCE_MARK)
    return F.split(marked, SENTENCE_MARK, -1)


def split_sentences(c) -> Column:
    """Sentence split on a terminator followed by whitespace; blank sentences dropped."""
    return F.filter(F.transform(sentence_pieces(c), strip_ws), lambda s: s != F.lit(""))


def split_sentences_runs(c) -> Column:
    """Split on runs of ``[.!?]``, punctuation dropped, blanks dropped."""
    return F.filter(F.transform(F.split(as_col(c), r"[.!?]+", -1), strip_ws), lambda s: s != F.lit(""))


def ends_with_terminator(c) -> Column:
    # \z, not $: Java's $ also matches before a final line break
    return as_col(c).rlike(r"[.!?]\z")


def pack_chunks(sentences, token_counts, max_tokens: int = 126) -> Column:
    """Greedy packing of sentences into chunks of at most ``max_tokens`` tokens.

    A new chunk starts when the running count plus the next sentence would pass
    the limit; an over-long sentence becomes a chunk of its own.  Returns
    ARRAY<STRING> (sentences of a chunk joined by one space).
    """
    items = F.arrays_zip(as_col(sentences).alias("s"), as_col(token_counts).alias("n"))
    state_t = "struct<cur_len:bigint,cur:array<string>,out:array<array<string>>>"
    start = F.expr(
        f"cast(named_struct('cur_len', 0L, 'cur', array(), 'out', array()) as {state_t})"
    )

    def step(acc, x):
        n = x["n"].cast("bigint")
        overflow = (acc["cur_len"] + n) > F.lit(max_tokens)
        flushed = F.when(F.size(acc["cur"]) > 0, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        new_state = F.when(
            overflow,
            F.struct(n.alias("cur_len"), F.array(x["s"]).alias("cur"), flushed.alias("out")),
        ).otherwise(
            F.struct(
                (acc["cur_len"] + n).alias("cur_len"),
                F.concat(acc["cur"], F.array(x["s"])).alias("cur"),
                acc["out"].alias("out"),
            )
        )
        return new_state.cast(state_t)

    def finish(acc):
        out = F.when(F.size(acc["cur"]) > 0, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"])
        return F.transform(out, lambda chunk: F.array_join(chunk, " "))

    return F.aggregate(items, start, step, finish)


# ---------------------------------------------------------------- tokens
def tokens(c, pattern: str = TOKEN_PATTERN) -> Column:
    """Lower-cased word tokens (default: runs of >= 2 Unicode word characters)."""
    lowered = F.lower(as_col(c))
    if pattern == TOKEN_PATTERN:
        # cut at what is no word character: extracting every match takes time by the square of a long text
        return F.filter(F.split(lowered, NO_WORD_CHARS + "+"), lambda w: F.length(w) >= 2)
    return F.regexp_extract_all(lowered, F.lit(pattern), 0)


def _regex_quote(s: str) -> str:
    out = []
    for ch in s:
        out.append("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch)
    return "".join(out)
