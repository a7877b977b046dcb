"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, and only its reply under the loss mask.  A conversation that does not
end in an assistant turn has one more example without a target, so that every
turn is in the output.  A turn is written as::

    <|im_start|>role\\n text <|im_end|>\\n        (without the blanks)

Control strings inside a text are escaped reversibly: ``&`` becomes ``&amp;``
and ``<|`` becomes ``&lt;|``, so ``<|`` in an example is always the
template's; a line break in a role becomes ``&#10;``.  The mask is one range
of code points, ``[loss_start, loss_end)``.

Everything is a DataFrame expression.  A conversation's turns meet in one row,
because each example holds them all as one string; the expansion grows with
the square of a conversation's turns, as its output does, and examples leave
the row one by one.

Defined results: turns are ordered by turn (null first), then role and text;
a null text or role is empty; only the role ``assistant`` is trained; a null
conversation id is a conversation of its own; repeated rows are turns of
their own; an empty table has no examples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
END_PATTERN = r"<\|im_end\|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def format_examples(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end``: one row per assistant turn (example: its place from 0)."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("o"),
        F.coalesce(role, F.lit("")).alias("r"),
        F.coalesce(text, F.lit("")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("o", "r", "t"))).alias("turns"))
    drawn = whole.select(
        "conv_id",
        F.transform("turns", lambda x: F.struct(x["r"].alias("role"), _role(x["r"]).alias("r"), escape(x["t"]).alias("t"))).alias("turns"),
    ).withColumn("drawn", F.transform("turns", lambda x: F.concat(F.lit(START), x["r"], F.lit("\n"), x["t"], F.lit(END))))
    last = F.size("turns") - 1
    targets = F.filter(
        F.sequence(F.lit(0), last), lambda i: (F.get(F.col("turns"), i)["role"] == "assistant") | (i == last)
    )
    each = drawn.withColumn("example", F.explode(targets)).withColumn("own", F.get("turns", F.col("example")))
    before = F.array_join(F.slice("drawn", F.lit(1), F.col("example")), "")
    parts = each.select(
        "conv_id", "example", "own", F.concat(before, F.lit(START), F.col("own.r"), F.lit("\n")).alias("head")
    )
    trained = F.col("own.role") == "assistant"
    text_ = F.concat("head", F.col("own.t"), F.lit(END))
    end = F.length("head") + F.length("own.t")
    return parts.select(
        "conv_id",
        "example",
        text_.alias("text"),
        F.when(trained, F.length("head")).otherwise(F.length(text_)).cast("long").alias("loss_start"),
        F.when(trained, end).otherwise(F.length(text_)).cast("long").alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: ``n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    loss = unescape(F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    rows = examples.select(
        "conv_id", "example", "text", F.length("text").alias("chars"), loss.alias("loss"), F.length(loss).alias("loss_chars")
    )
    whole = rows.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.sum("loss_chars").cast("long").alias("loss_chars"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("loss"),
    )
    # "<|" in an example is always the template's, so the text up to each end mark is one turn
    pieces = whole.withColumn("turns", F.split("text", END_PATTERN, -1)).withColumn("n", F.size("turns") - 1)

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        text = F.substr(body, F.length(role) + 2)
        return F.concat(unescape(F.replace(role, F.lit("&#10;"), F.lit("\n"))), F.lit("\n"), unescape(text), F.lit("\n"))

    return pieces.select(
        "conv_id",
        F.col("n").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("n")), turn), ""), 256).alias("turns_sha256"),
        "loss_chars",
        F.sha2(F.array_join(F.transform("loss", lambda x: x["loss"]), ""), 256).alias("loss_sha256"),
        "formatted_chars",
    )
