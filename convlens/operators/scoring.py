"""Rating texts with an external scorer (inventory K).

The scorer is the caller's function ``list[str] -> list[str]`` (a model
client, a local model, a rule).  It runs inside ``mapInPandas`` on Arrow
batches, so a model is loaded once per Python worker and called per batch;
a failing row is kept with its error message instead of being dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from convlens.functions.common import as_col
from convlens.session import cut_lineage

# Fixed value: the rating question appended to each transcript (the whole
# question; the reference's second sentence was a dangling statement).
DEFAULT_QUESTION = (
    "\nQuestion: Rate this interview on a scale of 1-7, "
    "where 1 is the lowest score and 7 is the highest score."
)


def build_prompt(df: DataFrame, text_col: str, prefix: str | None = None, question: str = DEFAULT_QUESTION, out: str = "prompt") -> DataFrame:
    """K1: ``prefix + text + question`` (zero-shot when ``prefix`` is None)."""
    parts = ([F.lit(prefix)] if prefix else []) + [F.coalesce(F.col(text_col), F.lit("")), F.lit(question)]
    return df.withColumn(out, F.concat(*parts))


def score_text(
    df: DataFrame,
    id_col: str,
    prompt_col: str,
    scorer: Callable[[list[str]], list[str]] | None = None,
    out: str = "analysis",
    scorer_factory: Callable[[], Callable[[list[str]], list[str]]] | None = None,
) -> DataFrame:
    """K2: ``(id, analysis, error)`` for every row; ``error`` is null on success.

    Pass ``scorer`` (a picklable function) or ``scorer_factory``, which is
    called once per task so a model or client is built once per partition
    and reused for all its Arrow batches.
    """
    if (scorer is None) == (scorer_factory is None):
        raise ValueError("pass exactly one of scorer / scorer_factory")
    schema = TY.StructType(
        [
            df.schema[id_col],
            TY.StructField(out, TY.StringType()),
            TY.StructField("error", TY.StringType()),
        ]
    )

    def run(batches):
        import pandas as pd

        score = scorer if scorer is not None else scorer_factory()
        for pdf in batches:
            texts = pdf[prompt_col].fillna("").astype(str).tolist()
            answers: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            try:
                res = list(score(texts))
                if len(res) != len(texts):
                    raise ValueError("scorer returned a different number of answers")
                answers = [None if r is None else str(r) for r in res]
            except Exception as failure:  # noqa: BLE001 - fall back row by row to isolate failures
                if len(texts) == 1:
                    errors[0] = f"{type(failure).__name__}: {failure}"
                for i, t in enumerate(texts if len(texts) > 1 else []):
                    try:
                        answers[i] = str(list(score([t]))[0])
                    except Exception as e:  # noqa: BLE001
                        errors[i] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({id_col: pdf[id_col], out: answers, "error": errors})

    return df.select(id_col, prompt_col).mapInPandas(run, schema)


def score_with_ledger(
    df: DataFrame,
    id_col: str,
    prompt_col: str,
    ledger: str,
    scorer: Callable[[list[str]], list[str]] | None = None,
    out: str = "analysis",
    scorer_factory: Callable[[], Callable[[list[str]], list[str]]] | None = None,
    slices: int = 16,
    attempts: int = 3,
) -> DataFrame:
    """K2, resumable: ``(id, analysis, error, attempts)`` for every row, remembered in the table at ``ledger``.

    An answer is filed under the id and a hash of its prompt.  Rows without one
    are scored in ``slices`` jobs, each of which appends its answers to the
    ledger when it ends, so a run that was killed goes on behind its last
    finished slice, and a run with nothing new asks nothing.  Rows that failed
    are asked again until they have ``attempts`` entries.  A changed prompt is a
    new row.  Rows that repeat an id and prompt are asked once.
    """
    spark = df.sparkSession
    key = [F.col(id_col), F.col(prompt_col), F.md5(F.coalesce(F.col(prompt_col), F.lit("")).cast("binary")).alias("prompt_md5")]
    rows = df.select(*key)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, prompt_md5 string, `{out}` string, error string, attempt int"

    def filed() -> DataFrame:
        # an empty append makes the folder, so that a first run reads a table too
        return spark.read.schema(schema).parquet(ledger)

    def state() -> DataFrame:
        best = F.max_by(F.struct(out, "error"), F.struct(F.col("error").isNull(), "attempt"))
        return filed().groupBy(id_col, "prompt_md5").agg(best.alias("r"), F.max("attempt").alias("attempts"))

    spark.createDataFrame([], schema).write.mode("append").parquet(ledger)
    same = [rows[id_col].eqNullSafe(F.col("__id")), rows["prompt_md5"] == F.col("__md5")]

    def known() -> DataFrame:
        return state().select(F.col(id_col).alias("__id"), F.col("prompt_md5").alias("__md5"), F.col("r.error").alias("__error"), "attempts", "r")

    for k in range(slices):
        while True:
            seen = known()
            todo = rows.dropDuplicates([id_col, "prompt_md5"]).join(seen, same, "left").where(
                F.col("attempts").isNull() | (F.col("__error").isNotNull() & (F.col("attempts") < attempts))
            )
            todo = todo.where(F.pmod(F.xxhash64(rows[id_col], rows["prompt_md5"]), F.lit(slices)) == k)
            todo = todo.select(F.struct(F.col(id_col).alias("i"), "prompt_md5", (F.coalesce("attempts", F.lit(0)) + 1).alias("attempt")).alias("key"), prompt_col)
            # read and judged before it is asked, since the ledger grows while the slice runs
            todo = cut_lineage(todo)
            if todo.isEmpty():
                break
            packed = todo.withColumn("key", F.to_json("key"))
            answers = score_text(packed, "key", prompt_col, scorer, out, scorer_factory)
            back = F.from_json("key", f"struct<i:{kind},prompt_md5:string,attempt:int>")
            answers = answers.withColumn("k", back).select(F.col("k.i").alias(id_col), "k.prompt_md5", out, "error", "k.attempt")
            answers.write.mode("append").parquet(ledger)
    final = known()
    return rows.join(final, same, "left").select(rows[id_col], F.col(f"r.{out}").alias(out), F.col("r.error").alias("error"), "attempts")


def extract_score(c, low: int = 1, high: int = 7) -> Column:
    """K3: a number low..high at the start followed by whitespace or ``. , :``; else
    the first lone such number before the first full stop; else -1."""
    rng = f"[{low}-{high}]"
    t = F.coalesce(as_col(c), F.lit(""))
    first = F.nullif(F.regexp_extract(t, r"^\s*(" + rng + r")[\s.,:]", 1), F.lit(""))
    second = F.nullif(F.regexp_extract(F.substring_index(t, ".", 1), r"\b(" + rng + r")\b", 1), F.lit(""))
    return F.coalesce(first, second, F.lit("-1")).cast("int")


def run_rating(
    transcripts: DataFrame,
    scorer: Callable[[list[str]], list[str]] | None = None,
    id_col: str = "id",
    text_col: str = "transcript",
    prefix: str | None = None,
    valid_only: bool = False,
    scorer_factory=None,
) -> DataFrame:
    """K4: prompt -> score -> extract: ``(id, predicted_score, analysis, error)``."""
    prompts = build_prompt(transcripts, text_col, prefix)
    scored = score_text(prompts, id_col, "prompt", scorer, scorer_factory=scorer_factory)
    out = scored.withColumn("predicted_score", F.when(F.col("error").isNull(), extract_score("analysis")))
    out = out.select(id_col, "predicted_score", "analysis", "error")
    return out.where(F.col("error").isNull()) if valid_only else out


__all__ = ["DEFAULT_QUESTION", "build_prompt", "score_text", "score_with_ledger", "extract_score", "run_rating"]
