"""What a question about a document is asked with: context, history, prompt, validation."""

from __future__ import annotations

import string
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.params import Chat
from quire.session import ship

HEAD_SHARE = 0.6
#: Fixed value: the mark between the kept head and tail of a long document.
ELISION = ("\n\n[... ", " characters omitted from the middle of the document ...]\n\n")
HISTORY = ("--- EARLIER IN THIS CONVERSATION ---\n", "\n--- END ---\n")


def trimmed(text: str, budget: int) -> tuple[Column, Column]:
    """(context, was it cut): ``budget`` characters from both ends around a mark with the number left out."""
    c = F.col(text)
    if budget <= 0:
        return c, F.lit(False)
    head = int(budget * HEAD_SHARE)
    long = F.length(c) > budget
    cut = F.concat(F.substring(c, 1, head), F.lit(ELISION[0]), F.format_number(F.length(c) - budget, 0), F.lit(ELISION[1]), F.right(c, F.lit(budget - head)))
    return F.when(long, cut).otherwise(c), F.coalesce(long, F.lit(False))


def exchanges(turns: DataFrame) -> DataFrame:
    """Questions and answers: each user turn with the assistant turn that follows it."""
    spoken = turns.filter(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = spoken.withColumn("answer", F.when(F.lead("role").over(w) == "assistant", F.lead("text").over(w)))
    return df.filter((F.col("role") == "user") & F.col("answer").isNotNull()).select("conv_id", "turn", F.col("text").alias("question"), "answer")


def history(turns: DataFrame, limit: int = Chat().history_turns) -> DataFrame:
    """Per conversation the last ``limit`` exchanges as lines of ``Q:`` and ``A:``."""
    if limit <= 0:
        return turns.select("conv_id").distinct().withColumn("history", F.lit(""))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = turns.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= limit)
    said = F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer")
    parts = F.array_sort(F.collect_list(F.struct("turn", said.alias("said"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["said"]), "\n").alias("history"))


def validation(question: Column, text: Column, rule: Chat = Chat()) -> Column:
    """What is answered without a model (null: ask it)."""
    return (
        F.when(T.is_blank(question), "Ask a question about the document.")
        .when(F.lit(not rule.enabled), "Asking questions about a document is switched off.")
        .when(T.is_blank(text), "There is no transcription to ask about yet.")
    )


class _Kept(dict):
    def __missing__(self, key: str) -> str:
        return "{" + key + "}"


def render(template: str, **values: object) -> str:
    """Fill a template; unknown names stay, a malformed template is returned as it is."""
    try:
        return string.Formatter().vformat(template, (), _Kept(values))
    except (ValueError, IndexError):
        return template


def rendered(template: str, **values: Column) -> Column:
    """The same for columns, by plain replacement of ``{name}``."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def asked(documents: DataFrame, template: str, rule: Chat = Chat()) -> DataFrame:
    """``documents`` (question, text, filename, history) with ``error`` or the ``prompt`` for a model."""
    context, cut = trimmed("text", rule.max_context)
    error = validation(F.col("question"), F.col("text"), rule)
    df = documents.withColumn("error", error).withColumn("trimmed", cut)
    return df.withColumn("prompt", F.when(F.col("error").isNull(), rendered(template, filename=F.col("filename"), document=context, history=F.col("history"), question=T.stripped("question"))))


def answered(questions: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """``questions`` from ``asked`` with ``answer``: only rows with a prompt reach the model; its errors become the row's error."""
    ship(questions.sparkSession)

    @F.pandas_udf("struct<answer:string,error:string>")
    def run(prompts: pd.Series) -> pd.DataFrame:
        out = []
        for p in prompts:
            try:
                out.append((call(p).strip(), None))
            except Exception as e:  # noqa: BLE001 - a model's error is that question's answer
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["answer", "error"])

    said = questions.filter("error is null").withColumn("__m", run("prompt"))
    said = said.withColumn("answer", F.col("__m.answer")).withColumn("error", F.col("__m.error")).drop("__m")
    return said.unionByName(questions.filter("error is not null").withColumn("answer", F.lit(None).cast("string")))
