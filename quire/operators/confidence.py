"""How far a transcription can be trusted, and which pages get a second reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import ranks
from quire.params import Confidence

#: What each flag tells the reader.
REASONS = {
    "empty": "the engine returned nothing for this page",
    "truncated": "the transcription stopped at the token limit, so the end of the page is missing",
    "repetition": "the engine repeated the same line many times, which means it lost its place",
    "sparse_for_ink": "the page carries far more ink than the transcription accounts for",
    "not_language": "most of what came back does not read as words or figures",
}


def scored(results: DataFrame, rule: Confidence = Confidence()) -> DataFrame:
    """``results`` with ``flags``, ``score`` and ``reason``; needs text, status, done_reason and ink (nulls allowed)."""
    empty = (F.col("status") == "failed") | T.is_blank("text")
    flag = lambda name, c: F.when(F.coalesce(c, F.lit(False)), F.lit(name))
    found = F.filter(
        F.array(
            flag("truncated", F.col("done_reason") == "length"),
            flag("repetition", T.longest_repeat("text") >= rule.max_repeated_lines),
            flag("sparse_for_ink", (F.col("ink") >= rule.dense_ink) & (T.word_count("text") < rule.min_words_for_dense_page)),
            flag("not_language", T.language_ratio("text") < rule.min_language_ratio),
        ),
        lambda x: x.isNotNull(),
    )
    df = results.withColumn("flags", F.when(empty, F.array(F.lit("empty"))).otherwise(found))
    score = F.when(F.array_contains("flags", "empty"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.3 * F.size("flags")))
    return df.withColumn("score", score).withColumn("reason", reasons("flags"))


def reasons(flags: str | Column) -> Column:
    said = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    joined = F.array_join(F.transform(T.column(flags), lambda f: said[f]), "; ")
    return F.when(F.size(T.column(flags)) == 0, F.lit("the transcription looks complete")).otherwise(joined)


def selected_for_rereading(scores: DataFrame, rule: Confidence = Confidence()) -> DataFrame:
    """Flagged pages that a second engine reads: the first of each document, up to a share of its pages, one at least."""
    if not rule.fallback_enabled:
        return scores.limit(0).withColumn("place", F.lit(0))
    cap = F.greatest(F.lit(1), F.floor(F.count("*") * rule.max_fallback_share)).cast("bigint")
    caps = scores.groupBy("doc").agg(cap.alias("cap"))
    flagged = scores.filter(F.size("flags") > 0)
    placed = ranks.numbered(flagged.select("doc", "page_number"), ["doc"], [F.col("page_number")], "place")
    first = ranks.joined(placed, caps, ["doc"]).filter("place <= cap").select("doc", "page_number", "cap", "place")
    return ranks.joined(flagged, first, ["doc", "page_number"])


def review_queue(scores: DataFrame, results: DataFrame) -> DataFrame:
    """Flagged pages with the text of the first engine that has any for them."""
    texts = results.filter(~T.is_blank("text")).groupBy("doc", "page_number").agg(F.min_by("text", "engine_ord").alias("shown"))
    return scores.filter(F.size("flags") > 0).join(texts, ["doc", "page_number"], "left")
