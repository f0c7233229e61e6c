"""Comparison of two engines' transcriptions: aligned lines, agreement, conflicting figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import align
from quire.session import ship


def eligible(results: DataFrame) -> DataFrame:
    """Page results with text of engines that may be compared."""
    return results.filter((F.col("engine_id") != "routing") & F.col("engine_status").isin("success", "partial") & ~T.is_blank("text"))


def best_pair(results: DataFrame) -> DataFrame:
    """Per document the two engines that share most pages: ``first``, ``second``, ``shared``; ties to the earlier pair."""
    r = eligible(results).select("doc", "page_number", "engine_id", "engine_ord").distinct()
    a = r.select("doc", "page_number", F.col("engine_id").alias("first"), F.col("engine_ord").alias("o1"))
    b = r.select("doc", "page_number", F.col("engine_id").alias("second"), F.col("engine_ord").alias("o2"))
    pairs = a.join(b, ["doc", "page_number"]).filter("o1 < o2").groupBy("doc", "first", "o1", "second", "o2").agg(F.count("*").alias("shared"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.col("shared").desc(), "o1", "o2"))
    return pairs.withColumn("place", place).filter("place = 1").select("doc", "first", "second", "shared")


def joined_text(pages: DataFrame, *keys: str) -> DataFrame:
    """``text``: non-empty page texts of each key joined by blank lines, in page order."""
    some = pages.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    parts = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return some.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"))


def shared_text(results: DataFrame) -> DataFrame:
    """Per document the texts of the best pair on the pages that both have: ``text_a``, ``text_b``."""
    pair = best_pair(results)
    have = eligible(results).select("doc", "page_number", "engine_id", "text")
    a = have.join(pair.select("doc", F.col("first").alias("engine_id")), ["doc", "engine_id"], "left_semi")
    b = have.join(pair.select("doc", F.col("second").alias("engine_id")), ["doc", "engine_id"], "left_semi")
    both = a.select("doc", "page_number").join(b.select("doc", "page_number"), ["doc", "page_number"], "left_semi")
    ta = joined_text(a.join(both, ["doc", "page_number"], "left_semi"), "doc").withColumnRenamed("text", "text_a")
    tb = joined_text(b.join(both, ["doc", "page_number"], "left_semi"), "doc").withColumnRenamed("text", "text_b")
    return pair.select("doc", "first", "second").join(ta, "doc").join(tb, "doc")


def diffs(pairs: DataFrame, *keys: str, threshold: float = 0.55) -> DataFrame:
    """``diff``, the aligned lines (``align.DIFF``) of each pair, in one pass.

    Pairs of which one's lines begin with all of the other's need no matching: difflib takes these
    whole. They stay in the JVM, and the matcher gets nulls for them. Null texts have no lines.
    """
    ship(pairs.sparkSession)
    df = pairs.select(*keys, T.lines("text_a").alias("__a"), T.lines("text_b").alias("__b"))
    a, b, n, m = F.col("__a"), F.col("__b"), F.size("__a"), F.size("__b")
    both = F.least(n, m)
    plain = F.slice(a, F.lit(1), both) == F.slice(b, F.lit(1), both)
    df = df.withColumn("__plain", plain)
    row = lambda kind, x, y, r: F.struct(F.lit(kind).alias("kind"), x.alias("text_a"), y.alias("text_b"), F.lit(r).alias("similarity"))
    none = F.lit("")
    rest = lambda c: F.slice(c, both + 1, F.greatest(n, m))
    begins = F.concat(
        F.transform(F.slice(a, F.lit(1), both), lambda x: row("equal", x, x, 1.0)), F.transform(rest(a), lambda x: row("only_a", x, none, 0.0)), F.transform(rest(b), lambda x: row("only_b", none, x, 0.0))
    )
    hard = ~F.col("__plain")
    matched = align.diff(F.when(hard, a), F.when(hard, b), threshold)
    return df.select(*keys, F.when(F.col("__plain"), begins.cast(align.DIFF)).otherwise(matched).alias("diff"))


def diff_lines(pairs: DataFrame, *keys: str, threshold: float = 0.55) -> DataFrame:
    """``row_no``, ``kind``, ``text_a``, ``text_b``, ``similarity`` of every aligned line of each pair; null texts have no lines."""
    # an inner explode would get a filter on the array's size, which is pushed down and evaluates the alignment again;
    # pairs without any line are left out first, so the outer one has no rows of its own
    some = pairs.filter(~T.is_blank("text_a") | ~T.is_blank("text_b"))
    rows = diffs(some, *keys, threshold=threshold).select(*keys, F.posexplode_outer("diff").alias("row_no", "d"))
    return rows.select(*keys, F.col("row_no").cast("bigint").alias("row_no"), "d.kind", "d.text_a", "d.text_b", "d.similarity")


def summary(rows: DataFrame, *keys: str) -> DataFrame:
    """Counters and agreement: similarity weighted by the lengths of both sides."""
    weight = F.length("text_a") + F.length("text_b")
    gain = F.when(F.col("kind") == "equal", weight).when(F.col("kind") == "changed", F.col("similarity") * weight).otherwise(0)
    n = lambda k: F.count_if(F.col("kind") == k)
    out = rows.groupBy(*keys).agg(
        n("equal").alias("equal_lines"), n("changed").alias("changed_lines"), n("only_a").alias("only_a_lines"), n("only_b").alias("only_b_lines"), F.count("*").alias("total_lines"),
        F.sum(gain).cast("double").alias("__g"), F.sum(weight).alias("__w"), (n("equal") + n("changed") + n("only_a")).alias("__a"), (n("equal") + n("changed") + n("only_b")).alias("__b"),
    )
    # one side without any line is nothing to compare
    similarity = F.when((F.col("__a") == 0) | (F.col("__b") == 0) | (F.col("__w") == 0), 0.0).otherwise(F.col("__g") / F.col("__w"))
    return out.withColumn("similarity", similarity).withColumn("differing_lines", F.col("total_lines") - F.col("equal_lines")).drop("__g", "__w", "__a", "__b")


def counters(pairs: DataFrame, *keys: str, threshold: float = 0.55) -> DataFrame:
    """``summary`` of each pair with ``agreement_percent`` and the characters and words of both texts."""
    size = lambda s: (F.length(F.coalesce(f"text_{s}", F.lit(""))).cast("bigint").alias(f"characters_{s}"), T.word_count(f"text_{s}").alias(f"words_{s}"))
    sizes = pairs.select(*keys, *size("a"), *size("b"))
    found = sizes.join(summary(diff_lines(pairs, *keys, threshold=threshold), *keys), list(keys), "left")
    zero = ("equal_lines", "changed_lines", "only_a_lines", "only_b_lines", "total_lines", "differing_lines", "similarity")
    found = found.fillna(0, [c for c in zero])
    return found.withColumn("agreement_percent", F.bround(F.col("similarity") * 100, 1))


def with_numbers(rows: DataFrame) -> DataFrame:
    return rows.withColumn("numbers_a", T.numbers("text_a")).withColumn("numbers_b", T.numbers("text_b"))


def is_conflict() -> Column:
    """Whether a diff row is a changed line whose numbers differ, in order and number."""
    return F.when(F.col("kind") == "changed", T.numbers("text_a") != T.numbers("text_b")).otherwise(False)


def conflicts(rows: DataFrame) -> DataFrame:
    """Changed lines whose numbers differ, in order and number."""
    df = with_numbers(rows.filter("kind = 'changed'"))
    return df.filter(F.col("numbers_a") != F.col("numbers_b"))


def disagreements(rows: DataFrame, *keys: str, limit: int = 0) -> DataFrame:
    """Lines that are not equal; the first ``limit`` of each key if it is above 0."""
    df = rows.filter("kind <> 'equal'")
    if limit <= 0:
        return df
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("row_no"))).filter(F.col("__n") <= limit).drop("__n")


def badge(agreement: str = "agreement_percent"):
    return F.when(F.col(agreement) >= 90, "ok").when(F.col(agreement) >= 70, "warn").otherwise("err")
