"""Reconciling transcriptions into one text that holds nothing that no engine produced."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import align, compare
from quire.session import ship
from quire.shared import written

MIN_CONTAINMENT = 0.75


def usable(engines: DataFrame) -> DataFrame:
    """Engine texts (doc, engine_id, engine_ord, engine_status, text) that fusion may use."""
    return engines.filter(F.col("engine_status").isin("success", "partial") & ~T.is_blank("text"))


def prefer_primary(engines: DataFrame, *keys: str) -> DataFrame:
    return usable(engines).groupBy(*keys).agg(F.min_by(F.struct("engine_id", "text"), "engine_ord").alias("p")).select(*keys, F.col("p.engine_id").alias("engine_id"), F.col("p.text").alias("text"))


def prefer_longest(engines: DataFrame, *keys: str) -> DataFrame:
    order = F.struct((-F.length("text")).alias("l"), F.col("engine_ord").alias("o"))
    return usable(engines).groupBy(*keys).agg(F.min_by(F.struct("engine_id", "text"), order).alias("p")).select(*keys, F.col("p.engine_id").alias("engine_id"), F.col("p.text").alias("text"))


def first_two(engines: DataFrame, *keys: str) -> DataFrame:
    """Per key the first two usable engines' texts, ``text_a`` and ``text_b`` (null where there is none)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("engine_ord"))
    df = usable(engines).withColumn("__n", place).filter("__n <= 2")
    return df.groupBy(*keys).agg(F.max(F.when(F.col("__n") == 1, F.col("text"))).alias("text_a"), F.max(F.when(F.col("__n") == 2, F.col("text"))).alias("text_b"))


def line_vote(pairs: DataFrame, *keys: str, threshold: float = 0.55) -> DataFrame:
    """``text`` and counters of the line merge of text_a and text_b; one null side passes the other through.

    Equal lines stay; of a changed line the longer version; a line of one engine stays unless the
    other engine has it too and an earlier row already carried it. A pair's rows are an array
    already and are merged there: nothing is exploded or shuffled.
    """
    lacks = F.col("text_a").isNull() | F.col("text_b").isNull()
    marked = pairs.select(*keys, F.when(lacks, F.coalesce("text_a", "text_b", F.lit(""))).alias("__alone"), *(F.when(~lacks, F.col(c)).alias(c) for c in ("text_a", "text_b")))
    d = F.col("diff")
    side = lambda s, kind=None: F.transform(d if kind is None else F.filter(d, lambda x: x["kind"] == kind), lambda x: x[f"text_{s}"])
    # lines of one engine that the other has elsewhere: mostly none, and only these are looked for before
    moved = F.array_union(F.array_intersect(side("a", "only_a"), side("b")), F.array_intersect(side("b", "only_b"), side("a")))

    def merged(x: Column, no: Column) -> Column:
        single = x["kind"].isin("only_a", "only_b")
        line = F.when((x["kind"] == "only_b") | (F.length(x["text_b"]) > F.length(x["text_a"])), x["text_b"]).otherwise(x["text_a"])
        carried = lambda: F.exists(F.slice(d, F.lit(1), no), lambda y: (y["text_a"] == line) | (y["text_b"] == line))
        kept = F.when(single & F.array_contains("__moved", line) & carried(), F.lit(None)).otherwise(line)
        return F.struct(x["kind"].alias("kind"), single.alias("single"), kept.alias("kept"))

    df = compare.diffs(marked, *keys, "__alone", threshold=threshold).withColumn("__moved", moved).withColumn("__m", F.transform("diff", merged))
    n = lambda f: F.size(F.filter("__m", f)).cast("bigint")
    return df.select(
        *keys, F.coalesce("__alone", F.array_join(F.transform("__m", lambda x: x["kept"]), "\n")).alias("text"), n(lambda x: x["kind"] == "equal").alias("agreed"), n(lambda x: x["kind"] == "changed").alias("reconciled"),
        n(lambda x: x["single"] & x["kept"].isNotNull()).alias("kept_single"), n(lambda x: x["single"] & x["kept"].isNull()).alias("repositioned"),
    )


def merge_detail() -> Column:
    """One sentence on a merge (columns agreed, reconciled, kept_single, repositioned)."""
    s = lambda c: F.col(c).cast("string")
    said = F.concat(s("agreed"), F.lit(" lines agreed, "), s("reconciled"), F.lit(" reconciled, "), s("kept_single"), F.lit(" kept from a single engine."))
    more = F.concat(F.lit(" "), s("repositioned"), F.when(F.col("repositioned") != 1, " lines").otherwise(" line"), F.lit(" both engines placed differently were merged rather than repeated."))
    return F.concat(said, F.when(F.col("repositioned") > 0, more).otherwise(""))


def guarded(fused: DataFrame, *keys: str, least: float = MIN_CONTAINMENT) -> DataFrame:
    """``containment`` and ``accepted`` of ``fused`` texts against text_a and text_b.

    Words are counted as multisets; a word is supported as often as one of the sources has it. No
    words, too little support or less than half of the shorter source's length is rejected.
    """
    ship(fused.sparkSession)
    words = lambda c: F.array_join(T.all_matches(F.lower(c), T.WORD), " ")

    @F.arrow_udf("double")
    def support(f: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for rows in align._slices(f, a, b):
            for x, *sides in rows:
                have, (p, q) = Counter(x.split()), (Counter(y.split()) for y in sides)
                out.append(sum(min(n, max(p[w], q[w])) for w, n in have.items()) / have.total() if have else None)
        return pa.array(out, pa.float64())

    # a row's words are counted where the row is: nothing is shuffled
    df = fused.withColumn("containment", support(words("fused"), words("text_a"), words("text_b")))
    shortest = F.least(F.length(F.coalesce("text_a", F.lit(""))), F.length(F.coalesce("text_b", F.lit(""))))
    why = (
        F.when(T.is_blank("fused"), "blank")
        .when(F.col("containment").isNull(), "no_words")
        .when(F.col("containment") < least, "not_contained")
        .when((shortest > 0) & (F.length("fused") < shortest * 0.5), "too_short")
    )
    return df.withColumn("rejected_for", why).withColumn("accepted", why.isNull())


def page_choices(results: DataFrame, strategy: str = "line_vote", threshold: float = 0.55) -> DataFrame:
    """``doc``, ``page_number``, ``text`` and ``readings``: each page's text as the strategy decides, and how many engines read it.

    Page results need doc, page_number, engine_id, engine_ord, engine_status, status and text. A
    page that one engine read is taken as it is; of others the strategy decides, from the first two.
    """
    ok = results.filter(F.col("engine_status").isin("success", "partial") & (F.col("status") == "success") & ~T.is_blank("text"))
    keys = ["doc", "page_number"]
    count = ok.groupBy(*keys).agg(F.count("*").alias("readings"))
    if strategy == "prefer_primary":
        text = prefer_primary(ok, *keys).select(*keys, "text")
    elif strategy == "prefer_longest":
        text = prefer_longest(ok, *keys).select(*keys, "text")
    else:
        text = line_vote(first_two(ok, *keys), *keys, threshold=threshold).select(*keys, "text")
    return text.join(count, keys)


def pagewise(results: DataFrame, strategy: str = "line_vote", threshold: float = 0.55) -> DataFrame:
    """Per document the text assembled page by page, ``pages`` used and ``contested`` ones; ``page_choices`` for documents too long for a row."""
    pages = page_choices(results, strategy, threshold)
    parts = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy("doc").agg(T.stripped(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n")).alias("text"), F.count("*").alias("pages"), F.count_if(F.col("readings") > 1).alias("contested"))


def final_text(docs: DataFrame, fused: DataFrame, engines: DataFrame) -> DataFrame:
    """The fused text if there is any, else the first succeeded engine's, else empty."""
    first = prefer_primary(engines, "doc").select("doc", F.col("text").alias("engine_text"))
    df = docs.select("doc").distinct().join(fused.select("doc", F.col("text").alias("fused_text")), "doc", "left").join(first, "doc", "left")
    return df.select("doc", F.when(~T.is_blank("fused_text"), F.col("fused_text")).otherwise(F.coalesce("engine_text", F.lit(""))).alias("text"))


def with_model(pairs: DataFrame, call: Callable[[str, str], str], *keys: str, least: float = MIN_CONTAINMENT) -> DataFrame:
    """``text``, ``fallback_used`` and ``warning``: a model's merge of text_a and text_b, where it may stand.

    ``call`` runs on the executors and may raise; its answers are kept as a table, so it is asked
    once a pair. An error, or a text that the guard rejects, is replaced by the line vote.
    """
    ship(pairs.sparkSession)

    @F.pandas_udf("struct<fused:string,error:string>")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            try:
                out.append((call(x or "", y or ""), None))
            except Exception as e:  # noqa: BLE001 - whatever a model raises leads to the fallback
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["fused", "error"])

    asked = pairs.withColumn("__m", run("text_a", "text_b")).select(*keys, "text_a", "text_b", F.coalesce("__m.fused", F.lit("")).alias("fused"), F.col("__m.error").alias("error"))
    asked = written(asked, "answers")
    judged = guarded(asked, *keys, least=least)
    voted = line_vote(asked.select(*keys, "text_a", "text_b"), *keys).select(*keys, F.col("text").alias("voted"))
    ok = F.col("accepted") & F.col("error").isNull()
    df = judged.join(voted, list(keys), "left")
    return df.select(*keys, F.when(ok, F.col("fused")).otherwise(F.col("voted")).alias("text"), (~ok).alias("fallback_used"), F.when(~ok, F.coalesce("error", "rejected_for")).alias("warning"))


#: Whole-document strategies over engine texts; the first two columns of each result are doc and text.
STRATEGIES = {
    "prefer_primary": lambda e: prefer_primary(e, "doc"),
    "prefer_longest": lambda e: prefer_longest(e, "doc"),
    "line_vote": lambda e: line_vote(first_two(e, "doc"), "doc"),
}


def fused(engines: DataFrame, strategy: str = "line_vote") -> DataFrame:
    """Run a registered strategy; an unknown one is the line vote."""
    return STRATEGIES.get(strategy, STRATEGIES["line_vote"])(engines)
