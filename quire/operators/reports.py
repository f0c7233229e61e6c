"""Run metrics, percentiles, display values, progress. Unknown values are null, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import ranks
from quire.params import Output

NOT_AVAILABLE = "N/A"


def token_totals(results: DataFrame, *keys: str) -> DataFrame:
    """Input, output and total tokens and throughput; sums of nothing known stay null."""
    df = results.groupBy(*keys).agg(F.count("*").alias("pages"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("seconds").alias("seconds"))
    both = F.col("input_tokens").isNull() & F.col("output_tokens").isNull()
    df = df.withColumn("total_tokens", F.when(~both, F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))))
    rate = F.when((F.col("output_tokens") > 0) & (F.col("seconds") > 0), F.col("output_tokens") / F.col("seconds"))
    return df.withColumn("tokens_per_second", rate)


def percentiles(timings: DataFrame, *keys: str, value: str = "seconds") -> DataFrame:
    """mean, median, p90, p95, max of known values: percentiles by nearest index, rounded half to even.

    Values are counted per distinct value, dealt out by ranges of (key, value), and counted up within
    ranges from where the ranges before end; the wanted ranks are then looked up, so no task holds a key.
    """
    known = timings.filter(F.col(value).isNotNull())
    distinct = known.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    table = ranks.dealt(distinct, list(keys), [F.col("v")])
    sums = table.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("v") * F.col("n")).alias("sum"), F.max("v").alias("top"))
    counted = ranks.running(table, list(keys), [F.col("v")], {"upto": ("sum", F.col("n"), False)})
    last = F.col("total") - 1
    index = lambda f: F.least(last, F.bround(last * F.lit(f)).cast("bigint"))
    wanted = {"low": F.floor(last / 2), "high": F.ceil(last / 2), "p90": index(0.9), "p95": index(0.95)}
    rows = ranks.joined(counted, sums, list(keys))
    found = rows.groupBy(*keys).agg(
        F.max("total").alias("measured"), F.max("sum").alias("sum"), F.max("top").alias("max"), *(F.max(F.when((i < F.col("upto")) & (i >= F.col("upto") - F.col("n")), F.col("v"))).alias(c) for c, i in wanted.items())
    )
    return found.select(*keys, "measured", (F.col("sum") / F.col("measured")).alias("mean"), ((F.col("low") + F.col("high")) / 2).alias("median"), "p90", "p95", "max")


def benchmark_totals(documents: DataFrame) -> DataFrame:
    """One row over per-document timings: totals, pages a minute, greatest memory seen (null: never observed)."""
    s = F.sum("seconds")
    pages = F.sum("pages")
    return documents.agg(
        F.count("*").alias("documents"), pages.alias("pages"), F.sum("pages_needing_ocr").alias("ocr_pages"), F.sum("pages_avoided").alias("pages_avoided"), s.alias("seconds"),
        F.when((s > 0) & (pages > 0), pages / s * 60).alias("pages_per_minute"), F.max("memory_mb").alias("memory_mb"),
    )


def run_metrics(engines: DataFrame, documents: DataFrame, fused: DataFrame) -> DataFrame:
    """Per document: durations, pages, engines run and well, tokens, size of the final text."""
    e = engines.groupBy("doc").agg(F.count("*").alias("engines_run"), F.count_if(F.col("engine_status").isin("success", "partial")).alias("engines_succeeded"), F.count_if(F.col("engine_status") == "failed").alias("engines_failed"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    f = fused.select("doc", F.length("text").cast("bigint").alias("final_characters"), T.word_count("text").alias("final_words"))
    df = documents.select("doc", "pages", "seconds").join(e, "doc", "left").join(f, "doc", "left")
    none = F.col("input_tokens").isNull() & F.col("output_tokens").isNull()
    return df.withColumn("average_seconds", F.when(F.col("pages") > 0, F.col("seconds") / F.col("pages"))).withColumn("total_tokens", F.when(~none, F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))))


def _known(c: Column, shown: Column) -> Column:
    return F.when(c.isNull(), NOT_AVAILABLE).otherwise(shown)


def format_duration(c: Column) -> Column:
    minutes = F.floor(c / 60)
    return _known(c, F.when(c < 60, F.concat(F.format_string("%.2f", c), F.lit("s"))).otherwise(F.concat(minutes.cast("string"), F.lit("m "), F.bround(c - minutes * 60).cast("int").cast("string"), F.lit("s"))))


def format_int(c: Column) -> Column:
    return _known(c, F.format_number(c, 0))


def format_rate(c: Column, unit: str = "tok/s") -> Column:
    return _known(c, F.concat(F.format_string("%.1f", c), F.lit(f" {unit}")))


def format_percent(c: Column) -> Column:
    return _known(c, F.concat(F.format_string("%.1f", c), F.lit("%")))


def display_metrics(engines: DataFrame, show: Output = Output()) -> DataFrame:
    """(doc, engine_id, place, label, value) rows of what the output settings show of each engine."""
    c = F.col
    rows: list[tuple[bool, str, Column, Column | None]] = [
        (show.engine_name, "Engine", c("engine_name"), None),
        (show.model_name, "Model", F.coalesce("model_name", F.lit(NOT_AVAILABLE)), None),
        (show.model_name, "Backend", c("backend"), c("backend").isNotNull()),
        (True, "Status", F.initcap("engine_status"), None),
        (True, "Processing", F.initcap("location"), None),
        (show.processing_time, "Total time", format_duration(c("seconds")), None),
        (show.processing_time, "Model load", format_duration(c("load_seconds")), None),
        (show.processing_time, "Inference", format_duration(c("inference_seconds")), None),
        (show.processing_time, "Per page", format_duration(c("seconds") / c("pages")), c("pages") > 0),
        (show.token_usage, "Input tokens", format_int(c("input_tokens")), None),
        (show.token_usage, "Output tokens", format_int(c("output_tokens")), None),
        (show.token_usage, "Total tokens", format_int(c("total_tokens")), None),
        (show.token_usage, "Throughput", format_rate(c("tokens_per_second")), None),
        (True, "Pages", format_int(c("pages")), None),
        (show.character_count, "Characters", format_int(c("characters")), None),
        (show.word_count, "Words", format_int(c("words")), None),
        (show.confidence, "Confidence", format_percent(c("confidence") * 100), None),
    ]
    shown = [F.when(F.lit(True) if when is None else when, F.struct(F.lit(i).cast("bigint").alias("place"), F.lit(label).alias("label"), value.alias("value"))) for i, (on, label, value, when) in enumerate(rows) if on]
    return engines.select("doc", "engine_id", F.explode(F.filter(F.array(*shown), lambda x: x.isNotNull())).alias("m")).select("doc", "engine_id", "m.place", "m.label", "m.value")


def run_progress(timings: DataFrame) -> DataFrame:
    """Per finished page: mean seconds so far, pages left, and the sentence on what is left (needs doc, place, seconds, total)."""
    table = ranks.dealt(timings, ["doc"], [F.col("place")])
    df = ranks.running(table, ["doc"], [F.col("place")], {"__s": ("sum", F.col("seconds"), False), "__k": ("count", F.col("seconds"), False)})
    df = df.withColumn("rate", F.col("__s") / F.nullif("__k", F.lit(0))).withColumn("left", F.col("total") - F.col("place")).drop("__s", "__k")
    remaining = F.when((F.col("left") > 0) & F.col("rate").isNotNull(), F.col("rate") * F.col("left"))
    df = df.withColumn("remaining", remaining)
    position = F.concat(F.lit("Page "), (F.col("place") + 1).cast("string"), F.lit(" of "), F.col("total").cast("string"))
    minutes = F.col("remaining") / 60
    said = F.when(F.col("remaining").isNull(), F.lit(" - timing the first page before estimating")).when(minutes < 1, F.lit(" - under a minute left")).otherwise(F.concat(F.lit(" - about "), F.bround(minutes).cast("int").cast("string"), F.lit(" min left")))
    return df.withColumn("said", F.concat(position, said))


def total_metrics(runs: DataFrame, show: Output = Output()) -> DataFrame:
    """(doc, place, label, value) rows of a whole run: ``run_metrics`` columns and agreement_percent (null: nothing compared)."""
    c = F.col
    rows: list[tuple[bool, str, Column, Column | None]] = [
        (True, "Total time", format_duration(c("seconds")), None),
        (True, "Pages processed", format_int(c("pages")), None),
        (True, "Average per page", format_duration(c("average_seconds")), None),
        (True, "OCR engines", F.concat(c("engines_succeeded").cast("string"), F.lit(" of "), c("engines_run").cast("string"), F.lit(" succeeded")), None),
        (show.token_usage, "Total tokens", format_int(c("total_tokens")), None),
        (show.token_usage, "Input tokens", format_int(c("input_tokens")), None),
        (show.token_usage, "Output tokens", format_int(c("output_tokens")), None),
        (show.character_count, "Characters", format_int(c("final_characters")), None),
        (show.word_count, "Words", format_int(c("final_words")), None),
        (True, "Engine agreement", format_percent(c("agreement_percent")), c("agreement_percent").isNotNull()),
    ]
    shown = [F.when(F.lit(True) if when is None else when, F.struct(F.lit(i).cast("bigint").alias("place"), F.lit(label).alias("label"), value.alias("value"))) for i, (on, label, value, when) in enumerate(rows) if on]
    return runs.select("doc", F.explode(F.filter(F.array(*shown), lambda x: x.isNotNull())).alias("m")).select("doc", "m.place", "m.label", "m.value")


def document_benchmark(documents: DataFrame, routes: DataFrame, results: DataFrame, fused: DataFrame) -> DataFrame:
    """One row per document: pages, pages an engine had to read, pages avoided, engine seconds, final words, error.

    ``documents`` are (doc, load_error): one that couldn't be loaded has a row with its error and zeros.
    """
    plan = routes.groupBy("doc").agg(F.count("*").alias("pages"), F.count_if(F.col("page_class") == "needs_ocr").alias("pages_needing_ocr"))
    spent = results.groupBy("doc").agg(F.sum("seconds").alias("seconds"))
    words = fused.select("doc", T.word_count("text").alias("final_words"))
    df = documents.select("doc", F.when(F.col("load_error").isNotNull(), F.concat(F.lit("could not be loaded: "), "load_error")).alias("error"))
    for part in (plan, spent, words):
        df = df.join(part, "doc", "left")
    df = df.fillna(0, ["pages", "pages_needing_ocr", "seconds", "final_words"])
    return df.withColumn("pages_avoided", F.col("pages") - F.col("pages_needing_ocr"))


def page_timings(results: DataFrame) -> DataFrame:
    """Every engine's page with its time and tokens, and the tokens a second that it gave (null: unknown)."""
    rate = F.when((F.col("output_tokens") > 0) & (F.col("seconds") > 0), F.col("output_tokens") / F.col("seconds"))
    return results.select("doc", "engine_id", "page_number", "status", "seconds", "input_tokens", "output_tokens", rate.alias("tokens_per_second"))
