"""A page cache as a table: content-addressed keys, lookups as joins, engines run on misses only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.cascade import RESULT, Engine, engine_status, read_once

FORMAT = 1
#: Engines that cost less than a lookup.
BYPASSED = ("text_layer", "routing")
SCHEMA = "key string, format int, provider_id string, model string, text string, input_tokens bigint, output_tokens bigint, seconds double, created_at double"


def page_key(image: Column, provider: str, model: str | None, options: dict) -> Column:
    """SHA-256 over image, engine, model and options (with the prompt, so that another prompt misses)."""
    tail = "\x00".join(["", provider, model or "", json.dumps(options, sort_keys=True, default=str)])
    return F.sha2(F.concat(image.cast("binary"), F.lit(tail).cast("binary")), 256)


def current(cache: DataFrame, version: int = FORMAT) -> DataFrame:
    """The latest entry of each key, of this format only; an aggregate with partial sums, as blank pages share a key."""
    kept = cache.filter(F.col("format") == version)
    return kept.groupBy("key").agg(F.max_by(F.struct(*kept.columns), "created_at").alias("r")).select("r.*")


def lookup(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """``pages`` (with key) with ``hit`` and the cached columns; a hit's own duration is 0."""
    c = current(cache).select("key", F.col("text").alias("cached_text"), F.col("seconds").alias("saved_seconds"), F.col("input_tokens").alias("cached_input"), F.col("output_tokens").alias("cached_output"), F.lit(True).alias("hit"))
    return pages.join(c, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).withColumn("duration", F.when(F.col("hit"), 0.0))


def misses(pages: DataFrame, cache: DataFrame) -> DataFrame:
    return pages.join(current(cache).select("key"), "key", "left_anti")


def stats(looked_up: DataFrame, *keys: str) -> DataFrame:
    saved = F.coalesce(F.sum(F.when(F.col("hit"), F.coalesce("saved_seconds", F.lit(0.0)))), F.lit(0.0))
    return looked_up.groupBy(*keys).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), saved.alias("seconds_saved"))


def storable(results: DataFrame) -> DataFrame:
    """Fresh results that go into the cache: successful pages with text, of engines that are not bypassed."""
    return results.filter((F.col("status") == "success") & ~T.is_blank("text") & ~F.col("provider_id").isin(*BYPASSED))


def stored(cache: DataFrame, results: DataFrame) -> DataFrame:
    """The cache after insert-or-replace of ``storable(results)``; of several new results of a key the latest."""
    new = storable(results).select(*cache.columns)
    new = new.groupBy("key").agg(F.max_by(F.struct(*new.columns), "created_at").alias("r")).select("r.*")
    return cache.join(new.select("key"), "key", "left_anti").unionByName(new)


def count(cache: DataFrame) -> int:
    return cache.count()


def cleared(cache: DataFrame) -> DataFrame:
    """The cache without its entries."""
    return cache.limit(0)


def merged(looked_up: DataFrame, fresh: DataFrame) -> DataFrame:
    """One result per page: cached where there was a hit, else fresh."""
    kept = looked_up.filter("hit").select("doc", "page_number", F.col("cached_text").alias("text"), F.lit("success").alias("status"), F.lit(0.0).alias("seconds"), F.lit("cache").alias("origin"))
    return kept.unionByName(fresh.select("doc", "page_number", "text", "status", "seconds", F.lit("engine").alias("origin")))


def read_cached(pages: DataFrame, cache: DataFrame, engine: Engine, order: int, *, now: float, image: str = "image") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results of all pages, the cache after, hits and misses of each document).

    Pages that the cache has aren't read; the engine reads each of the others once, and its good
    results go into the cache. Engines that cost less than a lookup go past it. A cached page took
    no time now; what it took when it was read counts as saved.
    """
    results, new, counts = read_new(pages, cache, engine, order, now=now, image=image)
    return results, cache if new is None else stored(cache, new), counts


def read_new(pages: DataFrame, cache: DataFrame, engine: Engine, order: int, *, now: float, image: str = "image") -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """As ``read_cached``, with the new entries (with status; None: the engine goes past the cache) in place of the cache after."""
    if engine.engine_id in BYPASSED:
        return read_once(pages, engine, order), None, pages.select("doc").distinct().select("doc", *(F.lit(0).cast("bigint").alias(c) for c in ("hits", "misses")), F.lit(0.0).alias("seconds_saved"))
    keyed = pages.withColumn("key", page_key(F.col(image), engine.engine_id, engine.model, engine.options))
    fresh = read_once(misses(keyed, cache), engine, order)
    looked = lookup(keyed.select("doc", "page_number", "key"), cache)
    none = {"error": "string", "done_reason": "string"}
    kept = looked.filter("hit").select(
        "doc", F.col("page_number").cast("bigint").alias("page_number"), F.lit(engine.engine_id).alias("engine_id"), F.lit(order).alias("engine_ord"), F.col("cached_text").alias("text"), F.lit("success").alias("status"),
        *(F.lit(None).cast(t).alias(c) for c, t in none.items()), F.lit(0.0).alias("seconds"), F.col("cached_input").alias("input_tokens"), F.col("cached_output").alias("output_tokens"),
    )
    new = fresh.join(keyed.select("doc", "page_number", "key"), ["doc", "page_number"]).select(
        "key", F.lit(FORMAT).alias("format"), F.col("engine_id").alias("provider_id"), F.lit(engine.model).cast("string").alias("model"), "text", "input_tokens", "output_tokens", "seconds", F.lit(float(now)).alias("created_at"), "status"
    )
    names = [c.split()[0] for c in RESULT.split(", ")]
    return kept.select(*names).unionByName(fresh.select(*names)), new, stats(looked, "doc")


def rolled_up(results: DataFrame) -> DataFrame:
    """The status of each document's run, cached pages counted like any."""
    return engine_status(results, "doc", "engine_id")
