"""The page cache as a store of files by key prefix.

Entries are appended, never rewritten by a lookup or a put. A lookup lists the prefixes that its
keys meet, at most 16 to the power of their length, and reads these folders only; within a file
entries are sorted by key with a Bloom filter, so a few listed keys skip what can't hold them.
``compacted`` rewrites only the prefixes that have gathered many files.
"""

from __future__ import annotations

from collections import Counter
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import cache
from quire.operators.cascade import RESULT, Engine
from quire.shared import written

#: Characters of a key that name its folder: 256 folders; 3 for a cache of very many entries.
PREFIX = 2
#: Keys that are handed to the scan itself; Parquet asks its Bloom filters for so few only.
LISTED = 10
#: Files of a prefix that compaction leaves alone.
FILES = 8


def prefix_of(key: str = "key", length: int = PREFIX) -> Column:
    # as a number Spark would read 00 and 0 alike, so the folder's name begins with a letter
    return F.concat(F.lit("k"), F.substring(key, 1, length))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _writer(entries: DataFrame, length: int):
    named = entries.withColumn("prefix", prefix_of("key", length))
    sorted_ = named.repartition("prefix").sortWithinPartitions("prefix", "key")
    return sorted_.write.partitionBy("prefix").option("parquet.bloom.filter.enabled#key", "true")


def put(results: DataFrame, path: str, length: int = PREFIX) -> None:
    """Append ``cache.storable(results)``, of several results of a key the latest; what was there is not read."""
    columns = [c.split()[0] for c in cache.SCHEMA.split(", ")]
    new = cache.storable(results).select(*columns)
    _writer(new.groupBy("key").agg(F.max_by(F.struct(*columns), "created_at").alias("r")).select("r.*"), length).mode("append").parquet(path)


def entries(spark: SparkSession, path: str, prefixes: list[str] | None = None, keys: list[str] | None = None) -> DataFrame:
    """Entries of the named prefixes (all), and of the listed keys if given; none where nothing was put yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], cache.SCHEMA)
    found = spark.read.schema(f"{cache.SCHEMA}, prefix string").parquet(path)
    if prefixes is not None:
        found = found.filter(F.col("prefix").isin(prefixes))
    if keys is not None:
        found = found.filter(F.col("key").isin(keys))
    return found.drop("prefix")


def met(pages: DataFrame, path: str, length: int = PREFIX) -> DataFrame:
    """The entries that a lookup of ``pages`` (with key) has to read."""
    spark = pages.sparkSession
    few = [r["key"] for r in pages.filter("key is not null").select("key").distinct().limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        return entries(spark, path, sorted({"k" + k[:length] for k in few}), few)
    prefixes = pages.filter("key is not null").select(prefix_of("key", length).alias("prefix")).distinct()
    return entries(spark, path, sorted(r["prefix"] for r in prefixes.collect()))


def lookup(pages: DataFrame, path: str, length: int = PREFIX) -> DataFrame:
    """``cache.lookup`` against the store."""
    return cache.lookup(pages, met(pages, path, length))


def read_through(pages: DataFrame, path: str, engine: Engine, order: int, *, now: float, image: str = "image", length: int = PREFIX) -> tuple[DataFrame, DataFrame]:
    """(results of all pages, hits and misses of each document); what the engine read is appended to the store.

    The results are a table of their own: the store grows after they were looked up.
    """
    keyed = pages.withColumn("key", cache.page_key(F.col(image), engine.engine_id, engine.model, engine.options))
    found = pages.sparkSession.createDataFrame([], cache.SCHEMA) if engine.engine_id in cache.BYPASSED else met(keyed.select("key"), path, length)
    results, new, stats = cache.read_new(pages, found, engine, order, now=now, image=image)
    names = [c.split()[0] for c in RESULT.split(", ")]
    results, stats = written(results.select(*names), "cached-results"), written(stats, "cache-stats")
    if new is not None:
        put(new, path, length)
    return results, stats


def files_by_prefix(spark: SparkSession, path: str) -> dict[str, int]:
    """How many files each prefix has, from the listing alone."""
    if not _exists(spark, path):
        return {}
    names = spark.read.schema(f"{cache.SCHEMA}, prefix string").parquet(path).inputFiles()
    return dict(Counter(unquote(n.rsplit("/", 2)[-2].removeprefix("prefix=")) for n in names))


def compacted(spark: SparkSession, path: str, length: int = PREFIX, most: int = FILES, version: int = cache.FORMAT) -> list[str]:
    """Rewrite the prefixes with more than ``most`` files to the current entries of ``version``; gives their names.

    The new files are whole in the shared folder before the old ones go; other prefixes aren't read.
    Nothing may be put meanwhile.
    """
    full = sorted(p for p, n in files_by_prefix(spark, path).items() if n > most)
    if full:
        kept = written(cache.current(entries(spark, path, full), version), "compacted")
        # a prefix without current entries gets no new file, so it is emptied by hand
        left = {r["prefix"] for r in kept.select(prefix_of("key", length).alias("prefix")).distinct().collect()}
        _writer(kept, length).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
        for p in sorted(set(full) - left):
            _delete(spark, f"{path}/prefix={p}")
    return full


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def count(spark: SparkSession, path: str, version: int = cache.FORMAT) -> int:
    return cache.current(entries(spark, path), version).count()


def clear(spark: SparkSession, path: str) -> None:
    _delete(spark, path)
