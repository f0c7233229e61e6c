"""The page cache as files by key prefix."""

from pyspark.sql import functions as F

from quire.operators import cache, cascade, store


def results(spark, n, at=1.0, text="t", fmt=1):
    key = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(n).select(
        key.alias("key"), F.lit(fmt).alias("format"), F.lit("p").alias("provider_id"), F.lit("m").alias("model"), F.concat(F.lit(text), F.col("id")).alias("text"), F.lit(None).cast("bigint").alias("input_tokens"), F.lit(None).cast("bigint").alias("output_tokens"),
        F.lit(1.0).alias("seconds"), F.lit(at).alias("created_at"), F.lit("success").alias("status"),
    )


def keys(spark, *ids):
    return spark.createDataFrame([("d", i) for i in ids], "doc string, page_number bigint").withColumn("key", F.sha2(F.col("page_number").cast("string"), 256))


def test_lookups_read_only_the_prefixes_they_meet(spark, tmp_path):
    path = f"{tmp_path}/cache"
    assert {r["hit"] for r in store.lookup(keys(spark, 1, 2), path).collect()} == {False}
    store.put(results(spark, 3000), path)
    files = store.files_by_prefix(spark, path)
    assert len(files) == 256
    few = store.met(keys(spark, 5, 7000), path)
    got = {r["page_number"]: r["cached_text"] for r in store.lookup(keys(spark, 5, 7000), path).collect()}
    assert got == {5: "t5", 7000: None} and few.count() == 1
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "In(key" in plan
    many = store.met(keys(spark, *range(20)), path)
    assert {r["k"] for r in many.select(F.substring("key", 1, 2).alias("k")).distinct().collect()} == {r["k"] for r in keys(spark, *range(20)).select(F.substring("key", 1, 2).alias("k")).distinct().collect()}


def test_the_latest_entry_of_the_current_format_counts(spark, tmp_path):
    path = f"{tmp_path}/cache"
    store.put(results(spark, 20, 1.0, "old"), path)
    store.put(results(spark, 10, 2.0, "new"), path)
    store.put(results(spark, 20, 3.0, "other", fmt=0), path)
    store.put(results(spark, 20, 4.0, "bad").withColumn("status", F.lit("failed")), path)
    want = {i: f"{'new' if i < 10 else 'old'}{i}" for i in range(20)}
    assert {r["page_number"]: r["cached_text"] for r in store.lookup(keys(spark, *range(20)), path).collect()} == want
    assert store.count(spark, path) == 20


def test_compaction_rewrites_full_prefixes_only(spark, tmp_path):
    path = f"{tmp_path}/cache"
    for at in range(3):
        store.put(results(spark, 40, float(at), f"v{at}-").filter("id < 2" if at else "true"), path)
    before = store.files_by_prefix(spark, path)
    full = store.compacted(spark, path, most=2)
    after = store.files_by_prefix(spark, path)
    assert 1 <= len(full) <= 2 and all(after[p] == 1 for p in full)
    assert {p: n for p, n in after.items() if p not in full} == {p: n for p, n in before.items() if p not in full}
    got = {r["page_number"]: r["cached_text"] for r in store.lookup(keys(spark, *range(40)), path).collect()}
    assert got == {i: f"v{2 if i < 2 else 0}-{i}" for i in range(40)}
    assert store.compacted(spark, path, most=2) == [] and store.compacted(spark, f"{tmp_path}/none") == []
    store.put(results(spark, 1, 9.0, fmt=0), path)
    store.put(results(spark, 1, 9.5, fmt=0), path)
    assert store.count(spark, path) == 40
    store.clear(spark, path)
    assert store.count(spark, path) == 0


def test_prefixes_without_current_entries_are_emptied(spark, tmp_path):
    path = f"{tmp_path}/cache"
    for at in (1.0, 2.0):
        store.put(results(spark, 3, at, fmt=0), path)
    assert len(store.compacted(spark, path, most=1)) >= 1
    assert store.files_by_prefix(spark, path) == {}


def test_reading_through_appends_what_was_read(spark, tmp_path):
    path = f"{tmp_path}/cache"
    engine = cascade.Engine("a", "A", lambda page: {"text": f"read {page['page_number']}", "seconds": 2.0}, model="m", options={"prompt": "p"})
    pages = spark.range(1, 9).select(F.lit("d").alias("doc"), F.col("id").alias("page_number"), F.concat(F.lit("img"), (F.col("id") % 6).cast("string")).cast("binary").alias("image"))
    first, stats = store.read_through(pages.filter("page_number <= 3"), path, engine, 1, now=1.0)
    assert first.count() == 3 and stats.first()["misses"] == 3 and store.count(spark, path) == 3
    then, stats = store.read_through(pages, path, engine, 1, now=2.0)
    assert {r["page_number"]: r["text"] for r in then.collect()} == {n: f"read {n if n <= 6 else n - 6}" if n <= 3 or n >= 7 else f"read {n}" for n in range(1, 9)}
    row = stats.first()
    assert (row["hits"], row["misses"], row["seconds_saved"]) == (5, 3, 10.0) and store.count(spark, path) == 6
    free = cascade.Engine("text_layer", "T", lambda page: {"text": "x"})
    assert store.read_through(pages, path, free, 0, now=3.0)[0].count() == 8 and store.count(spark, path) == 6
    assert cache.count(store.entries(spark, path)) == 6
