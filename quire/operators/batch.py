"""Batch jobs: reconciling a folder with a checkpoint, state changes, progress, output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATES = ("queued", "processing", "retrying", "completed", "review_required", "failed", "cancelled")
FINISHED = ("completed", "review_required", "failed", "cancelled")
SCHEMA = "source string, state string, pages bigint, pages_via_model bigint, pages_flagged bigint, seconds double, attempts int, error string, output string, finished_at timestamp"


def is_finished(state: str | Column = "state") -> Column:
    return (F.col(state) if isinstance(state, str) else state).isin(*FINISHED)


def reconciled(files: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Jobs of the files that are there: known ones as they were, new ones queued; jobs of missing files go."""
    known = checkpoint.withColumn("__known", F.lit(True))
    df = files.select("source").distinct().join(known, "source", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("pages", "pages_via_model", "pages_flagged", "seconds", "attempts") if c in df.columns}
    return df.withColumn("state", F.coalesce("state", F.lit("queued"))).withColumns(zero).drop("__known")


def pending(jobs: DataFrame) -> DataFrame:
    return jobs.filter(~is_finished())


def progress(jobs: DataFrame, *keys: str) -> DataFrame:
    """Counts of every state, pages done, pages a minute and seconds left (null before there is a rate)."""
    done = is_finished()
    counts = [F.count_if(F.col("state") == s).alias(s) for s in STATES]
    df = jobs.groupBy(*keys).agg(
        F.count("*").alias("documents_total"), F.count_if(done).alias("documents_completed"), *counts,
        F.coalesce(F.sum(F.when(done, F.col("pages"))), F.lit(0)).alias("pages_completed"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("elapsed_seconds"),
        F.count_if(~done).alias("__left"), F.count_if(done & (F.col("pages") > 0)).alias("__n"), F.sum(F.when(done & (F.col("pages") > 0), F.col("seconds"))).alias("__s"),
    )
    rate = F.when((F.col("elapsed_seconds") > 0) & (F.col("pages_completed") > 0), F.col("pages_completed") / F.col("elapsed_seconds") * 60)
    left = F.when((F.col("__n") > 0) & (F.col("__left") > 0), F.col("__s") / F.col("__n") * F.col("__left"))
    return df.withColumn("pages_per_minute", rate).withColumn("remaining_seconds", left).drop("__left", "__n", "__s")


def next_state(load_error: Column, run_error: Column, flagged: Column, attempts: Column, max_attempts: int = 2) -> Column:
    """A job's state after an attempt: load errors are final, run errors are tried again, flagged pages ask for review."""
    return (
        F.when(load_error.isNotNull(), "failed")
        .when(run_error.isNotNull(), F.when(attempts >= max_attempts, "failed").otherwise("retrying"))
        .when(flagged > 0, "review_required")
        .otherwise("completed")
    )


def started_state(attempts: Column) -> Column:
    """The state of a job whose attempt of this number begins."""
    return F.when(attempts <= 1, "processing").otherwise("retrying")


def output_names(sources: DataFrame, extension: str = "txt") -> DataFrame:
    """``output``: stem.ext, and stem_1.ext, stem_2.ext for further sources of that stem, by source."""
    file = F.element_at(F.split("source", "/"), -1)
    stem = F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")
    n = F.row_number().over(Window.partitionBy("__stem").orderBy("source")) - 1
    df = sources.withColumn("__stem", stem).withColumn("__n", n)
    return df.withColumn("output", F.concat("__stem", F.when(F.col("__n") > 0, F.concat(F.lit("_"), F.col("__n").cast("string"))).otherwise(""), F.lit(f".{extension}"))).drop("__stem", "__n")


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save(jobs: DataFrame, path: str) -> None:
    """Keep the state of all jobs under ``path``; a reader sees the state before or this one, never a part.

    Every save is a table of its own, complete once Spark has marked it so; older ones go after that.
    """
    spark = jobs.sparkSession
    fs, root = _folder(spark, path)
    before = [f.getPath() for f in fs.listStatus(root)] if fs.exists(root) else []
    last = max((int(p.getName()) for p in before if p.getName().isdigit()), default=0)
    jobs.write.parquet(f"{path}/{last + 1:020d}")
    for p in before:
        fs.delete(p, True)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The last complete state under ``path``; None if there is none or it can't be read, so that a batch begins anew."""
    fs, root = _folder(spark, path)
    if not fs.exists(root):
        return None
    complete = [p.getName() for p in (f.getPath() for f in fs.listStatus(root)) if p.getName().isdigit() and fs.exists(_folder(spark, f"{path}/{p.getName()}/_SUCCESS")[1])]
    if not complete:
        return None
    found = spark.read.schema(SCHEMA).parquet(f"{path}/{max(complete)}")
    try:
        found.agg(F.count("source"), F.max("state")).collect()
    except Exception:  # noqa: BLE001 - whatever is wrong with it, it is no checkpoint
        return None
    return found


def enough_memory(available_mb: float | None, least_mb: float) -> bool:
    """Whether the next document may start; memory that can't be observed never blocks."""
    return available_mb is None or available_mb >= least_mb


def elapsed_text(seconds: str | Column) -> Column:
    c = F.floor(F.col(seconds) if isinstance(seconds, str) else seconds).cast("bigint")
    h, m, s = F.floor(c / 3600), F.floor(c % 3600 / 60), c % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (
        F.when(c.isNull(), "n/a")
        .when(h > 0, F.concat(h.cast("string"), F.lit("h "), two(m), F.lit("m")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), two(s), F.lit("s")))
        .otherwise(F.concat(s.cast("string"), F.lit("s")))
    )
