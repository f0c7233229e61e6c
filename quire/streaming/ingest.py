"""Resumable batches: new files since the last run, processed once, with their results kept at once."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.batch import enough_memory

class Held(Exception):
    """A stream that was told to stop before a micro-batch; nothing of the batch was begun."""


FILES = "path string, modificationTime timestamp, length bigint, content binary"


def run_new_files(spark: SparkSession, source: str, checkpoint: str, output: str, process: Callable[[DataFrame], DataFrame], *, files_per_batch: int = 1000, pattern: str = "*", gate: Callable[[], str | None] | None = None) -> StreamingQuery:
    """Process files under ``source`` that no earlier run with this checkpoint has finished, then stop.

    ``gate`` is asked before each micro-batch; if it gives a reason, the stream ends there, and the
    files that are left are the next run's.

    Each micro-batch's results are a Parquet table of their own, named by the batch, and written in
    overwrite mode, so a batch that was lost half way is written again and nothing twice.
    """

    def keep(batch: DataFrame, number: int) -> None:
        reason = gate() if gate else None
        if reason:
            raise Held(reason)
        found = batch.selectExpr("path", "content", "length as size_bytes", "modificationTime as modified")
        process(found).write.mode("overwrite").parquet(f"{output}/batch={number}")

    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(source)
    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(query: StreamingQuery) -> str | None:
    """Wait for a stream; the gate's reason if that ended it. Other errors are raised."""
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        held = re.search(rf"{Held.__name__}: ([^\n]*)", str(e))
        if not held:
            raise
        return held[1].strip()
    return None


def gate(spark: SparkSession, control: str | None = None, least_mb: float = 0, available: Callable[[], float | None] | None = None) -> Callable[[], str | None]:
    """A gate that closes once a file stands at ``control``, or while the driver's machine has less free memory than ``least_mb``."""

    def ask() -> str | None:
        if control is not None:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(control)
            if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
                return "cancelled"
        if least_mb and not enough_memory((available or free_memory)(), least_mb):
            return "paused for memory"
        return None

    return ask


def free_memory() -> float | None:
    """Free memory of this machine in MB, or None where it can't be observed."""
    try:
        found = re.search(r"MemAvailable:\s+(\d+) kB", Path("/proc/meminfo").read_text())
    except OSError:
        return None
    return int(found[1]) / 1024 if found else None
