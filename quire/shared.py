"""Tables in the folder that driver and executors share: how a lineage is cut."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session, whose executors are in the driver, gets one of its own that
    goes when Python ends; on a cluster no folder is known to be shared, so that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        found = context._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not (context.master.startswith("local") and "local-cluster" not in context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        context.setCheckpointDir(found)
    return found.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/quire-{spark.sparkContext.applicationId}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for made in getattr(_scopes, "open", ()):
        made.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_table = path
    return out


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession):
    """Tables written meanwhile by this thread go at the end, but those taken from the list that it gives (``keep``)."""
    made: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", ()), made]
    try:
        yield made
    finally:
        _scopes.open = [x for x in _scopes.open if x is not made]
        for path in made:
            _delete(spark, path)
        release(spark)


def keep(made: list[str], *tables: DataFrame) -> None:
    """Leave what ``written`` returned out of a ``scratch``'s list."""
    for t in tables:
        if getattr(t, "_quire_table", None) in made:
            made.remove(t._quire_table)


def drop(*tables: DataFrame | None) -> None:
    """Delete what ``written`` returned, where nothing will read it again."""
    for t in tables:
        if getattr(t, "_quire_table", None):
            _delete(t.sparkSession, t._quire_table)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Have the driver collect what it no longer refers to, so that Spark removes those shuffle files now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(spark: SparkSession) -> None:
    """Delete all tables that this application has written; results that still read them are lost."""
    _delete(spark, work_dir(spark))
