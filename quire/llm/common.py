"""What several corpus operators share: tables, the shared folder, hashing, small numpy helpers."""

from __future__ import annotations

import ctypes
import gc
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import ship
from quire.shared import forget, shared_dir, work_dir, written

__all__ = ["forget", "shared_dir", "work_dir", "written"]

#: White space of the word rule ``[^\x20\x09-\x0D]+``: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name close to ``wanted`` that ``df`` doesn't have, in any case of letters."""
    held = {c.lower() for c in df.columns}
    name = f"__{wanted}"
    while name.lower() in held:
        name = "_" + name
    return name


#: Settings under which the parser drops what it has learned of a text as soon as it is parsed.
FORGETFUL = {"spark.sql.parser.manageParserCaches": "true", "spark.sql.parser.parserDfaCacheFlushThreshold": "1"}


@contextmanager
def forgetful_parser(spark: SparkSession):
    """Of long texts that are parsed meanwhile, the parser keeps nothing: else some ninety megabytes of the driver's memory for good.

    ``F.expr`` parses nothing; its text is parsed where the column joins a DataFrame, and that must be in here.
    """
    before = {k: spark.conf.get(k, None) for k in FORGETFUL}
    try:
        for k, v in FORGETFUL.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        release(spark)  # parsing leaves the driver's memory full of what nothing refers to


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as decimal text, modulo ``folds``; null ids fall in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


_state: dict = {}


def worker_state(tag: str, make):
    """What this worker process keeps from task to task for one query; the next query's replaces it."""
    if tag not in _state:
        _state.clear()
        gc.collect()
        tidy()
        _state[tag] = make()
    return _state[tag]


def slices(texts, rows: int, size: int = 1 << 20):
    """(begin, length) of consecutive parts of an Arrow column of texts: up to ``rows`` texts and about ``size`` bytes each, one text at least."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = lengths.cumsum()
    lo = 0
    while lo < len(lengths):
        before = ends[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(ends.searchsorted(before + size, side="right"))))
        yield lo, hi - lo
        lo = hi


def tidy() -> None:
    """Give memory that a batch needed and no longer needs back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def tasks(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def plain_plans(spark: SparkSession):
    """Queries planned meanwhile are not compiled into code of their own.

    A join of many rounds has many plans of narrow rows; the driver, which compiles each of them,
    keeps the classes, some megabytes a plan.
    """
    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim_driver(spark: SparkSession) -> bool:
    """Let the driver's JVM give what it has freed outside its heap back to the machine, as ``tidy`` does for Python; False where it can't.

    Compiling and parsing leave a hundred megabytes and more with the C library, which keeps them.
    """
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    java = jvm.java.lang

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    try:
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        options, kinds = array(java.Object, array(java.String)), array(java.String, "[Ljava.lang.String;")
        # the server's own class is closed to Python, its interface is open
        invoke = java.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(java.Class, bean.getClass(), java.Class.forName("java.lang.String"), options.getClass(), kinds.getClass()))
        invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), array(java.Object, bean, "systemTrimNativeHeap", options, kinds))
    except Py4JError:  # not every JVM has the command
        return False
    return True


def release(spark: SparkSession) -> None:
    """Let the driver collect what it no longer refers to and give it back, so that Spark removes those shuffle files now and not at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)
    tidy()


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing will read again."""
    spark = df.sparkSession
    jvm, paths = spark.sparkContext._jvm, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if f"/quire-{spark.sparkContext.applicationId}/" in path:
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
