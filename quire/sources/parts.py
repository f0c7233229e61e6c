"""Texts of documents of any length in bounded parts, in order.

A document's pages are never brought together in one row. Running byte counts over ranges of
(document, page) say which part a page lies in; only the pages of one part meet. The parts of a
document, joined by blank lines, are its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import ranks

#: Bytes of page texts after which a new part begins.
PART_BYTES = 8 << 20


def placed(pages: DataFrame, *keys: str, part_bytes: int = PART_BYTES, text: str = "text") -> DataFrame:
    """The pages with text, and ``part`` (from 0), ``first`` and ``last`` (whether it begins or ends its document).

    A page lies in the part in which its first byte falls, so a part has at most ``part_bytes`` and
    one page. Null and empty texts don't count; pages of one number are ordered by text; null keys
    are a document of their own.
    """
    some = pages.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(*keys, "page_number", text, F.octet_length(text).cast("long").alias("__size"))
    # ranges are cut by page numbers alone: cutting by text would bring a sample of texts to the driver
    table = ranks.dealt(some, list(keys), [F.col("page_number")])
    size = F.col("__size")
    rows = ranks.running(table, list(keys), [F.col("page_number"), F.col(text)], {"__end": ("sum", size, False), "__all": ("count", F.lit(1), False), "__left": ("count", F.lit(1), True)})
    before = F.col("__end") - size
    return rows.select(*keys, "page_number", text, F.floor(before / part_bytes).cast("long").alias("part"), (F.col("__all") == 1).alias("first"), (F.col("__left") == 1).alias("last"), size.alias("bytes"))


def joined_parts(pages: DataFrame, *keys: str, part_bytes: int = PART_BYTES, text: str = "text", trim: bool = False) -> DataFrame:
    """``part``, ``pages``, ``bytes``, ``last`` and ``text`` of each part; with ``trim`` a document begins and ends without white space."""
    rows = placed(pages, *keys, part_bytes=part_bytes, text=text)
    if trim:
        head = F.when(F.col("first"), F.regexp_replace(text, rf"\A{T.SPACE}+", "")).otherwise(F.col(text))
        rows = rows.withColumn(text, head)
        rows = rows.withColumn(text, F.when(F.col("last"), F.regexp_replace(text, rf"{T.SPACE}+\z", "")).otherwise(F.col(text)))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", text)))
    return rows.groupBy(*keys, "part").agg(F.count("*").alias("pages"), F.sum("bytes").alias("bytes"), F.bool_or("last").alias("last"), F.array_join(F.transform(ordered, lambda p: p[text]), "\n\n").alias("text"))


def write_texts(parts: DataFrame, path: str, *keys: str) -> None:
    """``joined_parts`` as text files ``KEY=.../part=NNNNNN/``; a document's files one after the other are its text and a line end."""
    number = F.format_string("%06d", F.col("part"))
    value = F.when(F.col("last"), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    parts.select(*keys, number.alias("part"), value.alias("value")).write.partitionBy(*keys, "part").text(path)


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows dealt out by ranges of ``order`` and sorted within them: a writer's files, by name, hold them in order."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)
