"""What review screens show of routes and comparisons, as tables: labelled pages, flagged diff rows, conflict lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.compare import is_conflict, with_numbers

#: Label and kind of each page class.
CLASS_LABELS = {
    "text_layer": ("From the document's own text", "ok"),
    "blank": ("Blank", "neutral"),
    "duplicate": ("Identical to an earlier page", "neutral"),
    "needs_ocr": ("Read by an engine", "info"),
}
#: Diff rows, and conflicts, that a screen shows of a comparison.
ROWS_SHOWN, CONFLICTS_SHOWN = 400, 100


def page_list(routes: DataFrame) -> DataFrame:
    """``doc``, ``page_number``, ``reason``, ``label``, ``kind`` of every routed page; unknown classes say so."""
    label = F.create_map(*(F.lit(x) for k, (text, _) in CLASS_LABELS.items() for x in (k, text)))
    kind = F.create_map(*(F.lit(x) for k, (_, kind) in CLASS_LABELS.items() for x in (k, kind)))
    c = F.col("page_class")
    return routes.select("doc", "page_number", F.col("route_reason").alias("reason"), F.coalesce(label[c], F.lit("Unknown")).alias("label"), F.coalesce(kind[c], F.lit("neutral")).alias("kind"))


def diff_view(rows: DataFrame, conflicts: DataFrame | None, *keys: str, limit: int = ROWS_SHOWN) -> DataFrame:
    """The first ``limit`` diff rows of each comparison (0: all) with ``style`` and ``total``, the number of all rows.

    A row is ``numeric`` if its two texts are those of some conflict of the comparison, else styled by
    its kind. Without ``conflicts`` they are those of ``rows``, which tell them by themselves.
    """
    w = Window.partitionBy(*keys)
    df = rows.withColumn("total", F.count("*").over(w)).withColumn("__n", F.row_number().over(w.orderBy("row_no")))
    df = df.filter(F.col("__n") <= limit) if limit > 0 else df
    if conflicts is None:
        df = df.withColumn("__numeric", is_conflict())
    else:
        df = df.join(conflicts.select(*keys, "text_a", "text_b", F.lit(True).alias("__numeric")).distinct(), [*keys, "text_a", "text_b"], "left")
    style = F.when(F.col("__numeric"), "numeric").when(F.col("kind") == "equal", "").otherwise(F.replace("kind", F.lit("_"), F.lit("-")))
    return df.withColumn("style", style).drop("__n", "__numeric")


def shown_conflicts(rows: DataFrame, conflicts: DataFrame | None, *keys: str, limit: int = CONFLICTS_SHOWN) -> DataFrame:
    """Conflicts worth a list of their own: only where a comparison has other disagreements besides; the first ``limit``.

    Without ``conflicts`` they are those of ``rows``, which are read once.
    """
    w = Window.partitionBy(*keys)
    if conflicts is None:
        df = rows.filter("kind <> 'equal'").withColumn("__is", is_conflict())
        df = with_numbers(df.withColumn("__d", F.count("*").over(w)).withColumn("__c", F.count_if("__is").over(w)).filter("__is").drop("__is"))
        df = df.withColumn("__n", F.row_number().over(w.orderBy("row_no")))
    else:
        differing = rows.filter("kind <> 'equal'").groupBy(*keys).agg(F.count("*").alias("__d"))
        df = conflicts.withColumn("__c", F.count("*").over(w)).withColumn("__n", F.row_number().over(w.orderBy("row_no"))).join(differing, list(keys))
    return df.filter((F.col("__d") > F.col("__c")) & (F.col("__n") <= limit)).drop("__c", "__d", "__n")
