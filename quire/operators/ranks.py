"""Places and running values within groups of any size.

A window over a group puts it into one task. Here rows are dealt out by ranges of (group, order); a
window works within a range's part of a group, and what each part adds up to gives the next its
start. A group is spread over as many tasks as it fills.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.shared import written

PART = "__part"


def dealt(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` as a table dealt out by ranges, with the range's number in PART; equal rows lie in one range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, null like any value."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys``, null like any value; the keys come from ``left``."""
    named = right.select(*(F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys))
    return left.join(named, on, how).drop(*(f"__r_{k}" for k in keys))


def running(table: DataFrame, keys: list[str], order: list[Column], values: dict[str, tuple[str, Column, bool]]) -> DataFrame:
    """A ``dealt`` table with running values; each is (sum, count, min or max; a column; whether backwards), the row itself included.

    Backwards, ``order`` must be plain columns, whose rows it puts in one order only.
    """
    of = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    sums = table.groupBy(*keys, PART).agg(*(of[kind](c).alias(name) for name, (kind, c, _) in values.items()))
    line = Window.partitionBy(*keys)

    def beyond(name: str, kind: str, back: bool) -> Column:
        w = line.orderBy(F.col(PART).desc() if back else F.col(PART).asc()).rowsBetween(Window.unboundedPreceding, -1)
        return of["sum" if kind == "count" else kind](name).over(w).alias(f"__b_{name}")

    starts = sums.select(*keys, PART, *(beyond(name, kind, back) for name, (kind, _, back) in values.items()))
    inside = Window.partitionBy(*keys, PART)
    turned = [F.col(c) if isinstance(c, str) else c for c in order]

    def within(kind: str, c: Column, back: bool) -> Column:
        # backwards is forwards in the opposite order: a frame that ends with the last row is added up anew for every row
        w = inside.orderBy(*([F.expr("1")] if not turned else [x.desc() for x in turned] if back else turned))
        return of[kind](c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    found = table.select("*", *(within(kind, c, back).alias(f"__w_{name}") for name, (kind, c, back) in values.items()))
    both = joined(found, starts, [*keys, PART])

    def total(name: str, kind: str) -> Column:
        own, before = F.col(f"__w_{name}"), F.col(f"__b_{name}")
        if kind in ("sum", "count"):
            return F.coalesce(own, F.lit(0)) + F.coalesce(before, F.lit(0))
        return F.least(own, before) if kind == "min" else F.greatest(own, before)

    kept = [c for c in table.columns if c != PART]
    return both.select(*kept, *(total(name, kind).alias(name) for name, (kind, _, _) in values.items()))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str, first: int = 1) -> DataFrame:
    """``df`` with each row's place within its group, from ``first`` on, in ``order``."""
    rows = running(dealt(df, keys, order), keys, order, {name: ("count", F.lit(1), False)})
    return rows.withColumn(name, (F.col(name) - 1 + first).cast("long"))
