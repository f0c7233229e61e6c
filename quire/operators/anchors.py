"""Line alignment of documents of any length: lines are rows, and only short stretches meet a matcher.

difflib takes the longest equal run of two texts, then does the same before and after it. A line that
both texts have exactly once is an anchor. A run of anchors, side by side in both, is taken whole,
with the equal lines round it, if

* no other anchor crosses it,
* the equal lines round it are not also such of a neighbouring run, and
* it is longer than every stretch of common lines without an anchor: whatever run is longer holds an
  anchor too, and so can neither overlap nor cross it.

Such runs are separators. What lies between two of them is aligned as if it stood alone, and long
stretches are searched for separators again, with the lines that are unique there.

Everything about lines is done with rows of (document, place, digest): counts, joins, and running
values by ranges, so no task holds a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import align
from quire.operators.ranks import dealt, joined, numbered, running
from quire.session import ship
from quire.shared import drop, keep, scratch, written

#: Lines of both sides up to which a stretch is matched at once, and beyond which one without separators is cut by place.
AT_ONCE, CUT = 2_000, 20_000


def _placed(lines: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    # a filter is evaluated with its line before the line is, and dealing out by ranges reads its input twice: lines are made once before
    with scratch(lines.sparkSession) as made:
        df = written(lines.select(*keys, *order, "line"), "made").filter(F.col("line").isNotNull() & (F.col("line") != ""))
        out = written(numbered(df, keys, [F.col(c).asc_nulls_first() for c in order], name, 0).select(*keys, name, "line", F.unhex(F.md5("line")).alias("digest")), "lines")
        keep(made, out)
    return out


def _round_it(a: DataFrame, b: DataFrame, anchors: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``i``, ``r``; ``i``, ``l``): equal lines right after and right before an anchor's, up to the next anchor; anchors without any may lack."""
    marked = joined(a.select(*keys, "i", "digest"), anchors.select(*keys, "i", "j"), [*keys, "i"], "left")
    held = F.when(F.col("j").isNotNull(), F.col("i"))
    rows = running(dealt(marked, keys, [F.col("i")]), keys, [F.col("i")], {"before": ("max", held, False), "after": ("min", held, True)})
    plain = written(rows.filter("j is null").select(*keys, "i", "digest", "before", "after"), "plain")

    def side(of: str) -> DataFrame:
        shift = anchors.select(*keys, F.col("i").alias(of), (F.col("j") - F.col("i")).alias("shift"))
        rows = joined(plain.filter(F.col(of).isNotNull()), shift, [*keys, of]).withColumn("j", F.col("i") + F.col("shift"))
        rows = joined(rows, b.select(*keys, "j", F.col("digest").alias("theirs")), [*keys, "j"], "left")
        return rows.withColumn("other", F.when(~F.coalesce(F.col("digest") == F.col("theirs"), F.lit(False)), F.col("i"))).groupBy(*keys, of)

    right = side("before").agg((F.coalesce(F.min("other"), F.max("i") + 1) - F.col("before") - 1).alias("r")).withColumnRenamed("before", "i")
    left = side("after").agg((F.col("after") - 1 - F.coalesce(F.max("other"), F.min("i") - 1)).alias("l")).withColumnRenamed("after", "i")
    return right, left


def separators(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``i0``, ``i1``, ``j0``, ``j1``: first and last lines of the separators of the stretches (``keys``) of a (i, digest) and b (j, digest)."""
    ours = a.groupBy(*keys, "digest").agg(F.count("*").alias("n_a"), F.min("i").alias("i"))
    theirs = b.groupBy(*keys, "digest").agg(F.count("*").alias("n_b"), F.min("j").alias("j"))
    common = written(joined(ours, theirs, [*keys, "digest"]), "common")
    once = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    anchors = written(common.filter(once).select(*keys, "i", "j"), "anchors")
    # an anchor starts a run if the lines before are not an anchor; none crosses it if all before it lie before it in b too, and all after it after
    last = anchors.select(*keys, (F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("last"))
    starting = joined(anchors, last, [*keys, "i"], "left").withColumn("starts", ~F.col("j").eqNullSafe(F.col("last"))).drop("last")
    line = running(
        dealt(starting, keys, [F.col("i")]), keys, [F.col("i")], {"top": ("max", F.col("j"), False), "low": ("min", F.col("j"), True), "core": ("sum", F.when(F.col("starts"), 1).otherwise(0), False)}
    )
    cores = line.groupBy(*keys, "core").agg(F.min("i").alias("h"), F.max("i").alias("t"), F.min("j").alias("jh"), F.max("j").alias("jt"), F.bool_and((F.col("top") == F.col("j")) & (F.col("low") == F.col("j"))).alias("straight"))
    right, left = _round_it(a, b, anchors, keys)
    cores = joined(cores, right.withColumnRenamed("i", "t"), [*keys, "t"], "left")
    cores = joined(cores, left.withColumnRenamed("i", "h"), [*keys, "h"], "left").fillna(0, ["l", "r"])
    cores = written(numbered(cores, keys, [F.col("jh")], "core_b"), "cores")

    def contested(number: str, head: str, tail: str) -> DataFrame:
        after = cores.select(*keys, (F.col(number) - 1).alias(number), F.col("core").alias("other"), (F.col(head) - F.col("l")).alias("reach"))
        both = joined(cores, after, [*keys, number]).filter(F.col(tail) + F.col("r") >= F.col("reach"))
        return both.select(*keys, F.explode(F.array("core", "other")).alias("core"))

    bad = contested("core", "h", "t").unionByName(contested("core_b", "jh", "jt")).distinct()
    # common lines without an anchor, side by side
    repeated = joined(a.select(*keys, "i", "digest"), common.filter(~once).select(*keys, "digest"), [*keys, "digest"], "left_semi")
    repeated = numbered(repeated.select(*keys, "i"), keys, [F.col("i")], "no")
    most = repeated.groupBy(*keys, (F.col("i") - F.col("no")).alias("run")).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("most"))
    safe = joined(joined(cores.filter("straight"), bad, [*keys, "core"], "left_anti"), most, keys, "left")
    safe = safe.filter(F.col("t") - F.col("h") + 1 + F.col("l") + F.col("r") > F.coalesce("most", F.lit(0)))
    return safe.select(*keys, (F.col("h") - F.col("l")).alias("i0"), (F.col("t") + F.col("r")).alias("i1"), (F.col("jh") - F.col("l")).alias("j0"), (F.col("jt") + F.col("r")).alias("j1"))


def _stretched(lines: DataFrame, found: DataFrame | None, keys: list[str], at: str) -> DataFrame:
    """``lines`` with ``seg``, the number of separators that start up to the line, and ``part_of``, whether it belongs to one."""
    if found is None:
        return lines.withColumn("seg", F.lit(0).cast("long")).withColumn("part_of", F.lit(False))
    marked = joined(lines, found.select(*keys, F.col(f"{at}0").alias(at), F.col(f"{at}1").alias("end")), [*keys, at], "left")
    rows = running(dealt(marked, keys, [F.col(at)]), keys, [F.col(at)], {"seg": ("count", F.col("end"), False), "reach": ("max", F.col("end"), False)})
    return rows.withColumn("part_of", F.coalesce(F.col(at) <= F.col("reach"), F.lit(False))).drop("end", "reach")


def _sizes(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of both sides of each stretch that both have, separators left out."""
    n = lambda df, name, at: df.filter("not part_of").groupBy(*keys, "seg").agg(F.count("*").alias(f"n_{name}"), F.min(at).alias(f"{name}0"))
    return joined(n(a, "a", "i"), n(b, "b", "j"), [*keys, "seg"]).withColumn("n", F.col("n_a") + F.col("n_b"))


def aligned(a: DataFrame, b: DataFrame, *keys: str, order: tuple[str, ...] = ("line_no",), threshold: float = 0.55, at_once: int = AT_ONCE, cut: int = CUT) -> DataFrame:
    """``row_no``, ``kind``, ``text_a``, ``text_b``, ``similarity`` of the aligned lines of each document.

    ``a`` and ``b`` have a row per normalised ``line``, ordered within ``keys`` by ``order``; null
    and empty lines don't count. The rows are those of ``compare.diff_lines``, except that a stretch
    of more than ``cut`` lines of both sides without any separator is cut into pieces by place, as
    changed blocks of many lines are paired by place. A document that one side lacks has only lines
    of the other. Tables on the way go as soon as nothing reads them again; the rows' own stays.
    """
    spark = a.sparkSession
    ship(spark)
    names = list(keys)
    with scratch(spark) as made:
        rows = _rows(a, b, names, order, threshold, at_once, cut)
        before = len(made)
        placed = numbered(rows, names, [F.col(c) for c in ("seg", "after", "piece", "pos")], "row_no", 0)
        del made[before:]
    return placed.select(*names, "row_no", "kind", "text_a", "text_b", "similarity")


def _rows(a: DataFrame, b: DataFrame, names: list[str], order: tuple[str, ...], threshold: float, at_once: int, cut: int) -> DataFrame:
    """The rows of ``aligned`` with what orders them."""
    spark = a.sparkSession
    ours, theirs = _placed(a, names, list(order), "i"), _placed(b, names, list(order), "j")
    thin_a, thin_b = _stretched(ours.drop("line"), None, names, "i"), _stretched(theirs.drop("line"), None, names, "j")
    found, segment = None, [*names, "seg"]
    stuck = None
    while True:
        sizes = written(_sizes(thin_a, thin_b, names), "sizes")
        large = sizes.filter(F.col("n") > at_once)
        if stuck is not None:  # a stretch is known by its first lines
            large = joined(large, stuck, [*names, "a0", "b0", "n"], "left_anti")
        if large.isEmpty():
            break
        large = written(large, "large")
        which = large.select(*segment)
        with scratch(spark) as made:
            new = separators(*(joined(df.filter("not part_of"), which, segment, "left_semi") for df in (thin_a, thin_b)), segment)
            new = written(new, "separators")
            keep(made, new)
        still = joined(large, new.select(*segment).distinct(), segment, "left_anti").select(*names, "a0", "b0", "n")
        stuck = written(still if stuck is None else stuck.unionByName(still), "stuck")
        if new.isEmpty():
            break
        new = new.drop("seg")
        found = new if found is None else written(found.unionByName(new), "separators")
        drop(thin_a, thin_b, sizes, large)
        with scratch(spark) as made:
            thin_a, thin_b = (written(_stretched(df.drop("line"), found, names, at), "stretches") for df, at in ((ours, "i"), (theirs, "j")))
            keep(made, thin_a, thin_b)
    # pieces of what is still too long
    piece = [*segment, "piece"]
    beyond = sizes.filter(F.col("n") > cut).select(*segment, "a0", "b0")

    def pieces(thin: DataFrame, lines: DataFrame, at: str, start: str) -> DataFrame:
        between = joined(thin.filter("not part_of").select(*segment, at), beyond.select(*segment, start), segment, "left")
        between = between.select(*segment, at, F.coalesce(F.floor((F.col(at) - F.col(start)) / (at_once // 2)), F.lit(0)).cast("long").alias("piece"))
        return written(joined(between, lines.select(*names, at, "line"), [*names, at]), "pieces")

    left, right = pieces(thin_a, ours, "i", "a0"), pieces(thin_b, theirs, "j", "b0")
    both = written(joined(left.select(*piece).distinct(), right.select(*piece).distinct(), piece, "left_semi"), "both")

    def gathered(df: DataFrame, at: str, name: str) -> DataFrame:
        held = F.array_sort(F.collect_list(F.struct(at, "line")))
        return joined(df, both, piece, "left_semi").groupBy(*piece).agg(F.transform(held, lambda x: x["line"]).alias(name))

    pairs = joined(gathered(left, "i", "__a"), gathered(right, "j", "__b"), piece)
    matched = pairs.select(*piece, align.diff("__a", "__b", threshold).alias("d")).select(*piece, F.posexplode("d").alias("pos", "d"))
    rows = matched.select(*piece, F.lit(1).alias("after"), F.col("pos").cast("long").alias("pos"), "d.kind", "d.text_a", "d.text_b", "d.similarity")
    for df, at, kind in ((left, "i", "only_a"), (right, "j", "only_b")):
        texts = (F.col("line"), F.lit("")) if kind == "only_a" else (F.lit(""), F.col("line"))
        alone = joined(df, both, piece, "left_anti")
        rows = rows.unionByName(alone.select(*piece, F.lit(1).alias("after"), F.col(at).alias("pos"), F.lit(kind).alias("kind"), texts[0].alias("text_a"), texts[1].alias("text_b"), F.lit(0.0).alias("similarity")))
    if found is not None:
        equal = joined(thin_a.filter("part_of").select(*segment, "i"), ours.select(*names, "i", "line"), [*names, "i"])
        rows = rows.unionByName(equal.select(*segment, F.lit(0).cast("long").alias("piece"), F.lit(0).alias("after"), F.col("i").alias("pos"), F.lit("equal").alias("kind"), F.col("line").alias("text_a"), F.col("line").alias("text_b"), F.lit(1.0).alias("similarity")))
    return rows
