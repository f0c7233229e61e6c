"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

1. Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share the size
   of the whole; a target stops at ``cap`` times its source's size and the excess is shared again.
2. Blocks: each source's documents are shuffled by a seeded hash, laid end to end and cut into
   blocks of about equal numbers of words.
3. Schedule: slot i of the mix draws the point frac((i + 1/2) * golden ratio); cumulative weights
   map it to a source. The k-th slot of a source takes that source's k-th block, round and round,
   until its target is met: slots beyond it are left, slots that the draw fell short of stand at the
   schedule's end, and the last one takes a part of its block. So each source gets its target to the
   word, however small it is.
4. A document's share is what the schedule takes of the blocks that it lies in.

The numbers of slots and blocks are bounded by ``slots``, and one for each source, whatever the input
is; a block grows with the input instead. No step gathers a source or all sources in one task:
sources are ranked and summed up by ranges, and documents are ordered within (source, hash range)
buckets, whose totals give each its start.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, fresh_name, written
from quire.operators import ranks

#: Slots of the schedule, about; also the bound on all sources' blocks (plus one for each source).
SLOTS = 1 << 17
#: Documents of all sources that a hash range holds, about.
BUCKET_ROWS = 2048
#: Cells of the grid on which slots meet the sources' intervals, and slots that one task ranks.
GRID, RANKED = 4096, 1024
GOLDEN = (math.sqrt(5) - 1) / 2


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size``: words of the text (null: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per source: ``source``, ``source_no``, ``source_size``, ``weight``, ``target``.

    Water filling in closed form: with sources by cap/weight ascending, the first k are capped for
    the smallest k whose level (total - capped) / (other weights) lies within the next cap/weight.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1).cast("int"))
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = ranks.numbered(each, [], [F.col("source").asc_nulls_last()], "source_no").withColumn("weight", w)
    order = [F.col("source_size") / F.col("weight"), F.col("source_no")]
    table = ranks.dealt(each, [], order)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    each = ranks.running(table, [], order, {"upto": ("sum", F.col("source_size") * cap, False), "left": ("sum", F.col("weight"), True)})
    each = each.withColumn("level", (F.lit(total) - F.col("upto") + F.col("source_size") * cap) / F.col("left"))
    # the first source, in this order, that the level reached so far doesn't fill
    each = written(each.withColumn("open", F.col("level") * F.col("weight") <= F.col("source_size") * cap), "levels")
    final = each.agg(F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "source_no", "level")))["level"]).first()[0]
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.lit(final) * F.col("weight"))
    return each.select("source", "source_no", "source_size", "weight", F.when(F.col("source_size") > 0, target).otherwise(0.0).alias("target"))


def schedule(sources: DataFrame, slots: int = SLOTS, cap: int = 3) -> DataFrame:
    """One row per block that the mix takes: ``source_no``, ``block``, ``times``, ``part``, the words of it that the source's last slot takes beside.

    ``sources`` needs source_no, source_size, blocks and target.
    """
    spark = sources.sparkSession
    parts = sources.filter("source_size > 0 and target > 0").withColumn("words", F.least(F.round("target").cast("long"), F.col("source_size") * cap))
    # slots that a source needs, the last perhaps in part; needs are added up as whole numbers, so that intervals meet
    last = F.expr("(words - 1) % source_size * blocks div source_size + (words - 1) div source_size * blocks")
    parts = parts.filter("words > 0").withColumn("last", last).withColumn("need", F.round(F.col("words") * F.col("blocks") / F.col("source_size") * 1000).cast("long"))
    parts = written(ranks.running(ranks.dealt(parts, [], [F.col("source_no")]), [], [F.col("source_no")], {"upto": ("sum", F.col("need"), False)}), "needs")
    every = parts.agg(F.sum("need"), F.sum(F.col("last") + 1)).first()
    total, n_slots = every[0] or 1, every[1] or 0
    hi = F.when(F.col("upto") == total, F.lit(2.0)).otherwise(F.col("upto") / F.lit(total))
    parts = parts.withColumn("hi", hi).withColumn("lo", (F.col("upto") - F.col("need")) / F.lit(total))
    cells = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID))))).select("source_no", "lo", "hi", "cell")
    # needs add up to the blocks' number on the whole mix, at most `slots` + one for each source
    point = F.pmod((F.col("id") + 0.5) * F.lit(GOLDEN), F.lit(1.0))
    drawn = spark.range(0, n_slots).withColumn("u", point).withColumn("cell", F.floor(F.col("u") * GRID))
    drawn = drawn.join(cells, "cell").filter("u >= lo and u < hi").select("id", "source_no", (F.col("id") / RANKED).cast("long").alias("run"))
    runs = written(drawn.groupBy("source_no", "run").agg(F.count("*").alias("n")), "runs")
    runs = ranks.running(ranks.dealt(runs, ["source_no"], [F.col("run")]), ["source_no"], [F.col("run")], {"upto": ("sum", F.col("n"), False)})
    rank = F.col("upto") - F.col("n") + F.row_number().over(Window.partitionBy("source_no", "run").orderBy("id")) - 1
    ranked = drawn.join(runs, ["source_no", "run"]).select("source_no", rank.alias("rank"))
    # what the draw fell short of, at the schedule's end
    short = parts.join(runs.groupBy("source_no").agg(F.sum("n").alias("drawn")), "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    short = short.filter(F.col("drawn") <= F.col("last")).select("source_no", F.explode(F.sequence("drawn", "last")).alias("rank"))
    slot = ranked.unionByName(short).join(parts.select("source_no", "source_size", "blocks", "words", "last"), "source_no").filter("rank <= last")
    slot = slot.withColumn("block", F.pmod("rank", "blocks"))
    begins = F.expr("rank div blocks * source_size + (block * source_size + blocks - 1) div blocks")
    ends = F.expr("rank div blocks * source_size + ((block + 1) * source_size + blocks - 1) div blocks")
    whole = (F.col("rank") < F.col("last")) | (ends <= F.col("words"))
    return slot.groupBy("source_no", "block").agg(F.count_if(whole).alias("times"), F.coalesce(F.sum(F.when(~whole, F.col("words") - begins)), F.lit(0)).alias("part"))


def mix(docs: DataFrame, *, text: str = "text", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, slots: int = SLOTS, seed: int = 5, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` for every row of ``docs``.

    ``taken`` counts the words that the mix takes from the row, repeats counted: between 0 and
    ``cap`` times its size, the same on every run. A null text has size 0; a null source is a
    source of its own, last in order; repeated rows are laid out one after the other and each
    taken on its own; an empty table gives an empty result. Other columns are ignored.
    """
    # the text's hash keeps rows that share an id, or have none, from falling on one place
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64(F.col(text)))
    sized = written(sizes(docs.select("doc_id", "source", F.col(text).alias("text"))).select("doc_id", "source", "size", h.alias("h")), "sizes")
    total = sized.agg(F.count("*"), F.sum("size")).first()
    bits = max(0, math.ceil(math.log2(max(1, total[0] / bucket_rows))))
    per_block = max(1, -(-(total[1] or 0) // slots))
    blocks = F.ceil(F.col("source_size") / F.lit(per_block)).cast("long")
    sources = written(source_targets(sized, weights, cap).withColumn("blocks", blocks), "sources")
    taken = schedule(sources, slots, cap)

    bucket = F.shiftrightunsigned("h", 64 - bits).cast("long") if bits else F.lit(0).cast("long")
    keyed = sized.withColumn("bucket", bucket)
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    starts = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    starts = starts.withColumn("start", F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n"))
    # the null source joins through a value that no source has
    named = lambda df: df.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    laid = keyed.withColumn("at", F.sum("size").over(inside) - F.col("size")).withColumn("no", F.row_number().over(inside))
    laid = named(laid).join(named(starts).select("source_key", "bucket", "start"), ["source_key", "bucket"])
    laid = laid.join(named(sources).drop("source"), "source_key").withColumn("at", F.col("at") + F.col("start"))
    number = lambda p: F.expr(f"({p}) * blocks div source_size")
    edge = lambda b: F.expr(f"(({b}) * source_size + blocks - 1) div blocks")
    pieces = laid.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(number("at"), number("at + size - 1")))))
    pieces = pieces.join(taken, ["source_no", "block"], "left")
    within = lambda end: F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), end) - F.greatest("at", edge("block")))
    words = within(edge("block + 1")) * F.col("times") + within(edge("block") + F.col("part"))
    row = ["source_key", "bucket", "no"]
    out = pieces.groupBy(*row).agg(
        *(F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")), F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("taken")
    )
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: taken / size rounded half up, all columns kept.

    Texts are not cut, so a document that the schedule takes half of or more is there whole. Rows
    that repeat a doc_id are mixed as what they are, but all of them get the largest number of
    copies among them.
    """
    name = fresh_name(docs, "copies")
    copies = mix(docs, **options).groupBy("doc_id").agg(F.max(F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)).alias(name))
    out = docs.join(copies.filter(F.col(name) > 0), docs["doc_id"].eqNullSafe(copies["doc_id"])).select(*(docs[c] for c in docs.columns), name)
    return out.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name).cast("int")))).drop(name)
