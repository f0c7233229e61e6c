"""The prefix trie of conversations, built level by level.

1. Turns are numbered within their conversation by a range partitioning, so a conversation of any
   length is spread over tasks; a turn is known by the SHA-256 of its role and text, and its words.
2. Downwards: at each depth the conversations that still share a node are grouped by (node, next
   turn); a group is a node of the next depth and named by its smallest conversation. A conversation
   that is alone in its node leaves: what follows is a chain that needs no search.
3. Upwards: level by level, children's leaves and savings are summed by parent.

Rounds: one for each depth at which two conversations still agree. Nodes whose members are more than
a share of all conversations are few and are broadcast; all other joins are on keys of few rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, tasks, work_dir, written
from quire.session import ship

#: Nodes with more than a HOT_SHARE-th of the conversations are broadcast: at most HOT_SHARE a level.
HOT_SHARE = 64
#: Conversation ids whose quotients by 2 to this power are equal are joined to one text before they are hashed.
CHUNK_BITS = 12
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_key(role: Column, text: Column) -> Column:
    """SHA-256 of a turn, in hexadecimal digits; null role and text are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``part``, ``at``, ``key``, ``words``: turns numbered from 1 within their conversation.

    Turns are ordered by number, null first, equal numbers by the turn's key, so rows that repeat
    are turns of their own. Rows without conv_id are left out. ``part`` is the range that holds the
    row; a range counts its rows of each conversation, and the counts give the next range its start.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.unhex(turn_key(F.col("role"), F.col("text"))).alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words")
    ).filter("conv_id is not null")
    order = [F.col("turn").asc_nulls_first(), F.col("key").asc()]
    ranges = turns.repartitionByRange(tasks(turns.sparkSession), F.col("conv_id"), *order)
    dealt = written(ranges.withColumn("part", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = counts.select("conv_id", "part", (F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return written(dealt.withColumn("no", place).join(before, ["conv_id", "part"]).select("conv_id", "part", (F.col("before") + F.col("no")).alias("at"), "key", "words"), "numbered")


def rebuilt(turns: DataFrame, family: int = 20, openings: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations: ``conv_id``, ``len``; their turns: ``conv_id``, ``depth``, ``key``, ``words``) with openings shared in families.

    Conversation c begins with the first h turns of conversation c - c % family (all if it has
    fewer, none if it is absent), where h is crc32 of c's decimal digits modulo ``openings``, and
    goes on with its own turns after the first h, if any.
    """
    parts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    of = F.col("conv_id")
    heads = parts.groupBy("conv_id").agg(F.sum("n").alias("own"))
    heads = heads.select("*", (of - of % F.lit(family)).alias("base"), (F.crc32(of.cast("string").cast("binary")) % F.lit(openings)).alias("h"))
    first = turns.filter((of % F.lit(family) == 0) & (F.col("at") < openings)).groupBy(of.alias("base")).agg(F.array_sort(F.collect_list(F.struct("at", "key", "words"))).alias("first"))
    given = F.least(F.col("h"), F.coalesce(F.size("first"), F.lit(0))).cast("long")
    heads = written(heads.join(first, "base", "left").select("conv_id", "own", "h", given.alias("given"), F.when(F.col("h") > 0, F.col("first")).alias("first")), "heads")
    lent = heads.filter("given > 0").select("conv_id", F.explode(F.slice("first", F.lit(1), F.col("given").cast("int"))).alias("t")).select("conv_id", F.col("t.at").alias("depth"), "t.key", "t.words")
    shift = parts.join(heads.select("conv_id", "h", "given"), "conv_id").select("conv_id", "part", "h", "given")
    own = turns.join(shift, ["conv_id", "part"]).filter("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("given")).alias("depth"), "key", "words")
    length = F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return heads.select("conv_id", length.cast("long").alias("len")), lent.unionByName(own)


def _digests(ends: DataFrame) -> DataFrame:
    """``depth``, ``conv_id`` (the node's), ``ends_sha256`` of (depth, node, conv_id) rows; a node's ids pass through one task in order, some thousands at once."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    chunks = ends.groupBy("depth", "node", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def row(node, digest):
            return pa.RecordBatch.from_pydict({"depth": pa.array([node[0]], pa.int64()), "conv_id": pa.array([node[1]], pa.int64()), "ends_sha256": [digest.hexdigest()]})

        for batch in batches:
            done = []
            for d, v, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (d, v) == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append(row(node, digest))
                    node, digest = (d, v), hashlib.sha256()
                digest.update(text.encode())
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if node is not None:
            yield row(node, digest)

    laid = chunks.select(F.col("depth").cast("long").alias("depth"), F.col("node").cast("long").alias("node"), "ids", "chunk").repartition("depth", "node").sortWithinPartitions("depth", "node", "chunk")
    return laid.mapInArrow(run, "depth long, conv_id long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node (NODES) of the trie of ``convs`` (conv_id, len), whose ``turns`` are (conv_id, depth from 1, key, words).

    A node is a distinct sequence of first turns; the root, of depth 0, has none. conv_id is the
    smallest conversation that begins with it, with depth the node's name. Conversations without
    turns are members of the root; without any conversation there is no node. Turns are equal if
    their keys are. saved_tokens is the words of a prefix's last turn times the members beyond the
    first, summed over the subtree; ends_sha256 hashes the ids of members that end here, ascending,
    joined by commas (none: of the empty string).
    """
    spark = convs.sparkSession
    ship(spark)
    home = f"{work_dir(spark)}/trie-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str, depth: int) -> DataFrame:
        df.write.parquet(f"{home}/{name}/depth={depth}")
        return spark.read.schema(df.schema).parquet(f"{home}/{name}/depth={depth}")

    def every(name: str, schema: str) -> DataFrame:
        return spark.read.schema(f"{schema}, depth long").parquet(f"{home}/{name}")

    total, root = convs.agg(F.count("*"), F.min("conv_id")).first()
    if not total:
        return spark.createDataFrame([], NODES)
    # a level is read by the files' statistics of depth
    laid = written(turns.repartitionByRange(tasks(spark), "depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "levels")

    live = kept(convs.select("conv_id", "len", F.lit(root).cast("long").alias("node")), "live", 0)
    shared = [kept(spark.range(1).select(F.lit(root).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(total).cast("long").alias("n"), F.lit(0).cast("long").alias("words")), "shared", 0)]
    below: list[DataFrame] = []
    depth = 0
    while True:
        depth += 1
        turn = laid.filter(F.col("depth") == depth).select("conv_id", "key", "words")
        step = written(live.filter(F.col("len") >= depth).join(turn, "conv_id").select("conv_id", "len", F.col("node").alias("parent"), "key", "words"), "step")
        groups = step.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count("*").alias("n"), F.max("words").alias("words"), F.max("len").alias("len"))
        groups = kept(groups, "groups", depth)
        below.append(groups)
        several, most = groups.agg(F.count_if(F.col("n") > 1), F.max("n")).first()
        if not several:
            break
        node = groups.filter("n > 1").select("parent", "key", "node", "n")
        hot = F.col("n") > max(1, total // HOT_SHARE)
        joined = step.join(node, ["parent", "key"])
        if most > max(1, total // HOT_SHARE):
            few = F.broadcast(node.filter(hot))
            joined = step.join(few, ["parent", "key"]).unionByName(step.join(few.select("parent", "key"), ["parent", "key"], "left_anti").join(node.filter(~hot), ["parent", "key"]))
        live = kept(joined.select("conv_id", "len", "node"), "live", depth)
        shared.append(groups.filter("n > 1").select("node", "parent", "n", "words"))

    rolled = None
    zero = F.lit(0).cast("long")
    for at in reversed(range(len(shared))):
        alone = F.when(F.col("n") == 1, 1).otherwise(0).cast("long")
        parts = below[at].select("parent", F.lit(1).cast("long").alias("kids"), alone.alias("leaves"), zero.alias("saved"))
        if rolled is not None:
            parts = parts.unionByName(rolled.select("parent", zero.alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
        sums = parts.groupBy(F.col("parent").alias("node")).agg(F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        nodes = shared[at].join(sums, "node", "left")
        rolled = kept(
            nodes.select("node", "parent", "n", F.coalesce("kids", zero).alias("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), (F.coalesce("saved", zero) + (F.col("n") - 1) * F.col("words")).alias("saved_tokens")), "rolled", at
        )

    nothing = F.sha2(F.lit("").cast("binary"), 256)
    ends = _digests(every("live", "conv_id long, len long, node long").filter("len = depth").select("depth", "node", "conv_id"))
    top = every("rolled", "node long, parent long, n long, n_children long, n_leaves long, saved_tokens long").withColumnRenamed("node", "conv_id").join(ends, ["depth", "conv_id"], "left")
    top = top.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    # a conversation that is alone: one node for each turn left
    chain = every("groups", "parent long, node long, n long, len long").filter("n = 1").withColumn("down", F.explode(F.sequence("depth", "len")))
    last = F.col("down") == F.col("len")
    chain = chain.select(
        F.col("node").alias("conv_id"),
        F.col("down").alias("depth"),
        F.when(F.col("down") == F.col("depth"), F.col("parent")).otherwise(F.col("node")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("node").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    return top.unionByName(chain)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie (NODES) of the rebuilt ``conversations`` (conv_id, turn, role, text); other columns are ignored, an empty table has no node."""
    return prefix_trie(*rebuilt(numbered(conversations)))
