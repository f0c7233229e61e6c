"""Connected components of a link table, by repeated contraction onto the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``node``, ``label`` (one node of its component) for every node of ``links`` (a, b).

    Each round sends every node to the smallest node among itself and its neighbours and contracts
    the links; a star becomes one node at once, and on node numbers without order (hashes) a round
    removes a constant share of the rest. Only aggregates with partial sums and joins on nodes are
    used, so a node with very many links needs no large task. Nothing comes to the driver but the
    number of links left.
    """
    edges = written(links.filter("a <> b").select("a", "b").distinct(), "links")
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
        maps.append(to)
        edges = edges.join(to.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        edges = written(edges.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    if not maps:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    out = maps[0]
    for m in maps[1:]:
        step = m.select(F.col("node").alias("label"), F.col("label").alias("next"))
        out = out.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return written(out, "components") if len(maps) > 1 else out
