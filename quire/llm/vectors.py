"""What the vector searches share: valid vectors, bounded samples, centres, packed groups, the search grid.

Data and queries are both packed in groups of bounded size; a search runs once for each pair of a
data group and a query group that may hold an answer (a grid over a stated query set, in blocks).
Groups are cut from a range partitioning that ends with the id, so equal vectors, however many,
spread over groups like any others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

#: Vectors that the fit of an index uses, about (those with the smallest hashes of their ids).
SAMPLE = 4096
#: Vectors in a data group, and in a query group, about.
DATA_ROWS, QUERY_ROWS = 8192, 4096
#: Vectors in a packed block of a data group at most.
BLOCK_ROWS = 512

BLOCKS = "grp int, part int, lo double, hi double, ids binary, vecs binary"
QUERIES = "qgrp int, ids binary, vecs binary, bounds binary"


def valid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", nonzero: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """(``vec_id`` long, ``embedding`` array<double>) of the vectors that take part, and how many there are of each length.

    Null vectors, null or non-finite components, null ids and empty vectors don't take part; with
    ``nonzero``, nor do zero vectors. Neither products nor distances are defined between vectors of
    different lengths, so each length is a search of its own (``by_length``).
    """
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    found = found.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(F.coalesce(ok, F.lit(False)))
    if nonzero:
        found = found.filter(F.exists("embedding", lambda x: x != 0))
    lengths = found.groupBy(F.size("embedding").alias("n")).count().collect()
    return found, {r["n"]: r["count"] for r in sorted(lengths)}


def by_length(found: DataFrame, lengths: dict[int, int], search: Callable[[DataFrame, int, int], DataFrame], schema: str) -> DataFrame:
    """The union of ``search(vectors, length, count)`` over all lengths."""
    out = None
    for n, count in lengths.items():
        part = search(found.filter(F.size("embedding") == n) if len(lengths) > 1 else found, n, count)
        out = part if out is None else out.unionByName(part)
    return found.sparkSession.createDataFrame([], schema) if out is None else out


def sample(vectors: DataFrame, count: int, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of about ``size`` of the ``count`` vectors, by hash of id and vector, in id order.

    Repeated rows count once, so no id brings more than its share, and the one with the smallest
    hash is always there.
    """
    h = F.pmod(F.xxhash64(F.lit(11), "vec_id", "embedding"), F.lit(1_000_000))
    share = min(1_000_000, -(-1_000_000 * size // max(1, count)))
    rows = vectors.filter(h < share).distinct().collect() or vectors.orderBy(h, "vec_id").limit(1).collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.float64)


def centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Up to ``k`` k-means centres of ``x``, from a fixed start."""
    x = np.unique(x, axis=0)
    k = min(k, len(x))
    c = x[np.random.default_rng(7).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = nearest(x, c)[0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``x`` to all rows of ``c``."""
    d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T)
    return np.sqrt(np.maximum(d, 0))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (ties: the first) and the distance to it."""
    d = distances(x, c)
    n = d.argmin(1)
    return n, d[np.arange(len(x)), n]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def unpack(ids: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vecs, np.float64).reshape(len(i), -1)


def keyed(vectors: DataFrame, width: int, place: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], tag: str) -> DataFrame:
    """The index as a table: ``part``, ``dist``, ``vec_id``, ``embedding``, where ``place`` gives part and distance."""

    def run(batches):
        for batch in batches:
            part, dist = place(matrix(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(dist, pa.float64()), batch.column(0), batch.column(1)], ["part", "dist", "vec_id", "embedding"])

    return written(vectors.mapInArrow(run, "part int, dist double, vec_id long, embedding array<double>"), tag)


def packed(index: DataFrame, count: int, width: int, rows: int = DATA_ROWS) -> DataFrame:
    """The index in sorted blocks (BLOCKS): each within one part and one data group, with its range of distances."""
    groups = max(1, -(-count // rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(part, dist, ids, vecs):
            return (part, float(dist[0]), float(dist[-1]), ids.tobytes(), vecs.tobytes())

        def batch_of(group, found):
            cols = list(zip(*found, strict=True))
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([group] * len(found), pa.int32()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["grp", "part", "lo", "hi", "ids", "vecs"])

        group = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0)[0].as_py()
            now = [batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(), matrix(batch.column(4), width)]
            if held is not None:
                now = [np.concatenate(p) for p in zip(held, now, strict=True)]
            part, dist, ids, vecs = now
            found, at, n = [], 0, len(part)
            while at < n:
                stop = min(at + BLOCK_ROWS, int(np.searchsorted(part, part[at], side="right")))
                if stop == n and stop - at < BLOCK_ROWS:
                    break
                found.append(out(int(part[at]), dist[at:stop], ids[at:stop], vecs[at:stop]))
                at = stop
            held = [part[at:], dist[at:], ids[at:], vecs[at:]] if at < n else None
            if found:
                yield batch_of(group, found)
        if held is not None:
            yield batch_of(group, [out(int(held[0][0]), *held[1:])])

    dealt = index.repartitionByRange(groups, "part", "dist", "vec_id").sortWithinPartitions("part", "dist", "vec_id")
    return dealt.select(F.spark_partition_id().alias("grp"), "part", "dist", "vec_id", "embedding").mapInArrow(run, BLOCKS)


def packed_queries(index: DataFrame, count: int, width: int, bounds: Callable[[np.ndarray, np.ndarray], np.ndarray], rows: int = QUERY_ROWS) -> DataFrame:
    """Queries in packed rows (QUERIES), neighbours together; ``bounds(ids, vectors)`` gives each its first bound."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                ids, vecs = part.column(1).to_numpy(), matrix(part.column(2), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(0, 1), pa.array([ids.tobytes()], pa.binary()), pa.array([vecs.tobytes()], pa.binary()), pa.array([bounds(ids, vecs).astype(np.float64).tobytes()], pa.binary())],
                    ["qgrp", "ids", "vecs", "bounds"],
                )

    dealt = index.repartitionByRange(max(1, -(-count // rows)), "part", "dist", "vec_id").sortWithinPartitions("part", "dist", "vec_id")
    return dealt.select(F.spark_partition_id().alias("qgrp"), "vec_id", "embedding").mapInArrow(run, QUERIES)


#: Blocks' ranges that are sent to all tasks at most: about 24 bytes each.
RANGES = 1_000_000


def pairs_within_reach(blocks: DataFrame, queries: DataFrame, reached: Callable[[tuple[np.ndarray, ...], tuple[np.ndarray, ...]], np.ndarray]) -> DataFrame | None:
    """``grp``, ``qgrp``: data groups that may hold an answer of a query group; None: too many ranges to say.

    ``reached((part, lo, hi) of all ranges, (ids, vectors, bounds))`` says which ranges some query reaches.
    """
    ranges = blocks.groupBy("grp", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rows = ranges.limit(RANGES + 1).collect()
    if len(rows) > RANGES:
        return None
    group = np.array([r[0] for r in rows], np.int64)
    known = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    shipped = blocks.sparkSession.sparkContext.broadcast((group, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known = shipped.value
        for batch in batches:
            for g, i, v, b in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                some = np.unique(group[reached(known, (*unpack(i, v), np.frombuffer(b, np.float64)))])
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([g] * len(some), pa.int32())], ["grp", "qgrp"])

    return queries.select("qgrp", "ids", "vecs", "bounds").mapInArrow(run, "grp int, qgrp int").distinct()


def on_grid(blocks: DataFrame, queries: DataFrame, search: Callable[[list, tuple], Iterator[pa.RecordBatch]], schema: str, pairs: DataFrame | None = None) -> DataFrame:
    """``search(blocks, (ids, vectors, bounds))`` for the pairs (grp, qgrp) of data and query groups; without ``pairs`` for each."""
    if pairs is None:
        # group numbers only: one row per group on either side, not per vector
        g, q = blocks.select("grp").distinct(), queries.select("qgrp").distinct()
        sizes = q.agg(F.max("qgrp")).first()[0]
        pairs = g.withColumn("qgrp", F.explode(F.sequence(F.lit(0), F.lit(-1 if sizes is None else sizes)))) if sizes is not None else g.withColumn("qgrp", F.lit(0))
        pairs = pairs.join(q, "qgrp", "left_semi")
    left = blocks.join(pairs, "grp").select(F.col("grp").alias("g"), F.col("qgrp").alias("q"), "part", "lo", "hi", F.col("ids").alias("ids"), "vecs")
    right = queries.join(pairs, "qgrp").select(F.col("grp").alias("g"), F.col("qgrp").alias("q"), F.col("ids").alias("ids"), F.col("vecs").alias("vecs"), "bounds")

    def run(data: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if data.num_rows and asked.num_rows:
            d = [(p, lo, hi, *unpack(i, v)) for p, lo, hi, i, v in zip(*(data.column(c).to_pylist() for c in ("part", "lo", "hi", "ids", "vecs")), strict=True)]
            q = [unpack(i, v) for i, v in zip(asked.column("ids").to_pylist(), asked.column("vecs").to_pylist(), strict=True)]
            b = np.concatenate([np.frombuffer(x, np.float64) for x in asked.column("bounds").to_pylist()])
            out = list(search(d, (np.concatenate([x[0] for x in q]), np.concatenate([x[1] for x in q]), b)))
        return pa.Table.from_batches(out) if out else _empty(schema)

    return left.groupBy("g", "q").cogroup(right.groupBy("g", "q")).applyInArrow(run, schema)


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "double": pa.float64()}
    return pa.table({n: pa.array([], kinds[k]) for n, k in (f.split() for f in schema.split(", "))})


def merge_top(ids: np.ndarray, keys: np.ndarray, new_ids: np.ndarray, new_keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the ``k`` smallest (key, id) of two sets; unused places have key inf."""
    i, key = np.concatenate([ids, new_ids], 1), np.concatenate([keys, new_keys], 1)
    order = np.lexsort((i, key), axis=-1)[:, :k]
    return np.take_along_axis(i, order, 1), np.take_along_axis(key, order, 1)
