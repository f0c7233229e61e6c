"""Approximate nearest neighbours: inverted lists, scanned dimension by dimension with early abandoning.

Vectors go to the list of their nearest centre. A query probes its nearest lists. Within a list all
vectors are rotated by one random orthogonal matrix and laid out in column blocks; distances grow
block by block. After d of D rotated dimensions the partial squared distance times D/d estimates
the whole; a candidate is abandoned as soon as the estimate exceeds the query's k-th best by the
factor (1 + eps / sqrt(d))^2, that is, when the hypothesis that it is near enough is rejected.
Survivors get their exact distance from the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import vectors as V
from quire.llm.common import written

#: Lists: about the square root of the number of vectors, between these. Share of the lists that a
#: query probes, and the least number: high, so that vectors without any clusters reach a recall
#: above 0.9 too; the early abandoning is what saves work within the lists.
LISTS, PROBED_SHARE, PROBED = (1, 1024), 0.72, 16
#: Rotated dimensions read at once; significance of the test.
COLUMNS, EPSILON = 16, 2.1
FOUND = "query_id long, vec_id long, score double"


class Lists:
    """Centres, rotation, and the sample that gives queries their first bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lists: int, k: int):
        self.centres, self.ids, self.x, self.k = V.centres(x, lists), ids, x, k
        width = x.shape[1]
        q, r = np.linalg.qr(np.random.default_rng(3).standard_normal((width, width)))
        self.rotation = q * np.sign(np.diag(r))
        self.probed = min(len(self.centres), max(PROBED, int(np.ceil(PROBED_SHARE * len(self.centres)))))
        self.lists = V.nearest(x, self.centres)[0]
        self.sizes = np.zeros(len(self.centres), dtype=np.int64)

    def first_bounds(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The k-th smallest distance to the sample's vectors in the lists that the query probes."""
        d = V.distances(q, self.x)
        d[ids[:, None] == self.ids[None, :]] = np.inf
        d[self.ranks(q)[:, self.lists] >= len(self.centres)] = np.inf
        if d.shape[1] < self.k:
            return np.full(len(q), np.inf)
        return np.partition(d, self.k - 1, axis=1)[:, self.k - 1]

    def ranks(self, q: np.ndarray) -> np.ndarray:
        """For each query and list: which one it probes it as, or the number of lists if it doesn't.

        Every query probes ``probed`` lists, and more until these hold enough vectors to answer it.
        """
        n = len(self.centres)
        order = np.argsort(V.distances(q, self.centres), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
        place = np.broadcast_to(np.arange(n), order.shape)
        out = np.full(order.shape, n)
        np.put_along_axis(out, order, np.where((place < self.probed) | (held <= 2 * self.k), place, n), 1)
        return out

    def search(self, blocks: list, ids: np.ndarray, q: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query ids, vector ids, distances) of each query's k nearest in the probed lists of ``blocks``."""
        width, k = q.shape[1], self.k
        rank = self.ranks(q)
        turned = q @ self.rotation
        best_i = np.full((len(q), k), np.iinfo(np.int64).max)
        best_d = np.full((len(q), k), np.inf)
        limit = bounds * (1 + 1e-9) + 1e-12
        edges = [*range(0, width, COLUMNS), width]
        # lists that are many queries' nearest come first, so that limits tighten early
        for b in sorted(range(len(blocks)), key=lambda i: (rank[:, blocks[i][0]].mean(), i)):
            part, _, _, vec_ids, vecs = blocks[b]
            asks = np.flatnonzero(rank[:, part] < len(self.centres))
            if not len(asks):
                continue
            columns = vecs @ self.rotation
            rows, cols, sums = None, None, None
            for lo, hi in zip(edges, edges[1:], strict=False):
                if rows is None:
                    d = V.distances(turned[asks, lo:hi], columns[:, lo:hi]) ** 2
                    d[ids[asks][:, None] == vec_ids[None, :]] = np.inf
                else:
                    step = turned[asks[rows], lo:hi] - columns[cols, lo:hi]
                    sums = sums + np.einsum("ij,ij->i", step, step)
                factor = 1.0 if hi == width else (1 + EPSILON / np.sqrt(hi)) ** 2 * hi / width
                if rows is None:
                    rows, cols = np.nonzero(d <= (limit[asks] ** 2 * factor + 1e-9)[:, None])
                    sums = d[rows, cols]
                    finite = np.isfinite(sums)
                    rows, cols, sums = rows[finite], cols[finite], sums[finite]
                else:
                    keep = sums <= limit[asks[rows]] ** 2 * factor + 1e-9
                    rows, cols, sums = rows[keep], cols[keep], sums[keep]
                if not len(rows):
                    break
            if not len(rows):
                continue
            exact = q[asks[rows]] - vecs[cols]
            exact = np.sqrt(np.einsum("ij,ij->i", exact, exact))
            order = np.lexsort((vec_ids[cols], exact, rows))
            rows, cols, exact = rows[order], cols[order], exact[order]
            first = np.searchsorted(rows, rows, side="left")
            place = np.arange(len(rows)) - first
            keep = place < k
            rows, cols, exact, place = rows[keep], cols[keep], exact[keep], place[keep]
            hit, at = np.unique(rows, return_inverse=True)
            new_i, new_d = np.full((len(hit), k), np.iinfo(np.int64).max), np.full((len(hit), k), np.inf)
            new_i[at, place], new_d[at, place] = vec_ids[cols], exact
            own = asks[hit]
            best_i[own], best_d[own] = V.merge_top(best_i[own], best_d[own], new_i, new_d, k)
            limit[own] = np.minimum(limit[own], best_d[own, -1] * (1 + 1e-9) + 1e-12)
        r, c = np.nonzero(np.isfinite(best_d))
        yield ids[r], best_i[r, c], best_d[r, c]


def neighbours(table: DataFrame, *, every: int = 100, k: int = 10, embedding: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for rows whose vec_id is divisible by ``every``,
    the ``k`` nearest found among all others by Euclidean distance; ties to smaller ids.

    Null, zero and non-finite vectors take no part (``vectors.valid``); vectors of different lengths
    have no distance and are searched apart. The index is fitted on a bounded sample (``vectors.SAMPLE``) and holds every vector. A query never finds its own id, and
    probes further lists while those so far hold too few vectors to answer it. An empty table gives
    an empty result.
    """
    found = V.by_length(*V.valid(table, embedding=embedding, nonzero=True), lambda good, width, count: _candidates(good, width, count, every, k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _candidates(good: DataFrame, width: int, count: int, every: int, k: int) -> DataFrame:
    """FOUND: each query's ``k`` nearest within each data group that it probes, for vectors of one length."""
    spark = good.sparkSession
    ids, x = V.sample(good, count)
    lists = Lists(ids, x, int(min(max(LISTS[0], count**0.5), LISTS[1])), k)
    centres = lists.centres
    index = V.keyed(good, width, lambda v: V.nearest(v, centres), "lists")
    for r in index.groupBy("part").count().collect():  # one row per list
        lists.sizes[r["part"]] = r["count"]
    shipped = spark.sparkContext.broadcast(lists)
    asked = index.filter(F.col("vec_id") % every == 0)
    queries = written(V.packed_queries(asked, asked.count(), width, lambda i, v: shipped.value.first_bounds(i, v)), "queries")
    # lists lie in (list, id) order, so a list is in one data group or in neighbouring ones
    blocks = written(V.packed(index, count, width), "blocks")

    def probe_rows(batches):
        for batch in batches:
            for g, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rank = shipped.value.ranks(V.unpack(i, v)[1])
                some = np.flatnonzero((rank < rank.shape[1]).any(axis=0))
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(some), pa.int32()), pa.array(some, pa.int32())], ["qgrp", "part"])

    probed = queries.select("qgrp", "ids", "vecs").mapInArrow(probe_rows, "qgrp int, part int").distinct()
    pairs = blocks.select("grp", "part").distinct().join(probed, "part").select("grp", "qgrp").distinct()

    def search(data, q):
        for a, b, s in shipped.value.search(data, *q):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    return V.on_grid(blocks, queries, search, FOUND, pairs)
