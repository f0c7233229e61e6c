"""Exact top-k search by integer inner product over a pivot-distance index.

The largest inner products are the smallest distances once every vector gets one more coordinate,
sqrt(M^2 - |x|^2), with M the greatest norm, and queries get 0 there. Each vector is keyed by its
nearest pivot and its distance to it and stored in that order, so a block is an annulus around a
pivot. A query goes through the annuli in the order of their triangle-inequality bounds
|d(q, pivot) - d(x, pivot)| <= d(q, x) and stops when no remaining one can hold a better score
than its k-th best. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import vectors as V
from quire.llm.common import written

#: Pivots at most, and queries that go through the annuli together.
PIVOTS, TOGETHER = 64, 128
FOUND = "query_id long, vec_id long, score long"


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x)


def exact_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows: in doubles where these are exact, else in 64-bit integers."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    return q @ x.T if top < 2**53 else (q.astype(np.int64) @ x.astype(np.int64).T).astype(np.float64)


class PivotIndex:
    """Pivots in the augmented space and the greatest squared norm."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, norm2: float, k: int):
        self.norm2, self.k, self.ids, self.x = norm2, k, ids, x
        self.pivots = V.centres(self.augmented(x), PIVOTS)

    def augmented(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def first_bounds(self, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """The k-th best score within the sample: no answer scores less."""
        s = exact_products(q, self.x)
        s[ids[:, None] == self.ids[None, :]] = -np.inf
        if s.shape[1] < self.k:
            return np.full(len(q), -np.inf)
        return np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]

    def to_pivots(self, q: np.ndarray) -> np.ndarray:
        return V.distances(np.concatenate([q, np.zeros((len(q), 1))], 1), self.pivots)

    def reach(self, q: np.ndarray, to_pivots: np.ndarray, part: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how far each query is from each annulus at least, the best score that this leaves)."""
        d = to_pivots[:, part]
        apart = np.maximum(np.maximum(d - hi, lo - d), 0)
        # the slack covers the rounding of distances; it only admits more
        apart = np.maximum(apart - 1e-6 * (1 + d), 0)
        return apart, ((q * q).sum(1)[:, None] + self.norm2 - apart * apart) / 2 + 1e-6 * (1 + self.norm2)

    def reached(self, ranges: tuple[np.ndarray, ...], asked: tuple[np.ndarray, ...]) -> np.ndarray:
        """Annuli in which some query may still find an answer, given the queries' first bounds."""
        _, q, bounds = asked
        return (self.reach(q, self.to_pivots(q), *ranges)[1] >= bounds[:, None]).any(axis=0)

    def search(self, blocks: list, ids: np.ndarray, q: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query ids, vector ids, scores) of each query's k best of ``blocks`` that reach its bound."""
        part = np.array([b[0] for b in blocks])
        lo, hi = np.array([b[1] for b in blocks]), np.array([b[2] for b in blocks])
        to_pivots = self.to_pivots(q)
        order = np.argsort(to_pivots.argmin(1), kind="stable")
        for at in range(0, len(order), TOGETHER):
            own = order[at : at + TOGETHER]
            apart, most = self.reach(q[own], to_pivots[own], part, lo, hi)
            best_i = np.full((len(own), self.k), np.iinfo(np.int64).max)
            best_k = np.full((len(own), self.k), np.inf)
            least = bounds[own].copy()
            after = most[:, (expand := np.argsort(apart.mean(0), kind="stable"))]
            rest = np.maximum.accumulate(after[:, ::-1], axis=1)[:, ::-1]
            for n, b in enumerate(expand):
                if not (rest[:, n] >= least).any():
                    break  # no annulus from here on can hold an answer of any of these queries
                live = np.flatnonzero(after[:, n] >= least)
                if not len(live):
                    continue
                s = exact_products(q[own[live]], blocks[b][4])
                s[ids[own[live]][:, None] == blocks[b][3][None, :]] = -np.inf
                reach = s >= least[live][:, None]
                hit = np.flatnonzero(reach.any(1))
                if not len(hit):
                    continue
                rows, s = live[hit], np.where(reach[hit], s[hit], -np.inf)
                width = int(reach[hit].sum(1).max())
                if width < s.shape[1]:  # keep the columns that reach, ties to smaller ids
                    cols = np.lexsort((np.broadcast_to(blocks[b][3], s.shape), -s), axis=-1)[:, :width]
                    new_i, new_s = blocks[b][3][cols], np.take_along_axis(s, cols, 1)
                else:
                    new_i, new_s = np.broadcast_to(blocks[b][3], s.shape), s
                new_i = np.where(np.isfinite(new_s), new_i, np.iinfo(np.int64).max)
                best_i[rows], best_k[rows] = V.merge_top(best_i[rows], best_k[rows], new_i, -new_s, self.k)
                least[rows] = np.maximum(least[rows], -best_k[rows, -1])
            r, c = np.nonzero(np.isfinite(best_k))
            yield ids[own[r]], best_i[r, c], -best_k[r, c]


def top_k(table: DataFrame, *, every: int = 20, k: int = 20, scale: float = 64.0, embedding: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for rows whose vec_id is divisible by ``every``,
    the ``k`` best of all others by the inner product of floor(scale * component); ties to smaller ids.

    Null vectors and vectors with null or non-finite components take no part (``vectors.valid``);
    vectors of different lengths have no product and are searched apart. A query never finds its own
    id; equal vectors under other ids are found like any. Rows that repeat an id with another vector
    are each candidates. An empty table gives an empty result.

    Data groups are met only by query groups that a triangle bound doesn't rule out for all their
    queries.
    """
    found = V.by_length(*V.valid(table, embedding=embedding), lambda good, width, _: _candidates(good, width, every, k, scale), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _candidates(good: DataFrame, width: int, every: int, k: int, scale: float) -> DataFrame:
    """FOUND: each query's ``k`` best within each data group that it reaches, for vectors of one length."""
    spark = good.sparkSession
    whole = good.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x * scale).cast("double")))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    count, norm2 = whole.agg(F.count("*"), F.max(square)).first()
    ids, x = V.sample(whole, count)
    shipped = spark.sparkContext.broadcast(PivotIndex(ids, x, norm2, k))
    index = V.keyed(whole, width, lambda v: V.nearest(shipped.value.augmented(v), shipped.value.pivots), "pivots")
    asked = index.filter(F.col("vec_id") % every == 0)
    queries = written(V.packed_queries(asked, asked.count(), width, lambda i, v: shipped.value.first_bounds(i, v)), "queries")
    blocks = written(V.packed(index, count, width), "annuli")

    def search(data, q):
        for a, b, s in shipped.value.search(data, *q):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s.astype(np.int64), pa.int64())], ["query_id", "vec_id", "score"])

    pairs = V.pairs_within_reach(blocks, queries, lambda ranges, asked: shipped.value.reached(ranges, asked))
    return V.on_grid(blocks, queries, search, FOUND, pairs)
