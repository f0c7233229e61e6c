"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed word shapes and words and a few whole-text measures; a truncated
singular value decomposition of the labelled texts' weighted counts gives latent axes; every text's
vector is compared with all labelled vectors by exact cosine, in blocks, and the labels of the
nearest vote with their similarities as weights.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh_name, slices, worker_state

#: Labelled rows that the fit uses at most (those with the smallest hashes of their ids).
SAMPLE = 4096
#: Latent axes, and neighbours that vote.
AXES, NEIGHBOURS = 48, 25
#: Cells for word shapes, words and whole-text measures.
SHAPES, WORDS, MEASURES = 512, 1024, 64
FEATURES = SHAPES + WORDS + MEASURES
#: Letters above which a word is kept under a digest instead of itself.
LONG = 64
#: Texts whose similarities are computed at once.
BLOCK = 256


_CLASSES = [(regex.compile(p), c) for p, c in ((r"\p{Lu}\p{Lu}+", "\x01"), (r"\p{Lu}", "\x02"), (r"\p{L}+", "\x03"), (r"\d+", "\x04"))]
_REPEATS = regex.compile(r"(.)\1{3,}")
_MARKS = ".,;:!?*&%$#|\"')]}"


def shape(word: str) -> str:
    """The whole word: runs of letters and digits as classes, everything else as it is, repeats up to three kept."""
    s = word
    core = s.rstrip(_MARKS)
    if core.isalpha() and len(core) > 1:  # most words: letters, then marks
        low = core.lower()
        if core == low:
            return "\x03" + _REPEATS.sub(r"\1\1\1", s[len(core) :])
        if core[1:] == low[1:]:
            return "\x02\x03" + _REPEATS.sub(r"\1\1\1", s[len(core) :])
    for pattern, name in _CLASSES:
        s = pattern.sub(name, s)
    return _REPEATS.sub(r"\1\1\1", s)


class Features:
    """Counts and measures of a text, as a dense vector of FEATURES cells.

    What a word contributes is found once and kept: its shape's cell, its own cell, a number that
    ignores case, and whether it ends in two marks or is in capitals.
    """

    def __init__(self, memo: int = 400_000):
        self._limit = memo
        self._clear()

    def _clear(self):
        self._no: dict[str | bytes, int] = {}  # long words are kept under a digest
        self._about = np.zeros((4096, 5), dtype=np.int64)

    def _number(self, w: str, key: str | bytes) -> int:
        n = len(self._no)
        if n == len(self._about):
            self._about = np.vstack([self._about, np.zeros_like(self._about)])
        low, shaped = w.lower(), shape(w)
        marks = len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum()
        code = zlib.crc32(low.encode("utf-8", "replace"))
        own = zlib.crc32(low.strip(".,;:!?").encode("utf-8", "replace")) % WORDS
        self._about[n] = (zlib.crc32(shaped.encode("utf-8", "replace")) % SHAPES, SHAPES + own, code, marks, w.isupper())
        self._no[key] = n
        return n

    def vector(self, text: str | None) -> np.ndarray:
        text = text or ""
        if len(self._no) > self._limit:
            self._clear()
        words, get = text.split(), self._no.get
        if not words:
            return np.zeros(FEATURES)
        keys = words if len(max(words, key=len)) <= LONG else [w if len(w) <= LONG else hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=16).digest() for w in words]
        at = [get(k, -1) for k in keys]
        if -1 in at:
            at = [self._number(w, k) if i < 0 and k not in self._no else self._no[k] for w, k, i in zip(words, keys, at, strict=True)]
        at = np.array(at, dtype=np.intp)
        about = self._about[at]
        out = np.bincount(about[:, :2].ravel(), minlength=FEATURES).astype(np.float64)
        hit = np.flatnonzero(out)
        out[hit] = np.log1p(out[hit])
        out /= max(1e-12, np.sqrt(np.dot(out, out)))
        for i, v in enumerate(self._measures(text, at, about)):
            out[SHAPES + WORDS + 8 * i + min(7, int(v * 8))] = 0.35
        return out

    @staticmethod
    def _measures(text: str, at: np.ndarray, about: np.ndarray) -> list[float]:
        """Shares between 0 and 1: length, distinct words, most frequent word, repeated lines and word pairs, marks, capitals, words said twice."""
        n, lines = len(at), [x for x in text.split("\n") if x.strip()]
        counts = np.unique(at, return_counts=True)[1]
        pairs = len(np.unique(at[:-1] * (1 << 32) + at[1:]))
        twice = int((about[1:, 2] == about[:-1, 2]).sum())
        return [min(1.0, np.log10(n + 1) / 4), len(counts) / n, counts.max() / n, 1 - len(set(lines)) / max(1, len(lines)), 1 - pairs / max(1, n - 1), about[:, 3].sum() / n, about[:, 4].sum() / n, twice / n]


class Voters:
    """The fitted model: weights, axes, and the labelled vectors in latent space."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, axes: int = AXES):
        order = np.argsort(ids, kind="stable")
        rows, self.labels = rows[order], labels[order].astype(np.float64)
        self.base = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(rows):
            self.axes, self.latent = np.zeros((FEATURES, 0)), np.zeros((0, 0))
            return
        seen = (rows > 0).sum(axis=0)
        self.idf = np.log((1 + len(rows)) / (1 + seen)) + 1
        x = rows * self.idf
        # truncated decomposition by subspace iteration from a fixed start: a few products instead of all axes
        q = np.random.default_rng(6).standard_normal((FEATURES, axes + 16))
        for _ in range(8):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        vectors = q @ np.linalg.eigh((x @ q).T @ (x @ q))[1]
        self.axes = vectors[:, ::-1][:, : min(axes, len(rows))] * self.idf[:, None]
        self.latent = self._unit(rows @ self.axes)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 1e-12)

    def scores(self, rows: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Similarity-weighted share of label 1 among the ``k`` nearest; ties to the earlier labelled row.

        A vector that is near none (similarity not above 0) gets the base rate.
        """
        if not len(self.labels):
            return np.full(len(rows), self.base)
        sims = np.round(self._unit(rows @ self.axes) @ self.latent.T, 9)
        k = min(k, len(self.labels))
        nearest = np.argsort(-sims, axis=1, kind="stable")[:, :k] if len(self.labels) <= 4 * k else self._top(sims, k)
        w = np.maximum(np.take_along_axis(sims, nearest, axis=1), 0) ** 8  # near copies outweigh the merely similar
        total = w.sum(axis=1)
        votes = (w * self.labels[nearest]).sum(axis=1)
        return np.clip(np.divide(votes, total, out=np.full(len(rows), self.base), where=total > 1e-12), 0, 1)

    @staticmethod
    def _top(sims: np.ndarray, k: int) -> np.ndarray:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        least = np.take_along_axis(sims, part, axis=1).min(axis=1)
        crowded = np.flatnonzero((sims >= least[:, None]).sum(axis=1) > k)
        for i in crowded:  # ties at the border: the earlier rows
            part[i] = np.argsort(-sims[i], kind="stable")[:k]
        return part


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Voters:
    """Fit on at most ``sample`` rows of ``labelled`` (doc_id, text, label); their vectors come to the driver."""

    def run(batches):
        f = Features()
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                rows = [f.vector(t).astype(np.float32).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(rows, pa.binary())], ["doc_id", "label", "row"])

    got = labelled.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, row binary").collect()
    rows = np.array([np.frombuffer(r["row"], np.float32) for r in got], dtype=np.float64).reshape(len(got), FEATURES)
    return Voters(np.array([r["doc_id"] for r in got], dtype=np.int64), rows, np.array([r["label"] for r in got], dtype=np.float64))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """At most ``sample`` labelled documents: doc_id, text, label. Of contradicting labels of one id the smaller counts; null ids and labels don't."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the hint is safe: at most ``sample`` rows of two numbers
    found = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("text").alias("text"))


def score_quality(docs: DataFrame, labelled: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """``keep`` columns, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) for every row of ``docs``.

    Null and empty texts have no neighbours and get the labelled rows' share of label 1, as does
    everything when nothing is labelled similar; without any labelled row that share is 0.5. Texts
    are read whole. Repeated rows get equal scores; columns beyond ``keep`` and ``text`` are not read.
    """
    shipped, names, tag = docs.sparkSession.sparkContext.broadcast(fit(labelled)), list(keep), uuid.uuid4().hex
    source = fresh_name(docs, "text")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "score double, predicted int"])

    def run(batches):
        model, f = shipped.value, worker_state(tag, Features)
        for batch in batches:
            for lo, rows in slices(batch.column(source), BLOCK):
                part = batch.slice(lo, rows)
                scores = model.scores(np.array([f.vector(t.as_py()) for t in part.column(source)]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())], [*names, "score", "predicted"])

    return docs.select(*names, F.col(text).alias(source)).mapInArrow(run, schema)
