"""Phrases that hold together: n-grams counted per language, scored by their weakest cut.

1. Explode: every n-gram of 1 to max_n words of every piece is a row (hash, occurrences), rows of one
   hash summed within a batch first; the hashes are aggregated, and those that occur often enough
   are kept. Hashes that collide only keep too much.
2. Recount: n-grams whose hash may be among these (a bit table of fixed size; where it fills up, more
   rows pass) become rows of (language, phrase), which are aggregated exactly, as text.
3. A candidate's first and last words are joined with their own counts, its weakest cut is scored in
   decimals, candidates that a one-word extension explains are left out by an anti-join, and each
   language's best are ranked, in parts of a language first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import slices, tasks, tidy, written
from quire.llm.grams import Cuts, mixed, scattered
from quire.session import ship

#: Bytes of text that are cut at once, hashes that are summed at once, and given out at once.
SLICE, FLUSH, EMITTED = 2 << 20, 6_000_000, 500_000
#: Tasks that sum the hashes, as a multiple of the session's number: they hold a row for each hash.
PARTS = 4
#: Bits of the table of frequent hashes, as a power of two: 8 MB whatever the corpus is.
BITS = 26
#: Parts of a language that are ranked before the language is: its last task gets so many times `top` rows at most.
RANKED = 128
UNKNOWN = "und"

_INSIDE = np.ones(256, bool)
_INSIDE[[9, 32, *b".,;:!?", 10, 11, 12, 13]] = False
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", 10, 11, 12, 13]] = True


def _language_hashes(langs: pa.Array) -> np.ndarray:
    coded = langs.dictionary_encode()
    each = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest(), "little") for x in coded.dictionary.to_pylist()], np.uint64)
    return each[coded.indices.to_numpy(zero_copy_only=False)] if len(each) else np.zeros(0, np.uint64)


class _Grams:
    """The n-grams of a slice of texts: the place of the first word and the hash of each, by n."""

    def __init__(self, langs: pa.Array, texts: pa.Array, max_n: int):
        self.cuts = Cuts(texts, _INSIDE, _BREAKS)
        self.max_n, self.lang = max_n, _language_hashes(langs)
        self._words = self.cuts.hashes(11)
        self._longest = [np.flatnonzero(self.cuts.piece[n - 1 :] == self.cuts.piece[: len(self.cuts) - n + 1]) if len(self.cuts) >= n else np.zeros(0, np.int64) for n in range(1, max_n + 1)]

    def places(self, n: int) -> np.ndarray:
        return self._longest[n - 1]

    def keys(self, n: int, at: np.ndarray, words: np.ndarray | None = None, seed: int = 21) -> np.ndarray:
        words, by = self._words if words is None else words, scattered(n + 1, seed + n)
        total = self.lang[self.cuts.text[at]] * by[n]
        for j in range(n):
            total = total + words[at + j] * by[j]
        return mixed(total)


def _hashes(max_n: int):
    """Batches of (lang, text) to batches of (key, n)."""

    def summed(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys.sort()
        lo = 0
        while lo < len(keys):  # some at once; a key's run stays whole
            hi = int(np.searchsorted(keys, keys[min(lo + EMITTED, len(keys)) - 1], side="right"))
            some = keys[lo:hi]
            first = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(some[first].view(np.int64)), pa.array(np.diff(np.r_[first, len(some)]))], ["key", "n"])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = np.empty(FLUSH, np.uint64), 0
        for batch in batches:
            for lo, n in slices(batch.column(1), 1 << 16, SLICE):
                grams = _Grams(batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), max_n)
                for k in range(1, max_n + 1):
                    keys = grams.keys(k, grams.places(k))
                    if size + len(keys) > FLUSH:
                        yield from summed(held[:size])
                        size = 0
                    if len(keys) > FLUSH:
                        yield from summed(keys)
                    else:
                        held[size : size + len(keys)] = keys
                        size += len(keys)
        yield from summed(held[:size])
        del held
        tidy()

    return run


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(key, s).bitwiseAND(F.lit((1 << bits) - 1)) for s in (0, (64 - bits) // 2, 64 - bits)]


def _bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """The keys' bits; what comes to the driver is bounded by the table's size."""
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), bits))).alias("at"))
    rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    table = np.zeros(1 << max(0, bits - 6), np.uint64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return table


def _held(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for s in (0, (64 - bits) // 2, 64 - bits):
        at = (keys >> np.uint64(s)) & np.uint64((1 << bits) - 1)
        found &= ((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
    return found


def _recount(max_n: int, table, bits: int):
    """Batches of (lang, text) to batches of (lang, phrase, size, n); rows without phrase count all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(table.value, np.uint64)
        for batch in batches:
            for lo, count in slices(batch.column(1), 1 << 16, SLICE):
                langs = batch.column(0).slice(lo, count)
                grams = _Grams(langs, batch.column(1).slice(lo, count), max_n)
                if not len(grams.cuts):
                    continue
                second = grams.cuts.hashes(13)
                words = pa.table({"lang": langs, "n": np.diff(grams.cuts.bounds)}).group_by("lang").aggregate([("n", "sum")])
                yield from pa.table({"lang": words["lang"], "phrase": pa.nulls(len(words), pa.large_string()), "size": pa.array(np.zeros(len(words), np.int32)), "n": words["n_sum"].cast(pa.int64())}).to_batches()
                for n in range(1, max_n + 1):
                    at = grams.places(n)
                    keys = grams.keys(n, at)
                    some = _held(known, keys, bits)
                    at, keys = at[some], keys[some]
                    if not len(at):
                        continue
                    # equal phrases are those of two equal hashes
                    other = grams.keys(n, at, second, 41)
                    order = np.lexsort((other, keys))
                    keys, other = keys[order], other[order]
                    first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (other[1:] != other[:-1])])
                    which, times = at[order[first]], np.diff(np.r_[first, len(order)])
                    phrase = grams.cuts.strings(which)
                    for j in range(1, n):
                        phrase = pc.binary_join_element_wise(phrase, grams.cuts.strings(which + j), pa.scalar(" ", pa.large_string()))
                    out = pa.table({"lang": langs.take(pa.array(grams.cuts.text[which])), "phrase": phrase, "size": pa.array(np.full(len(which), n, np.int32)), "n": pa.array(times.astype(np.int64))})
                    yield from out.to_batches(max_chunksize=1 << 16)
        tidy()

    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = 3, least: int = 10, bits: int = BITS) -> DataFrame:
    """``lang``, ``phrase``, ``size``, ``n``: all phrases of 1 to ``max_n`` words with ``least`` occurrences, and for each language a row without phrase, of all its words."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce(F.col(lang), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = docs.mapInArrow(_hashes(max_n), "key long, n long").repartition(PARTS * tasks(spark), "key").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    table = spark.sparkContext.broadcast(_bit_table(keys, bits).tobytes())
    rows = docs.mapInArrow(_recount(max_n, table, bits), "lang string, phrase string, size int, n long")
    counts = rows.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    return written(counts.filter(F.col("phrase").isNull() | (F.col("n") >= least)), "phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", *, max_n: int = 3, least: int = 10, share: int = 50, top: int = 2000, bits: int = BITS) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's first ``top`` phrases of 2 to ``max_n`` words.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at spaces
    and tabs. a: occurrences within pieces, at least ``least``, overlaps counted; l and r: those of
    the first and the last words at the cut that scores floor(1000000 a a / (l r)) lowest, of equal
    ones the first; n: words of the language. A phrase inside a longer candidate with ``share``
    hundredths of its occurrences is left out. Ranked by score, then a, then the phrase's bytes.
    Null texts are empty, a null language is ``und``; texts that repeat count each, long ones
    whole; other columns are ignored; an empty table gives no rows.
    """
    return ranked(phrase_counts(docs, text, lang, max_n, least, bits), share, top)


def ranked(counts: DataFrame, share: int = 50, top: int = 2000) -> DataFrame:
    """The result of ``collocations`` from the rows of ``phrase_counts``."""
    known = counts.filter("phrase is not null")
    candidates = known.filter("size > 1").withColumn("words", F.split("phrase", " "))
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "k", F.col("n").alias("a"), part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    # whole numbers below 10^16 each, so that no product passes 38 digits
    whole = lambda c: f"CAST({c} AS DECIMAL(16, 0))"
    score = F.expr(f"(CAST(1000000 AS DECIMAL(7, 0)) * ({whole('a')} * {whole('a')})) div ({whole('l')} * {whole('r')})")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = candidates.filter("size > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("inner"), "n")
    longer = longer.groupBy(F.col("lang").alias("of"), "inner").agg(F.max("n").alias("most"))
    kept = scored.join(longer, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("inner")) & (F.col("most") * 100 >= F.col("a") * share), "left_anti")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(RANKED)).alias("part"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.join(counts.filter("phrase is null").select("lang", "n"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
