"""Exact Jaccard join of documents over word 5-shingles, as a metric-space join.

1 - Jaccard is a metric. Documents are points, documents serve as pivots, and a pivot's region
holds the points that may be within the radius r = 1 - threshold of something in it:

1. Equal sets are one point. All shingles are counted in a sketch of fixed size, whose counts put
   them in one global order, common ones last. Points within r of each other share a shingle among
   the first n - ceil(t * n) + 1 of either, so these shingles cut the space into overlapping
   blocks, and within a block sizes must be within the factor t; a point alone in all its blocks
   has no link and is done.
   Points share more than that in somewhat longer prefixes; one that doesn't is done as well.
2. Each block's pivot is the point that shares most shingles with others. A point goes to the region
   of the pivot that it shares most blocks with, which stands for its Voronoi cell, and its exact
   distance to that pivot is computed. Distances up to r are links, and linked points are joined
   into components.
3. Points on a border are those with another pivot in another component. Where several points lie
   between the same two pivots, the distance of the pivots is computed first; a point whose distances
   leave no room for a neighbour within r of the other pivot's region, d(own, other) - 2 d(x, own) > 2r,
   stays where it is. The others are replicated into that region, and their distances computed.
4. A block whose points now lie in one component is done. In the others, points outside the
   pivot's component become pivots and meet the block's points of other components, except those
   whose known distances to a common pivot differ by more than r (triangle inequality) and those
   whose sketches already prove more than r. This recurs until no such point is left, so no link
   between components is missed.

Hot groups: a group of near copies is one component after step 2, since its points meet their pivot
and not each other; exact copies are one point, and a set that very many rows have is cut into
shingles from one row of it; links and blocks are rows, never lists in memory. A point's text is
read from one row, named by a hash of id and text, so rows that share an id or have none are as good
as others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import discard, fresh_name, plain_plans, release, slices, tidy, worker_state, written
from quire.llm.components import components

#: Words of a shingle, and the threshold as hundredths.
SHINGLE, THRESHOLD = 5, 80
#: Counters of the sketch, and bits of the filter of points that share a block (both of fixed size).
COUNTERS, FILTER_BITS = 1 << 22, 1 << 25
#: Counters or filter bytes in one row of a partial result.
CHUNK = 1 << 14
#: Hundredths of a set by which the prefix is longer in which shared shingles are counted.
EXTRA = 15
#: Bits of a point's sketch: how often, modulo two, its shingles fall on each.
SKETCH_BITS = 2048
#: Points of a block that become pivots in one round (few enough for Spark to cut them in each task before they are shuffled).
NEW_PIVOTS = 1000
#: Points between two pivots from which on the pivots' distance is computed.
BETWEEN = 4
#: A key is hot if it holds more rows than this, or than this share of all; so hot keys are fewer than HOT_SHARE.
HOT_ROWS, HOT_SHARE = 1000, 200
#: Members of a region, or of a part of a large one, about.
REGION = 512
#: Documents hashed together; prefix shingles in a bucket, about.
TOGETHER, BUCKET = 1024, 1_000_000

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Values of bytes by their place in a word (modulo 8), and powers of an odd number by place.
_BYTES = np.random.default_rng(20).integers(0, 1 << 63, (8, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _FACTORS[0], np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Texts to sets of 64-bit shingle hashes, many texts at once and without an object per word.

    A word's hash is the sum over its bytes of a value that depends on byte and place times a power
    that depends on the place; a shingle's is a mixed sum over its words.
    """

    def __init__(self):
        self._power = _powers(1 << 12)

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of every word, number of words of every text); A-Z count as a-z, ASCII white space ends words."""
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        inside = ~_SPACE[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[::2], edge[1::2]
        lengths = ends - starts
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        while lengths.max() > len(self._power):
            self._power = _powers(2 * len(self._power))
        letters = _LOWER[data[inside]]
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(letters)) - np.repeat(first, lengths)
        values = _BYTES[place & 7, letters] * self._power[place]
        words = mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64))
        bounds = np.cumsum([len(p) + 1 for p in parts])
        return words, np.diff(np.searchsorted(starts, np.concatenate([[0], bounds])))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct shingle hashes of each text."""
        w, lengths = self._words(texts)
        whole = np.zeros(max(0, len(w) - SHINGLE + 1), np.uint64)
        for i in range(SHINGLE if len(whole) else 0):
            whole += w[i : len(w) - SHINGLE + 1 + i] * _FACTORS[i]
        whole = mixed(whole)
        out, at = [], 0
        for n in lengths.tolist():
            if n >= SHINGLE:
                s = np.sort(whole[at : at + n - SHINGLE + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s)
            elif n:
                few = (w[at : at + n] * _FACTORS[:n]).sum(dtype=np.uint64) + np.uint64(n)
                out.append(mixed(np.array([few], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
        return out


def name_of(s: np.ndarray) -> int:
    """A 64-bit name of a set; two different sets share one with probability 2^-64."""
    with np.errstate(over="ignore"):
        h = mixed(s + _FACTORS[0]).sum(dtype=np.uint64) + np.uint64(len(s)) * _FACTORS[1]
    return int(mixed(np.array([h], np.uint64)).view(np.int64)[0])


def sketch_of(s: np.ndarray) -> bytes:
    """Parities of shingle counts: two sketches differ in no more places than the sets differ in elements."""
    odd = np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.intp), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def prefix_length(n: int, t: int = THRESHOLD) -> int:
    """Of sets with n elements that link, one of the first this many (in any common order) is shared."""
    return n - -(-n * t // 100) + 1


def extra_length(n: int) -> int:
    """How much longer the prefix is in which shared elements are counted."""
    return n * EXTRA // 100


def least_shared(n: int, t: int = THRESHOLD) -> int:
    """Shared elements that a linked set of n elements has in its longer prefix, at least.

    Two linked sets share an element more than the smaller of their extra lengths there, and the
    smaller set has at least t hundredths of n elements.
    """
    return extra_length(-(-n * t // 100)) + 1


# --- fixed-size partial results, merged on the executors --------------------------------------------


def _merged(parts: DataFrame, add: bool) -> np.ndarray:
    """One vector out of ``chunk``, ``data`` rows: sums of 32-bit counts, or bytes or-ed."""
    kind = np.uint32 if add else np.uint8

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, d in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(d.as_buffer(), np.uint8)
                if c not in held:
                    held[c] = new.astype(kind)
                elif add:
                    held[c] += new
                else:
                    held[c] |= new
        if held:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(held.keys(), pa.int32()), "data": pa.array([x.tobytes() for x in held.values()], pa.binary())})

    size = COUNTERS if add else FILTER_BITS // 8
    out = np.zeros(size, kind)
    for c, d in parts.repartition("chunk").mapInArrow(run, "chunk int, data binary").collect():
        out[c * CHUNK : (c + 1) * CHUNK] = np.frombuffer(d, kind)
    return out


def _chunks(v: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = [(i, v[i * CHUNK : (i + 1) * CHUNK]) for i in range(len(v) // CHUNK)]
    rows = [(i, x.tobytes()) for i, x in rows if x.any()]
    if rows:
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})


_FIRST = "chunk int, data binary, doc_id long, tid long, sid long, n int, sketch binary"


def _first_pass(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: a part of the shingle counters (with a chunk), and a document's mark: its set's name, size and sketch."""

    def run(batches):
        shingler, counts, held, n = worker_state("shingles", Shingler), np.zeros(COUNTERS, np.uint32), [], 0

        def put():
            counts[:] += np.bincount(np.concatenate(held).astype(np.intp), minlength=COUNTERS).astype(np.uint32)

        for batch in batches:
            for lo, n_rows in slices(batch.column(2), TOGETHER):
                part = batch.slice(lo, n_rows)
                sets = shingler.sets(part.column(2).to_pylist())
                for s in sets:
                    held.append(s >> np.uint64(64 - COUNTERS.bit_length() + 1))
                    n += len(s)
                if n > 1_000_000:
                    put()
                    held, n = [], 0
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()), part.column(0), part.column(1), pa.array([name_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch_of(s) for s in sets], pa.binary())],
                    names=["chunk", "data", "doc_id", "tid", "sid", "n", "sketch"],
                )
            tidy()
        if held:
            put()
        for part in _chunks(np.minimum(counts, 255).astype(np.uint8)):
            none = [pa.nulls(part.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns, *none], names=["chunk", "data", "doc_id", "tid", "sid", "n", "sketch"])

    return docs.select("doc_id", "tid", "text").mapInArrow(run, _FIRST)


def levels(parts: DataFrame) -> np.ndarray:
    """How common a shingle is, by the top bits of its hash: 0 for up to twice the mean count, then by powers of two."""
    total = _merged(parts, add=True)
    mean = max(1.0, total.sum(dtype=np.float64) / len(total))
    out = np.zeros(len(total), np.uint8)
    for lo in range(0, len(total), CHUNK):  # as floating-point numbers all of them would take a hundred megabytes of the driver's memory
        part = slice(lo, lo + CHUNK)
        out[part] = np.floor(np.log2(np.maximum(total[part] / mean, 1)))
    return out


def _bits(ids: np.ndarray) -> np.ndarray:
    """The place of an id in the filter."""
    return (mixed(ids.view(np.uint64)) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.intp)


def row_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap that holds every ``tid`` of ``ids`` (and, by chance, others)."""

    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = _bits(batch.column(0).to_numpy())
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield from _chunks(bits)

    return _merged(ids.select("tid").mapInArrow(run, "chunk int, data binary"), add=False)


def _narrowed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` (tid, text) that ``ids`` names, and a few by chance: what a join with them need not shuffle."""
    shipped = texts.sparkSession.sparkContext.broadcast(row_filter(ids))

    def run(batches):
        for batch in batches:
            at = _bits(batch.column(0).to_numpy())
            yield batch.filter(pa.array((shipped.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))

    return texts.select("tid", "text").mapInArrow(run, "tid long, text string")


# --- blocks -----------------------------------------------------------------------------------------

_SHARES = "bucket int, hashes binary, owners binary, sids binary, sizes binary"


def _short(h: np.ndarray) -> bytes:
    """Hashes without their lowest 16 bits, which the bucket mostly holds; the rest may by chance make two shingles one, and a candidate more."""
    return h.view(np.uint16).reshape(-1, 4)[:, 1:].tobytes()


def _long(data) -> np.ndarray:
    out = np.zeros((len(data) // 6, 4), np.uint16)
    out[:, 1:] = np.frombuffer(data, np.uint16).reshape(-1, 3)
    return out.reshape(-1).view(np.uint64)


def _prefixes(docs: DataFrame, common: np.ndarray, bits: int, left_out: frozenset[int] = frozenset()) -> DataFrame:
    """Each bucket's share of prefix shingles with their owners; the sets named in ``left_out`` are passed over."""
    shipped = docs.sparkSession.sparkContext.broadcast(common)
    shift, mask = np.uint64(64 - COUNTERS.bit_length() + 1), np.uint64((1 << bits) - 1)

    def run(batches):
        shingler, level = worker_state("shingles", Shingler), shipped.value
        for batch in batches:
            for lo, n_rows in slices(batch.column(0), TOGETHER):
                sets = shingler.sets(batch.column(0).slice(lo, n_rows).to_pylist())
                names = [name_of(s) for s in sets]
                sizes = [len(s) for s in sets]
                first = {}
                for i, (x, n) in enumerate(zip(names, sizes, strict=True)):
                    if n and x not in first and x not in left_out:
                        first[x] = i
                own = list(first.values())
                picked, basic = [], []
                for i in own:
                    s, lv = sets[i], level[(sets[i] >> shift).astype(np.intp)]
                    p = prefix_length(len(s))
                    q = min(len(s), p + extra_length(len(s)))
                    picked.append(s[:q] if not lv.any() else s[np.argsort(lv, kind="stable")[:q]])
                    basic.append(np.arange(q) < p)
                if not picked:
                    continue
                h = np.concatenate(picked)
                o = np.repeat(np.arange(len(own), dtype=np.uint16), [len(p) for p in picked])
                first = np.concatenate(basic).astype(np.uint16) << np.uint16(15)
                bucket = (h & mask).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                h, o, first, bucket = h[order], o[order], first[order], bucket[order]
                cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(h)]
                all_s, all_n = np.array([names[i] for i in own], np.int64), np.array([sizes[i] for i in own], np.int32)
                rows = []
                for a, b in zip(cuts, cuts[1:], strict=False):
                    there, at = np.unique(o[a:b], return_inverse=True)
                    rows.append((int(bucket[a]), _short(h[a:b]), (at.astype(np.uint16) | first[a:b]).tobytes(), all_s[there].tobytes(), all_n[there].tobytes()))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "hashes", "owners", "sids", "sizes"])
            tidy()

    return docs.select("text").mapInArrow(run, _SHARES)


def _blocks(packed: DataFrame) -> DataFrame:
    """``block``, ``sid``, ``n``, ``shared``, ``degree``, rows of two kinds.

    With a block: a point of a block that has several, from the shorter prefixes, cut where sizes
    leave a gap; blocks with equal points get equal numbers, and are one. With a null block: how many
    shingles of a point's longer prefix in this bucket other points have too, and by how many.
    """

    def run(table: pa.Table) -> pa.Table:
        hs, ss, ns, fs = [], [], [], []
        for h, o, s, n in zip(*(table.column(c) for c in ("hashes", "owners", "sids", "sizes")), strict=True):
            at = np.frombuffer(o.as_buffer(), np.uint16)
            fs.append(at >> 15 > 0)
            at = at & np.uint16(0x7FFF)
            hs.append(_long(h.as_buffer()))
            ss.append(np.frombuffer(s.as_buffer(), np.int64)[at])
            ns.append(np.frombuffer(n.as_buffer(), np.int32)[at])
        h, s, n, f = np.concatenate(hs), np.concatenate(ss), np.concatenate(ns), np.concatenate(fs)
        # only shingles that occur twice can have two points
        order = np.argsort(h, kind="stable")
        h, s, n, f = h[order], s[order], n[order], f[order]
        same = h[1:] == h[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        h, s, n, f = h[twice], s[twice], n[twice], f[twice]
        order = np.lexsort((s, n, h))
        h, s, n, f = h[order], s[order], n[order], f[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        h, s, n, f = h[fresh], s[fresh], n[fresh], f[fresh]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (n[:-1].astype(np.int64) * 100 < n[1:].astype(np.int64) * THRESHOLD)
        group = np.cumsum(new) - 1
        lengths = np.bincount(group, minlength=0) if len(group) else np.zeros(0, np.int64)
        several = lengths[group] > 1 if len(group) else np.zeros(0, bool)
        who, inverse = np.unique(s[several], return_inverse=True)
        size = np.zeros(len(who), np.int32)
        size[inverse] = n[several]
        shared = np.bincount(inverse, minlength=len(who))
        degree = np.bincount(inverse, weights=lengths[group][several] - 1, minlength=len(who)).astype(np.int64)
        # blocks: members with the shingle in their shorter prefix
        keep = f & several
        s, n, group = s[keep], n[keep], group[keep]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(group)))
        number = np.add.reduceat(mixed(s.view(np.uint64) + _FACTORS[2]), starts) + lengths.astype(np.uint64) * _FACTORS[3] if len(starts) else np.zeros(0, np.uint64)
        once = np.zeros(len(starts), bool)
        once[np.unique(number, return_index=True)[1]] = True
        rows = np.repeat(once & (lengths > 1), lengths)
        block = np.repeat(number.view(np.int64), lengths)[rows]
        zero = np.zeros(len(block), np.int64)
        return pa.table(
            {
                "block": pa.concat_arrays([pa.array(block), pa.nulls(len(who), pa.int64())]),
                "sid": pa.array(np.concatenate([s[rows], who])),
                "n": pa.array(np.concatenate([n[rows], size])),
                "shared": pa.array(np.concatenate([zero, shared])),
                "degree": pa.array(np.concatenate([zero, degree])),
            }
        )

    return packed.groupBy("bucket").applyInArrow(run, "block long, sid long, n int, shared long, degree long")


def _open_blocks(found: DataFrame) -> DataFrame:
    """``block``, ``pivot``, ``sid``, ``n``, ``degree``: blocks of the points that share enough to have a link.

    The pivot is the point whose shingles most others have: of an original and its edited copies
    the original, which is nearer to the copies than these are to each other.
    """
    least = F.floor(F.ceil(F.col("n") * (THRESHOLD / 100) - 1e-9) * EXTRA / 100) + 1
    points = found.filter("block is null").groupBy("sid").agg(F.sum("shared").alias("shared"), F.sum("degree").alias("degree"), F.max("n").alias("n"))
    points = points.filter(F.col("shared") >= least).select("sid", "degree")
    rows = found.filter("block is not null").select("block", "sid", "n").dropDuplicates(["block", "sid"]).join(points, "sid")
    rows = written(rows, "blocks")
    pivots = rows.groupBy("block").agg(F.count("*").alias("k"), F.max(F.struct("degree", "sid")).alias("top")).filter("k > 1")
    return written(rows.join(pivots.select("block", F.col("top.sid").alias("pivot")), "block"), "blocks")


_MEMBERS = "cell long, salt int, member int, sid long, shingles binary"


def _measured(pairs: DataFrame, points: DataFrame, texts: DataFrame) -> DataFrame:
    """``a``, ``b``, ``common``, ``either``, for pairs of points: exact sizes of intersection and union.

    Points are (sid, tid), ``texts`` (tid, text), one row each. A text goes to the regions that
    need it and becomes a set there; in a region the pivot comes first and the members pass by it
    one at a time. Regions with many members are cut into parts with a copy of the pivot each.
    """
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / REGION).cast("int").alias("parts"))
    members = pairs.join(counts, "a").select(F.col("a").alias("cell"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("salt"), F.lit(1).alias("member"), F.col("b").alias("sid"))
    pivots = counts.select(F.col("a").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("a").alias("sid"))
    wanted = written(members.unionByName(pivots).join(points.select("sid", "tid"), "sid"), "members")

    def shingled(batches):
        shingler = worker_state("shingles", Shingler)
        for batch in batches:
            for lo, n_rows in slices(batch.column("text"), TOGETHER):
                part = batch.slice(lo, n_rows)
                sets = shingler.sets(part.column("text").to_pylist())
                # should two texts share a tid: the other's set has another name
                keep = [name_of(s) == x for s, x in zip(sets, part.column("sid").to_pylist(), strict=True)]
                part = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("cell", "salt", "member", "sid")), pa.array([s.tobytes() for s in sets], pa.binary())], ["cell", "salt", "member", "sid", "shingles"])
                yield part.filter(pa.array(keep, pa.bool_()))
            tidy()

    def compared(batches):
        place, pivot = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b, common, either = [], [], [], []
            for cell, salt, member, sid, s in zip(*(batch.column(c).to_pylist() for c in ("cell", "salt", "member", "sid")), batch.column("shingles"), strict=True):
                s = np.frombuffer(s.as_buffer(), np.uint64)
                if not member:
                    place, pivot = (cell, salt), s.copy()
                    continue
                if place != (cell, salt):
                    raise RuntimeError(f"the pivot {cell} of a region isn't there")
                both = np.concatenate([pivot, s])
                both.sort(kind="stable")
                k = int((both[1:] == both[:-1]).sum())
                a.append(cell)
                b.append(sid)
                common.append(k)
                either.append(len(both) - k)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(common, pa.int32()), pa.array(either, pa.int32())], ["a", "b", "common", "either"])

    found = _narrowed(texts, wanted.select("tid").distinct()).join(wanted, "tid")
    sets = found.mapInArrow(shingled, _MEMBERS)
    dealt = sets.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "member")
    return dealt.mapInArrow(compared, "a long, b long, common int, either int")


def _near(rows: DataFrame) -> DataFrame:
    """``a``, ``b``: pairs of a new pivot (role 0) and a member (role 1) of a block that may still be links.

    ``rows`` are (block, role, sid, n, c, d, sketch) with component c and distance d to the block's
    first pivot (null: unknown). Left out are pairs of one component, of sizes beyond the threshold's
    factor, outside the triangle inequality's window, and those whose sketches differ in more places
    than linked sets may differ in elements. Large blocks are cut, with a copy of the new pivots each.
    """
    parts = rows.filter("role = 1").groupBy("block").agg(F.ceil(F.count("*") / (4 * REGION)).cast("int").alias("parts"))
    rows = rows.join(parts, "block")
    salts = F.when(F.col("role") == 1, F.array(F.pmod(F.xxhash64("sid"), "parts").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = rows.withColumn("salt", F.explode(salts)).drop("parts").repartition("block", "salt").sortWithinPartitions("block", "salt", "role")
    radius = 1 - THRESHOLD / 100

    def compared(pivots, members):
        ps, pn, pcomp, pd, pk = pivots
        ms, mn, mcomp, md, mk = members
        out = set()
        for lo in range(0, len(ms), 64):
            k = slice(lo, lo + 64)
            total = pn[:, None] + mn[None, k]
            differ = np.bitwise_count(pk[:, None, :] ^ mk[None, k, :]).sum(axis=2, dtype=np.int64)
            ok = differ * (100 + THRESHOLD) <= total * (100 - THRESHOLD)
            ok &= (pcomp[:, None] != mcomp[None, k]) & (np.minimum(pn[:, None], mn[None, k]) * 100 >= np.maximum(pn[:, None], mn[None, k]) * THRESHOLD)
            ok &= ~(np.abs(pd[:, None] - md[None, k]) > radius + 1e-9)  # unknown distances are not numbers and exclude nothing
            i, j = np.nonzero(ok)
            out.update(zip(np.minimum(ps[i], ms[k][j]).tolist(), np.maximum(ps[i], ms[k][j]).tolist(), strict=True))
        return out

    def run(batches):
        place, pivots, ready = None, [], None
        for batch in batches:
            blocks, salt, role = batch.column("block").to_numpy(), batch.column("salt").to_numpy(), batch.column("role").to_numpy()
            sid, n, c = (batch.column(x).to_numpy().astype(np.int64) for x in ("sid", "n", "c"))
            d = batch.column("d").to_numpy(zero_copy_only=False).astype(np.float64)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(len(sid), -1)
            fresh = np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (salt[1:] != salt[:-1]) | (role[1:] != role[:-1])]) if len(sid) else np.zeros(0, bool)
            starts = np.flatnonzero(fresh)
            found = set()
            for lo, hi in zip(starts, np.append(starts[1:], len(sid)), strict=True):
                part = [x[lo:hi] for x in (sid, n, c, d, sketch)]
                here = (blocks[lo], salt[lo])
                if here != place:
                    place, pivots, ready = here, [], None
                if role[lo] == 0:
                    pivots.append(part)
                    continue
                if ready is None:
                    ready = [np.concatenate(x) for x in zip(*pivots, strict=True)] if pivots else None
                if ready is not None:
                    found |= compared(ready, part)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return dealt.select("block", "salt", "role", "sid", "n", "c", "d", "sketch").mapInArrow(run, "a long, b long").distinct()


def _hot_apart(rows: DataFrame, values: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """``rows`` joined with ``values`` (one row per key, ``weight``: rows that have it).

    Keys of very many rows are few (below HOT_SHARE of them, by their definition), so their values
    are broadcast and their rows stay where they are; the rest is shuffled.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = values.filter(F.col(weight) > limit)
    if hot.isEmpty():
        return rows.join(values, key)
    few = F.broadcast(hot)
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values.filter(F.col(weight) <= limit), key))


def _distance() -> Column:
    return 1 - F.col("common") / F.col("either")


class _Join:
    """The recursion: known distances, and the component of every point that has a link."""

    def __init__(self, points: DataFrame, texts: DataFrame):
        self.points, self.texts, self.known, self.of = points, texts, None, None

    def labelled(self, df: DataFrame, column: str, out: str) -> DataFrame:
        if self.of is None:
            return df.withColumn(out, F.col(column))
        step = self.of.select(F.col("node").alias(column), F.col("label").alias("__label"))
        return df.join(step, column, "left").withColumn(out, F.coalesce("__label", column)).drop("__label")

    def measure(self, pairs: DataFrame) -> None:
        """Compute the distances of new pairs, and join what they link."""
        pairs = written(pairs, "pairs")
        if pairs.isEmpty():
            if self.of is None:
                self.of = pairs.select(F.col("a").alias("node"), F.col("b").alias("label"))
                self.known = pairs.select("a", "b", F.lit(0).alias("common"), F.lit(1).alias("either"))
            return
        found = written(_measured(pairs, self.points, self.texts), "distances")
        release(found.sparkSession)
        self.known = found if self.known is None else self.known.unionByName(found)
        links = found.filter(F.col("common").cast("long") * 100 >= F.col("either").cast("long") * THRESHOLD).select("a", "b")
        if self.of is None:
            self.of = components(links)
            return
        links = self.labelled(self.labelled(links, "a", "x"), "b", "y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        step = components(links)
        old = self.of.join(step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        # labels of the last round may themselves be points that had no link until now
        fresh = step.join(self.of.select("node"), "node", "left_anti").select("node", "label")
        self.of = written(old.unionByName(fresh), "components")


def _linked(points: DataFrame, texts: DataFrame, blocks: DataFrame) -> _Join:
    """The join of all points, by cells, border points and recursion."""
    join = _Join(points, texts)

    # every point meets the pivot that it shares most blocks with
    hubs = blocks.filter("sid = pivot").select("pivot", F.col("degree").alias("hub")).distinct()
    pairs = blocks.filter("sid <> pivot").groupBy("pivot", "sid").agg(F.count("*").alias("k")).join(hubs, "pivot")
    pairs = written(pairs.select("pivot", "sid", "k", F.col("hub").alias("degree")), "pairs")
    cells = pairs.groupBy("sid").agg(F.max(F.struct("k", "degree", "pivot")).alias("m")).select(F.col("m.pivot").alias("a"), F.col("sid").alias("b"))
    join.measure(cells)

    # border points meet the pivots of other components whose regions they reach
    own = join.known.select(F.col("a").alias("own"), "b", _distance().alias("d"))
    border = join.labelled(join.labelled(pairs.select(F.col("pivot").alias("a"), F.col("sid").alias("b")), "a", "x"), "b", "y").filter("x <> y").select("a", "b")
    border = written(border.join(join.known.select("a", "b"), ["a", "b"], "left_anti").join(own, "b", "left"), "border")
    between = border.filter("own is not null").groupBy(F.least("own", "a").alias("a"), F.greatest("own", "a").alias("b")).agg(F.count("*").alias("k")).filter(F.col("k") >= BETWEEN).select("a", "b")
    join.measure(between.join(join.known.select("a", "b"), ["a", "b"], "left_anti"))
    apart = join.known.select(F.col("a").alias("lo"), F.col("b").alias("hi"), _distance().alias("dp"))
    border = border.withColumn("lo", F.least("own", "a")).withColumn("hi", F.greatest("own", "a")).join(apart, ["lo", "hi"], "left")
    r = 1 - THRESHOLD / 100
    rest = border.filter(F.col("dp").isNull() | (F.col("dp") - 2 * F.col("d") <= 2 * r + 1e-9)).select("a", "b")
    rest = join.labelled(join.labelled(rest, "a", "x"), "b", "y").filter("x <> y").select("a", "b")
    join.measure(rest.join(join.known.select("a", "b"), ["a", "b"], "left_anti"))

    # blocks that still hold several components: their other points become pivots
    open_rows = blocks
    done = None
    while True:
        now = written(join.labelled(join.labelled(open_rows, "sid", "c"), "pivot", "pc"), "open")
        several = now.groupBy("block").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo <> hi").select("block")
        outside = now.filter("c <> pc")
        if done is not None:
            outside = outside.join(done, ["block", "sid"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("block").orderBy(F.col("degree").desc(), "sid"))
        new = written(outside.withColumn("r", rank).filter(F.col("r") <= NEW_PIVOTS).drop("r"), "pivots")
        if new.isEmpty():
            break
        used = new.select("block", "sid")
        done = used if done is None else done.unionByName(used)
        open_rows = written(now.join(several, "block", "left_semi").drop("c", "pc"), "open")
        met = now.join(new.select("block").distinct(), "block", "left_semi").withColumn("role", F.lit(1)).unionByName(new.withColumn("role", F.lit(0)))
        d = join.known.groupBy(F.col("a").alias("pivot"), F.col("b").alias("sid")).agg(F.first(_distance()).alias("d"))
        met = met.join(d, ["pivot", "sid"], "left").join(points.select("sid", "sketch"), "sid")
        join.measure(_near(met.select("block", "role", "sid", "n", "c", "d", "sketch")).join(join.known.select("a", "b"), ["a", "b"], "left_anti"))
    return join


def join_components(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, one row per row of ``docs`` (any order).

    Links: Jaccard similarity of the shingle sets of at least THRESHOLD hundredths, computed in
    whole numbers. A text with fewer than five words has one shingle, its whole sequence; null and
    empty texts and texts of white space have none and link with nothing. Equal sets link. A row
    with a null id takes part, but no component is named after it (one of null ids only is null).
    Rows that repeat an id are points of their own with that id. Other columns are ignored.
    """
    tid = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col(text))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), tid.alias("tid"))
    spark = docs.sparkSession
    first = written(_first_pass(docs), "first")
    common = levels(first.filter("chunk is not null").select("chunk", "data"))
    seen = first.filter("chunk is null")
    marks = written(seen.select("doc_id", "sid", "n"), "marks")
    # one row per distinct set; of a set that very many rows have, one row is cut into shingles
    sets = seen.filter("n > 0").groupBy("sid").agg(F.count("*").alias("rows"), F.min("doc_id").alias("low"), F.min("tid").alias("tid"), F.first("sketch").alias("sketch"))
    sets = written(sets, "sets")
    discard(first)
    release(spark)
    count = marks.count()
    bits = min(30, max(6, math.ceil(math.log2(max(1, count * 100 / BUCKET)))))
    hot = sets.filter(F.col("rows") > max(HOT_ROWS, count // HOT_SHARE)).select("sid", "tid").collect()
    shares = _prefixes(docs, common, bits, frozenset(r["sid"] for r in hot))
    if hot:
        one_each = docs.filter(F.col("tid").isin([r["tid"] for r in hot])).dropDuplicates(["tid"])
        shares = shares.unionByName(_prefixes(one_each, common, bits))
    table = written(shares, "prefixes")
    found = written(_blocks(table), "found")
    discard(table)
    del table, first, seen
    release(spark)
    blocks = _open_blocks(found)
    discard(found)
    del found
    points = written(sets.join(blocks.select("sid").distinct(), "sid", "left_semi").select("sid", "tid", "sketch"), "points")
    texts = written(_narrowed(docs, points).dropDuplicates(["tid"]), "texts")
    release(spark)
    with plain_plans(spark):
        join = _linked(points, texts, blocks)

    named = written(join.labelled(sets.select("sid", "rows", "low"), "sid", "label"), "named")
    smallest = named.groupBy("label").agg(F.min("low").alias("component_id"), F.count("*").alias("sets"))
    of = _hot_apart(named, smallest, "label", "sets", count).select("sid", "rows", "component_id")
    of = written(of, "of")
    linked = _hot_apart(marks.filter("n > 0").select("doc_id", "sid", "n"), of, "sid", "rows", count).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    tidy()
    alone = marks.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_per_component(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, whose doc_id names their component: one document of each group.

    Rows without words are groups of their own. Rows with a null id stay only where their group has
    no other id. Rows that repeat the id that names a group are one document and all stay.
    """
    found = join_components(docs, text)
    name = fresh_name(docs, "id")
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay[name]), "left_semi")
