"""Line alignment of two transcriptions and matched-block rates: the parts that need sequence matching.

These are the library's only functions that leave the JVM for its own operators, as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells of a similarity table up to which all like pairs are matched; beyond, only those that may be in the heaviest chain.
MAX_CELLS = 15_000
#: Cells of a table that are held at once, and cells of which a first chain is followed back.
BAND, TRACED = 1 << 20, 1 << 24
#: Cells of two sequences up to which difflib alone matches them, and pairs of equal windows up to which runs are listed.
SMALL, MAX_PAIRS = 40_000, 4_000_000
DIFF = "array<struct<kind:string,text_a:string,text_b:string,similarity:double>>"
#: Rows of an Arrow batch that are Python objects at one time; and of pairs of texts that are all short.
SLICE, SHORT_SLICE = 256, 2048
#: Bytes of an Arrow batch that are Python objects at one time, about, a row at least.
SLICE_BYTES = 1 << 19


def ratio_of(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity, in the order given; two empty texts are equal."""
    if not a or not b:
        return float(a == b)
    if a in b or b in a:  # the shorter is the longest match, and nothing of it is left
        return 2.0 * min(len(a), len(b)) / (len(a) + len(b))
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def ratios_of(pairs: list[tuple[str, str]]) -> list[float]:
    """``ratio_of`` of many pairs; those of which neither holds the other are matched at once."""
    from quire.operators import blocks

    hard = [k for k, (a, b) in enumerate(pairs) if a not in b and b not in a]
    matched = blocks.matched_characters([pairs[k][0] for k in hard], [pairs[k][1] for k in hard]) if len(hard) > 1 else []
    found = dict(zip(hard, matched, strict=False))
    return [2.0 * found[k] / (len(a) + len(b)) if k in found else ratio_of(a, b) for k, (a, b) in enumerate(pairs)]


def _only(kind: str, lines: list[str]) -> list[tuple]:
    return [(kind, *((x, "") if kind == "only_a" else ("", x)), 0.0) for x in lines]


def _like_pairs(a: list[str], b: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line of a, line of b, ratio) of all pairs that reach ``least``, by both numbers.

    A ratio is at most what the letters alone allow, so whole tables of letter counts rule most
    pairs out before any is matched.
    """
    letters = {c: i for i, c in enumerate(sorted(set("".join(a) + "".join(b))))}
    count = [np.array([np.bincount([letters[c] for c in x], minlength=len(letters)) for x in side]) for side in (a, b)]
    size = [c.sum(axis=1) for c in count]
    total = size[0][:, None] + size[1][None, :]
    shared = np.stack([np.minimum(row, count[1]).sum(axis=1) for row in count[0]])
    rows, cols = np.nonzero(2.0 * shared >= least * total * (1 - 1e-12))
    found: dict[tuple[int, int], float] = {}
    for j in np.unique(cols).tolist():
        matcher = SequenceMatcher(None, autojunk=False)
        matcher.set_seq2(b[j])  # what is prepared belongs to the second sequence
        for i in rows[cols == j].tolist():
            matcher.set_seq1(a[i])
            found[i, j] = matcher.ratio()
    kept = sorted(p for p, r in found.items() if r >= least and r > 0)
    return (*np.array(kept, np.int64).reshape(-1, 2).T, np.array([found[p] for p in kept]))


def _chain_pairs(a: list[str], b: list[str], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of ``_like_pairs`` that may be in a chain of greatest total.

    What the letters allow bounds each ratio, and so each chain before and after a pair. A pair whose
    bounds together are below the total of some chain is in no heaviest one. Bounds are made a band of
    rows at a time, forwards and then backwards; only one row of each band is kept meanwhile.
    """
    letters = {c: i for i, c in enumerate(sorted(set("".join(a) + "".join(b))))}
    count = [np.array([np.bincount([letters[c] for c in x], minlength=len(letters)) for x in side], np.int32) for side in (a, b)]
    size = [c.sum(axis=1) for c in count]
    n, m = len(a), len(b)
    band = max(1, BAND // m)

    def bounds(i: int) -> np.ndarray:
        r = 2.0 * np.minimum(count[0][i], count[1]).sum(axis=1) / (size[0][i] + size[1])
        return np.where(r >= least * (1 - 1e-12), r, 0.0)

    def onwards(before: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.maximum(before, np.r_[0.0, before[:-1] + r]))

    first, line = [], np.zeros(m + 1)
    taken = np.zeros((n, m + 1), bool) if n * m <= TRACED else None
    up = np.zeros((n, m + 1), bool) if n * m <= TRACED else None
    for i in range(n):
        if i % band == 0:
            first.append(line)
        r = bounds(i)
        now = onwards(line, r)
        if taken is not None:
            up[i] = now == line
            taken[i, 1:] = (now[1:] == line[:-1] + r) & ~up[i, 1:]
        line = now
    # totals of some chains: by place from either end, and of the bounds' own heaviest one
    both = min(n, m)
    chains = [[(k, k) for k in range(both)], [(n - both + k, m - both + k) for k in range(both)], []]
    i, j = n, m
    while taken is not None and i and j:
        if taken[i - 1, j]:
            i, j = i - 1, j - 1
            chains[2].append((i, j))
        elif up[i - 1, j]:
            i -= 1
        else:
            j -= 1
    known = ratios_of([(a[x], b[y]) for chain in chains for x, y in chain])
    cuts = np.cumsum([0] + [len(c) for c in chains])
    total = max(sum(r for r in known[lo:hi] if r >= least) for lo, hi in pairwise(cuts))
    found, after = [], np.zeros(m + 1)
    for at in range(len(first) - 1, -1, -1):
        lo, hi = at * band, min(n, at * band + band)
        table, lines = [bounds(i) for i in range(lo, hi)], [first[at]]
        for r in table[:-1]:
            lines.append(onwards(lines[-1], r))
        for i in range(hi - 1, lo - 1, -1):
            r = table[i - lo]
            cols = np.flatnonzero((r > 0) & (lines[i - lo][:-1] + r + after[1:] >= total * (1 - 1e-9)))
            found += [(i, j) for j in cols.tolist()]
            after = onwards(after[::-1], r[::-1])[::-1]
    found.sort()
    out = []
    for at in range(0, len(found), SHORT_SLICE):
        some = found[at : at + SHORT_SLICE]
        out += [(i, j, r) for (i, j), r in zip(some, ratios_of([(a[i], b[j]) for i, j in some]), strict=True) if r >= least and r > 0]
    rows, cols, ratios = (np.array([x[k] for x in out], kind) for k, kind in ((0, np.int64), (1, np.int64), (2, np.float64)))
    return rows, cols, ratios


def _chain_weights(rows: np.ndarray, cols: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """For each pair the greatest sum of ratios of a chain that begins with it, both numbers rising.

    Pairs are taken by falling row; a Fenwick tree over the columns, from the right, holds the
    greatest weight of a chain that begins right of a column.
    """
    width = int(cols.max()) + 1 if len(cols) else 0
    tree, weight = [0.0] * (width + 1), np.zeros(len(rows))
    hi = len(rows)
    while hi:
        lo = int(np.searchsorted(rows, rows[hi - 1], side="left"))
        for k in range(lo, hi):  # a row's pairs don't chain with each other
            at, best = width - 1 - int(cols[k]), 0.0
            while at > 0:
                best = max(best, tree[at])
                at &= at - 1
            weight[k] = ratios[k] + best
        for k in range(lo, hi):
            at = width - int(cols[k])
            while at <= width:
                tree[at] = max(tree[at], weight[k])
                at += at & -at
        hi = lo
    return weight


def aligned_block(a: list[str], b: list[str], least: float) -> list[tuple]:
    """Order-preserving pairs of greatest total similarity, pairs below ``least`` never counted.

    Of several chains of that total, where the next line of b is the partner in some, the one with
    the first such line of a; else the one that leaves out most lines of a here, then fewest of b.
    Left-out lines of a stand before those of b. Of blocks of more than MAX_CELLS pairs only those are
    matched that may belong to such a chain, with the same result.
    """
    rows, cols, ratios = (_like_pairs if len(a) * len(b) <= MAX_CELLS else _chain_pairs)(a, b, least)
    weight = _chain_weights(rows, cols, ratios)
    out, i, j = [], 0, 0
    while True:
        ahead = np.flatnonzero((rows >= i) & (cols >= j))
        if not len(ahead):
            break
        best = ahead[weight[ahead] == weight[ahead].max()]
        beside = best[cols[best] == j]
        k = int(beside[rows[beside].argmin()] if len(beside) else min(best, key=lambda k: (-rows[k], cols[k])))
        out += _only("only_a", a[i : rows[k]]) + _only("only_b", b[j : cols[k]])
        out.append(("changed", a[rows[k]], b[cols[k]], float(ratios[k])))
        i, j = int(rows[k]) + 1, int(cols[k]) + 1
    return out + _only("only_a", a[i:]) + _only("only_b", b[j:])


def opcodes(a: list[str], b: list[str]) -> list[tuple[str, int, int, int, int]]:
    """difflib's opcodes of two lists of lines.

    Where each common line occurs once on either side and all stand in one order, difflib matches
    just these: whatever block it takes has as many of the rest before it in both, and after it.
    """
    at = {x: j for j, x in enumerate(b)}
    common = [(i, at[x]) for i, x in enumerate(a) if x in at]
    straight = all(p[1] < q[1] for p, q in pairwise(common))
    if straight and len(at) < len(b):
        both = {a[i] for i, _ in common}
        straight = sum(x in both for x in b) == len(common)
    if not straight:
        return SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    out, i, j = [], 0, 0
    for x, y in [*common, (len(a), len(b))]:
        if i < x or j < y:
            out.append(("replace" if i < x and j < y else "delete" if i < x else "insert", i, x, j, y))
        if x < len(a):
            out.append(("equal", x, x + 1, y, y + 1))
        i, j = x + 1, y + 1
    return out


def diff_rows(a: list[str], b: list[str], least: float = 0.55, ratios: Iterator[float] | None = None) -> list[tuple]:
    """(kind, text_a, text_b, similarity) rows that align two lists of normalised lines; ``ratios`` of ``lone_pairs``, if known."""
    if not a or not b:
        return _only("only_a", a) + _only("only_b", b)
    out = []
    for tag, i, i2, j, j2 in opcodes(a, b):
        if tag == "equal":
            out += [("equal", x, y, 1.0) for x, y in zip(a[i:i2], b[j:j2], strict=True)]
        elif tag == "replace" and i2 - i == j2 - j == 1:
            r = ratio_of(a[i], b[j]) if ratios is None else next(ratios)
            out += [("changed", a[i], b[j], r)] if r >= least and r > 0 else _only("only_a", a[i:i2]) + _only("only_b", b[j:j2])
        elif tag == "replace":
            out += aligned_block(a[i:i2], b[j:j2], least)
        else:
            out += _only("only_a", a[i:i2]) + _only("only_b", b[j:j2])
    return out


def lone_pairs(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """The changed blocks of one line on either side, in order."""
    if not a or not b:
        return []
    return [(a[i], b[j]) for tag, i, i2, j, j2 in opcodes(a, b) if tag == "replace" and i2 - i == j2 - j == 1]


def _located(rows: list[tuple]) -> list[tuple[int, int, float]]:
    """Rows as places in both lists, -1 where a side has no line: rows take the lines of each list in order."""
    out, i, j = [], 0, 0
    for kind, _, _, r in rows:
        out.append((-1 if kind == "only_b" else i, -1 if kind == "only_a" else j, r))
        i, j = i + (kind != "only_b"), j + (kind != "only_a")
    return out


def _matched(a: list, b: list) -> int:
    return sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def _runs(a: np.ndarray, b: np.ndarray, doublings: int) -> np.ndarray | None:
    """Rows (i, j, length) of all maximal equal runs of at least 2 ** doublings elements; None if they are too many."""
    ids, n = np.concatenate([a, [-1], b]), len(a)
    for k in range(doublings):
        ids = ids - ids.min()
        ids = np.unique(ids[: -(2**k)] * (int(ids.max()) + 1) + ids[2**k :], return_inverse=True)[1]
    t = 2**doublings
    x, y = ids[: n - t + 1], ids[n + 1 :]
    order = np.argsort(y, kind="stable")
    first, last = np.searchsorted(y[order], x, "left"), np.searchsorted(y[order], x, "right")
    count = last - first
    if count.sum() > MAX_PAIRS:
        return None
    i = np.repeat(np.arange(len(x)), count)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    starts = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (np.diff(i) != 1)][: len(i)])
    return np.stack([i[starts], j[starts], np.diff(np.r_[starts, len(i)]) + t - 1], 1)


def matched_size(a: list, b: list) -> int:
    """Elements in difflib's matching blocks, without its walk over all equal pairs for long sequences.

    While a stretch holds a match of a window's length, its longest match is looked up among the
    maximal runs, cut to the stretch; ties go to the first in ``a``, then in ``b``, as in difflib,
    which matches what is left.
    """
    if len(a) * len(b) <= SMALL:
        return _matched(a, b)
    code: dict = {}
    u, v = (np.array([code.setdefault(x, len(code)) for x in s]) for s in (a, b))
    doublings = 3 if len(code) <= 64 else 2
    t = 2**doublings
    runs = _runs(u, v, doublings) if min(len(a), len(b)) >= t else None
    if runs is None:
        return _matched(a, b)
    total, stack = 0, [(0, len(a), 0, len(b), runs)]
    while stack:
        alo, ahi, blo, bhi, r = stack.pop()
        i, j, n = r[:, 0], r[:, 1], r[:, 2]
        skip = np.maximum(0, np.maximum(alo - i, blo - j))
        size = np.minimum(n, np.minimum(ahi - i, bhi - j)) - skip
        r, i, j, size = (x[size >= t] for x in (r, i + skip, j + skip, size))
        if not len(r):
            if alo < ahi and blo < bhi:
                total += _matched(a[alo:ahi], b[blo:bhi])
            continue
        k = int(size.max())
        best = np.flatnonzero(size == k)
        x, y = min(zip(i[best].tolist(), j[best].tolist(), strict=True))
        total += k
        stack += [(alo, x, blo, y, r), (x + k, ahi, y + k, bhi, r)]
    return total


def _slices(*columns: pa.Array, rows: int = SLICE) -> Iterator[list]:
    """Rows as Python objects, some at a time: a batch is never held as objects whole."""
    rows = max(1, min(rows, SLICE_BYTES * len(columns[0]) // max(1, sum(c.nbytes for c in columns))))
    for at in range(0, len(columns[0]), rows):
        yield list(zip(*(c.slice(at, rows).to_pylist() for c in columns), strict=True))


def ratio(a: str | Column, b: str | Column) -> Column:
    """``ratio_of`` of two columns, null as empty; a text that holds the other needs no matching and stays in the JVM."""
    x, y = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (a, b))

    @F.arrow_udf("double")
    def run(p: pa.Array, q: pa.Array) -> pa.Array:
        from quire.operators import blocks

        there = pc.and_(p.is_valid(), q.is_valid())
        x, y = p.filter(there), q.filter(there)
        longest = max(pc.max(pc.binary_length(c)).as_py() or 0 for c in (x, y))
        found = np.full(len(p), np.nan)
        known = [r for rows in _slices(x, y, rows=SHORT_SLICE if longest <= blocks.SHORT else SLICE) for r in ratios_of(rows)]
        found[there.to_numpy(zero_copy_only=False)] = known
        return pa.array(found, mask=~there.to_numpy(zero_copy_only=False))

    n, m = F.length(x), F.length(y)
    empty, held = (n == 0) | (m == 0), F.contains(x, y) | F.contains(y, x)
    plain = F.when(empty, (x == y).cast("double")).when(held, 2.0 * F.least(n, m) / (n + m))
    hard = ~empty & ~held
    return F.coalesce(plain, run(F.when(hard, x), F.when(hard, y)))


def diff(a: str | Column, b: str | Column, least: float = 0.55) -> Column:
    """The alignment of two columns of line arrays (DIFF), null where one is null.

    Only places and similarities come back from Python, in columns; the JVM takes the lines from the arrays.
    """

    @F.arrow_udf("array<struct<i:int,j:int,similarity:double>>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        sizes, found = [], []
        for rows in _slices(x, y):
            some = [None if p is None or q is None else (p, q) for p, q in rows]
            known = iter(ratios_of([r for pair in some if pair for r in lone_pairs(*pair)]))
            each = [None if pair is None else _located(diff_rows(*pair, least, known)) for pair in some]
            sizes += [None if r is None else len(r) for r in each]
            flat = np.array([v for r in each if r for v in r], np.float64).reshape(-1, 3)
            found.append(pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.int32)), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2])], ["i", "j", "similarity"]))
        places = pa.concat_arrays(found) if found else pa.array([], pa.struct([("i", pa.int32()), ("j", pa.int32()), ("similarity", pa.float64())]))
        ends = np.cumsum([0] + [n or 0 for n in sizes]).astype(np.int32)
        none = pa.array([n is None for n in sizes], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(ends), places, mask=none)

    left, right = (F.col(c) if isinstance(c, str) else c for c in (a, b))

    def row(d: Column) -> Column:
        text = lambda side, at: F.when(at < 0, "").otherwise(F.get(side, at))
        kind = F.when(d["j"] < 0, "only_a").when(d["i"] < 0, "only_b").when(F.get(left, d["i"]) == F.get(right, d["j"]), "equal").otherwise("changed")
        return F.struct(kind.alias("kind"), text(left, d["i"]).alias("text_a"), text(right, d["j"]).alias("text_b"), d["similarity"].alias("similarity"))

    return F.transform(run(left, right), row).cast(DIFF)
