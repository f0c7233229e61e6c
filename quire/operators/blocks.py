"""Sizes of difflib's matching blocks for many pages at once.

Windows of some elements are seeds: their hashes, with the page's, are sorted with both sides' places,
and a window that a page has once on either side is an anchor. Anchors side by side on a diagonal
merge into runs. A run is taken whole by difflib, which goes from the longest match to shorter ones,
if it overlaps and crosses no other run with an anchor and is longer than any run without one can be:
windows that occur on both sides but not once, side by side, bound these. What lies between such runs
is matched as if it stood alone, mostly a few elements.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from quire.operators import align

#: Elements of a window, as a power of two: of characters and of words.
CHARACTERS, WORDS = 4, 2
#: Characters of texts that are matched by tables of their equal runs, and cells of the tables that are made at once, about.
SHORT, CELLS = 250, 1 << 18
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[0]
    return h ^ (h >> np.uint64(29))


def _windows(codes: np.ndarray, bounds: np.ndarray, doublings: int) -> tuple[np.ndarray, np.ndarray]:
    """(places where a whole window begins within its page, their hashes)."""
    w = 1 << doublings
    h = codes.astype(np.uint64)
    h += _ODD[1]
    for k in range(doublings):
        n = 1 << k
        if len(h) <= n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        g = h[:-n] * _ODD[2 + k]
        g += h[n:]
        h = g
    # the last places of a page begin no window; the page's number is part of each hash
    whole = np.ones(len(h), bool)
    for k in range(1, w):
        ends = bounds[1:] - k
        whole[ends[(ends >= 0) & (ends < len(h))]] = False
    number = np.zeros(len(h), np.uint64)
    heads = np.unique(bounds[:-1])
    at = np.searchsorted(bounds[:-1], heads, side="right") - 1  # of pages that begin there all but the last are empty
    some = heads < len(h)
    number[heads[some]] = np.diff(at[some], prepend=0).astype(np.uint64)
    np.cumsum(number, out=number)
    number *= _ODD[1]
    h += number
    places = np.flatnonzero(whole)
    return places, _mixed(h[places])


def _pieces(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _grown(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray, step: int) -> np.ndarray:
    """Equal elements from i and j on, in steps of 1 or -1, up to the stops."""
    room = np.minimum((stop_a - i) * step, (stop_b - j) * step)
    grown, some, span = np.zeros(len(i), np.int64), np.arange(len(i)), 1
    while len(some):
        k = grown[some][:, None] + np.arange(span)
        inside = k < room[some][:, None]
        k *= inside
        same = np.zeros(k.shape, bool)
        x, y = (i[some][:, None] + step * k)[inside], (j[some][:, None] + step * k)[inside]
        same[inside] = a[x] == b[y]
        n = np.where(same.all(axis=1), span, same.argmin(axis=1))
        grown[some] += n
        some, span = some[n == span], min(512, span * 4)
    return grown


def _between(a: np.ndarray, b: np.ndarray) -> int:
    """difflib's matched elements of two mostly short stretches."""
    if not len(a) or not len(b):
        return 0
    x, y = a.tolist(), b.tolist()
    if set(x).isdisjoint(y):
        return 0
    return 1 if len(x) == 1 or len(y) == 1 else align.matched_size(x, y)


def matched_sizes(a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray, doublings: int) -> np.ndarray:
    """For each page the elements in difflib's matching blocks; page p has ``a[a_bounds[p]:a_bounds[p + 1]]`` and as much of b."""
    pages, w = len(a_bounds) - 1, 1 << doublings
    page_a, page_b = (np.repeat(np.arange(pages), np.diff(x)) for x in (a_bounds, b_bounds))
    (at_a, h_a), (at_b, h_b) = _windows(a, a_bounds, doublings), _windows(b, b_bounds, doublings)
    bits = np.uint64(max(len(a), len(b), 1).bit_length() + 1)
    place = (np.uint64(1) << (bits - np.uint64(1))) - np.uint64(1)
    keep = ~((np.uint64(1) << bits) - np.uint64(1))
    keys = np.sort(np.concatenate([(h_a & keep) | at_a.astype(np.uint64), (h_b & keep) | (place + np.uint64(1)) | at_b.astype(np.uint64)]))
    first = np.flatnonzero(np.r_[True, (keys[1:] >> bits) != (keys[:-1] >> bits)][: len(keys)])
    size = np.diff(np.r_[first, len(keys)])
    theirs = (keys & (place + np.uint64(1))) != 0
    both = ~theirs[first] & theirs[first + size - 1] if len(first) else np.zeros(0, bool)
    once = first[both & (size == 2)]
    partner = np.full(len(a), -1, np.int64)
    partner[(keys[once] & place).astype(np.int64)] = (keys[once + 1] & place).astype(np.int64)
    i = np.flatnonzero(partner >= 0)
    i = i[page_a[i] == page_b[partner[i]]]  # hashes of two pages may agree
    j = partner[i]
    # the longest run without an anchor, at most: by page
    several = _pieces(first[both & (size > 2)], size[both & (size > 2)])
    repeated = np.zeros(len(a) + 1, bool)
    repeated[(keys[several[~theirs[several]]] & place).astype(np.int64)] = True
    edges = np.flatnonzero(np.diff(np.r_[False, repeated].astype(np.int8)))
    most = np.full(pages, w - 1, np.int64)
    if len(edges):
        np.maximum.at(most, page_a[edges[::2]], edges[1::2] - edges[::2] + w - 1)
    # runs of anchors, with the equal elements round them
    starts = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(j) != 1)][: len(i)])
    n = np.diff(np.r_[starts, len(i)]) + w - 1
    i, j = i[starts], j[starts]
    page = page_a[i]
    same = np.add.reduceat(a[_pieces(i, n)] != b[_pieces(j, n)], np.cumsum(n) - n) if len(n) else np.zeros(0)
    false = np.zeros(pages, bool)
    false[page[same > 0]] = True  # two windows of one hash: the page is matched whole
    i, j, n, page = (x[~false[page]] for x in (i, j, n, page))
    right = _grown(a, b, i + n, j + n, a_bounds[page + 1], b_bounds[page + 1], 1)
    left = _grown(a, b, i - 1, j - 1, a_bounds[page] - 1, b_bounds[page] - 1, -1)
    i, j, n = i - left, j - left, n + left + right
    _, one = np.unique(i * (len(b) + 1) + j, return_index=True)  # runs that have grown together; by i
    i, j, n, page = (x[one] for x in (i, j, n, page))
    # apart from all runs before and after, on both sides; pages follow each other on both, too
    before = [np.r_[-1, np.maximum.accumulate(x + n)][: len(n)] for x in (i, j)]
    after = [np.r_[np.minimum.accumulate(x[::-1])[::-1], np.iinfo(np.int64).max][1:] for x in (i, j)]
    sure = (before[0] <= i) & (before[1] <= j) & (after[0] >= i + n) & (after[1] >= j + n) & (n > most[page])
    i, j, n, page = (x[sure] for x in (i, j, n, page))
    total = np.bincount(page, n, minlength=pages).astype(np.int64)
    # what is left: before the first run of a page, between its runs, after the last
    begin_a, begin_b = np.r_[i + n, a_bounds[:-1]], np.r_[j + n, b_bounds[:-1]]
    of = np.r_[page, np.arange(pages)]
    order = np.lexsort((begin_a, of))
    begin_a, begin_b, of = begin_a[order], begin_b[order], of[order]
    last = np.r_[of[1:] != of[:-1], True]
    end_a, end_b = a_bounds[of + 1].copy(), b_bounds[of + 1].copy()
    inner = np.flatnonzero(~last)
    end_a[inner], end_b[inner] = i, j  # the k-th stretch of a page ends where its k-th run begins
    for k in np.flatnonzero((end_a > begin_a) & (end_b > begin_b)).tolist():
        total[of[k]] += _between(a[begin_a[k] : end_a[k]], b[begin_b[k] : end_b[k]])
    return total


def _bounds(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)


def unmatched_shares(reference: list[list[str]], hypothesis: list[list[str]]) -> np.ndarray:
    """For each pair of lists of words the share of the first outside the matching blocks; insertions cost nothing."""
    sizes = [list(map(len, side)) for side in (reference, hypothesis)]
    words = [w for side in (reference, hypothesis) for x in side for w in x]
    codes = pd.factorize(np.array(words, dtype=object))[0] if words else np.zeros(0, np.int64)
    cut = sum(sizes[0])
    return _shares(codes[:cut], sizes[0], codes[cut:], sizes[1], WORDS)


def unmatched_characters(reference: list[str], hypothesis: list[str]) -> np.ndarray:
    """The same for the characters of pairs of texts."""
    codes = [np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), np.uint32) for side in (reference, hypothesis)]
    return _shares(codes[0], list(map(len, reference)), codes[1], list(map(len, hypothesis)), CHARACTERS)


def matched_characters(a: list[str], b: list[str]) -> list[int]:
    """For each pair of texts the characters in difflib's matching blocks."""
    short = [len(x) <= SHORT and len(y) <= SHORT for x, y in zip(a, b, strict=True)]
    if any(short):
        found = iter(matched_short(*([x for x, few in zip(side, short, strict=True) if few] for side in (a, b))).tolist())
        rest = [] if all(short) else matched_characters(*([x for x, few in zip(side, short, strict=True) if not few] for side in (a, b)))
        others = iter(rest)
        return [next(found) if few else next(others) for few in short]
    sides = [np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), np.uint32) for side in (a, b)]
    return matched_sizes(sides[0], _bounds(list(map(len, a))), sides[1], _bounds(list(map(len, b))), 3).tolist()


def _longest(a: np.ndarray, b: np.ndarray, alo: np.ndarray, blo: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in a and b, length) of the longest match of each pair of stretches, the first in a, then in b; ``n`` falls.

    Lengths of the equal runs that end at a place of a are kept for all places of b and all stretches.
    """
    width, none = int(m.max()), np.iinfo(b.dtype).max
    at = np.arange(width)[:, None]
    theirs = np.where(at < m, b[np.minimum(blo + at, len(b) - 1)], none)
    runs, last = np.zeros((width + 1, len(n)), np.uint8), np.zeros((width + 1, len(n)), np.uint8)
    size, end_a, end_b = np.zeros(len(n), np.uint8), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    for i in range(int(n[0])):
        k = int(np.searchsorted(-n, -i, side="left"))  # stretches that are longer
        np.add(last[:-1, :k], 1, out=runs[1:, :k])
        runs[1:, :k] *= theirs[:, :k] == a[alo[:k] + i]
        top = runs[:, :k].max(axis=0)
        more = np.flatnonzero(top > size[:k])
        if len(more):
            size[more], end_a[more], end_b[more] = top[more], i + 1, runs[:, more].argmax(axis=0)
        runs, last = last, runs
    size = size.astype(np.int64)
    return alo + end_a - size, blo + end_b - size, size


def matched_short(a: list[str], b: list[str]) -> np.ndarray:
    """``matched_characters`` of texts of at most SHORT characters: in rounds, the longest match of every stretch that is left, as in difflib."""
    x, y = (np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), np.uint32) for side in (a, b))
    most = max(x.max(initial=0), y.max(initial=0))
    x, y = (c.astype(np.uint8 if most < 255 else np.uint16 if most < 65535 else np.uint32) for c in (x, y))
    bounds = [_bounds(list(map(len, side))) for side in (a, b)]
    total = np.zeros(len(a), np.int64)
    alo, ahi, blo, bhi, of = bounds[0][:-1], bounds[0][1:], bounds[1][:-1], bounds[1][1:], np.arange(len(a))
    while True:
        some = np.flatnonzero((ahi > alo) & (bhi > blo))
        some = some[np.argsort(alo[some] - ahi[some], kind="stable")]
        if not len(some):
            return total
        alo, ahi, blo, bhi, of = (v[some] for v in (alo, ahi, blo, bhi, of))
        step = max(1, CELLS // int((bhi - blo).max()))
        parts = [slice(lo, lo + step) for lo in range(0, len(of), step)]
        i, j, size = (np.concatenate(v) for v in zip(*(_longest(x, y, alo[p], blo[p], (ahi - alo)[p], (bhi - blo)[p]) for p in parts), strict=True))
        np.add.at(total, of, size)
        hit = np.flatnonzero(size)
        i, j, size, alo, ahi, blo, bhi, of = (v[hit] for v in (i, j, size, alo, ahi, blo, bhi, of))
        alo, ahi, blo, bhi, of = (np.concatenate(v) for v in ((alo, i + size), (i, ahi), (blo, j + size), (j, bhi), (of, of)))


def _shares(a: np.ndarray, a_sizes: list[int], b: np.ndarray, b_sizes: list[int], doublings: int) -> np.ndarray:
    n, m = np.array(a_sizes, np.int64), np.array(b_sizes, np.int64)
    matched = matched_sizes(a, _bounds(a_sizes), b, _bounds(b_sizes), doublings)
    return np.where(n > 0, np.maximum(0.0, 1.0 - matched / np.maximum(n, 1)), (m > 0).astype(float))
