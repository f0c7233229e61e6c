"""Words of Arrow text columns under any ASCII word rule, as numbers: hashes of words and of their n-grams.

A column's bytes are lower-cased (A-Z) and cut by array operations; no word becomes a Python object.
Hashes are sums of a random number per byte value times one per place, modulo 2^64, mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quire.llm.words import ragged

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that are hashed at once.
BLOCK = 1 << 17
_MIX = np.uint64(0xD6E8FEB86659FD93)


def scattered(n: int, seed: int) -> np.ndarray:
    """The first ``n`` of a fixed sequence of 64-bit numbers without pattern, all odd."""
    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 40)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


class Cuts:
    """The words of a text column: ``data[starts[i]:ends[i]]``, in text ``text[i]``; null texts have none.

    ``inside`` tells for each byte value whether it belongs to a word; ``breaks``, if given, which
    others end a piece: words of one piece have equal ``piece``, which never goes down.
    """

    def __init__(self, column: pa.Array, inside: np.ndarray, breaks: np.ndarray | None = None):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if offsets is not None and offsets.size else np.zeros(n + 1, np.int64)
        base, size = int(at[0]), int(at[-1] - at[0])
        self.data = LOWER[np.frombuffer(data, np.uint8, size, base)] if size else np.zeros(0, np.uint8)
        bounds = at - base
        word = inside[self.data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = bounds[(bounds > 0) & (bounds < size)]
        first[inner], last[inner - 1] = word[inner], word[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, bounds)
        self.text = np.repeat(np.arange(n), np.diff(self.bounds))
        if breaks is not None:
            self.piece = self.text + np.cumsum(breaks[self.data])[self.starts] if size else self.text

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        size = self.ends - self.starts
        value, place = scattered(256, seed), scattered(int(size.max()), seed + 1)
        out, before = np.empty(len(size), np.uint64), np.concatenate([[0], np.cumsum(size)])
        lo = 0
        while lo < len(size):  # some words at once: what is needed beside them stays small
            hi = max(lo + 1, int(np.searchsorted(before, before[lo] + BLOCK, side="right")) - 1)
            some = size[lo:hi]
            terms = value[self.data[ragged(self.starts[lo:hi], some)]]
            terms *= place[ragged(np.zeros(hi - lo, np.int64), some)]
            out[lo:hi] = np.add.reduceat(terms, before[lo:hi] - before[lo])
            lo = hi
        return mixed(out + size.astype(np.uint64))

    def strings(self, which: np.ndarray) -> pa.Array:
        """Some of the words, as text."""
        size = self.ends[which] - self.starts[which]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        data = self.data[ragged(self.starts[which], size)]
        return pa.LargeStringArray.from_buffers(len(which), pa.py_buffer(offsets), pa.py_buffer(data))
