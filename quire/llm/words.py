"""Words of Arrow text columns without an object per word, and a table of what is known about them.

A text column's bytes are cut at ASCII white space by array operations. A word's bytes, packed in
up to four numbers, are looked up in an open-addressing table, so a word met before costs a few
array reads; only new words become Python objects. Lookups are exact: the packed bytes themselves
are compared, and longer words are kept apart under their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a word that are packed; longer words are looked up one by one.
PACKED = 32
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Words:
    """The words of a text column: ``data[starts[i]:ends[i]]``; text t has those from ``bounds[t]`` to ``bounds[t + 1]``."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        n = len(column)
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if offsets is not None and offsets.size else np.zeros(n + 1, np.int64)
        base, size = int(at[0]), int(at[-1] - at[0])
        # whole numbers of 8 bytes, and room to read PACKED bytes from any start
        self._numbers = np.zeros(size // 8 + PACKED // 8 + 2, np.uint64)
        self.data = self._numbers.view(np.uint8)[:size]
        if size:
            self.data[:] = np.frombuffer(data, np.uint8, size, base)
        cuts = at - base
        inside = ~_SPACE[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        inner = cuts[(cuts > 0) & (cuts < size)]
        first[inner], last[inner - 1] = inside[inner], inside[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, cuts)

    def __len__(self) -> int:
        return len(self.starts)

    def packed(self) -> tuple[np.ndarray, np.ndarray]:
        """(length of each word, its first PACKED bytes as rows of numbers)."""
        length = self.ends - self.starts
        out = np.zeros((len(length), PACKED // 8), np.uint64)
        place, shift = self.starts >> 3, ((self.starts & 7) << 3).astype(np.uint64)
        some = np.arange(len(length))
        for k in range(PACKED // 8):
            p, s = place[some] + k, shift[some]
            low = self._numbers[p] >> s
            # a shift by 64 is undefined: shift twice
            high = (self._numbers[p + 1] << (np.uint64(63) - s)) << np.uint64(1)
            out[some, k] = (low | high) & _KEEP[np.minimum(length[some] - 8 * k, 8)]
            some = some[length[some] > 8 * (k + 1)]
            if not len(some):
                break
        return length, out

    def bytes_at(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def lines(self, which: np.ndarray) -> bytes:
        """Some of the words, a line each."""
        lengths = self.ends[which] - self.starts[which]
        out = np.full(int(lengths.sum()) + len(which), 10, np.uint8)
        to = np.cumsum(lengths + 1) - lengths - 1
        out[ragged(to, lengths)] = self.data[ragged(self.starts[which], lengths)]
        return out.tobytes()


class WordTable:
    """Numbers for distinct words, given in the order in which they are met."""

    def __init__(self, limit: int = 250_000):
        self.limit = limit
        self._bits = max(10, (3 * limit).bit_length())
        self.clear()

    def clear(self) -> None:
        self.size, room = 0, 4096
        self._slots = np.full(1 << self._bits, -1, np.int32)
        self._keys, self._lengths = np.zeros((room, PACKED // 8), np.uint64), np.zeros(room, np.int32)
        self._apart: dict[bytes, int] = {}

    def full(self) -> bool:
        """Whether it is time to clear it."""
        return self.size >= self.limit

    def _room(self, more: int) -> None:
        need = self.size + more
        if need > len(self._lengths):
            extra = max(need, 2 * len(self._lengths)) - len(self._lengths)
            self._keys = np.concatenate([self._keys, np.zeros((extra, PACKED // 8), np.uint64)])
            self._lengths = np.concatenate([self._lengths, np.zeros(extra, np.int32)])
        while 2 * need > len(self._slots):  # one batch may bring more than the limit
            self._bits += 1
            self._slots = np.full(1 << self._bits, -1, np.int32)
            held = np.flatnonzero((self._lengths[: self.size] > 0) & (self._lengths[: self.size] <= PACKED))
            self._place(self._hash(self._keys[held], self._lengths[held]), held)

    @staticmethod
    def _hash(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        h = keys[:, 0] * _ODD[0] + lengths.astype(np.uint64) * _ODD[4]
        long = np.flatnonzero(lengths > 8)
        for k in range(1, PACKED // 8):
            h[long] = (h[long] ^ (h[long] >> np.uint64(29))) * _ODD[k] + keys[long, k]
        h ^= h >> np.uint64(32)
        h *= _ODD[3]
        return h ^ (h >> np.uint64(29))

    def _place(self, h: np.ndarray, rows: np.ndarray) -> None:
        """Put rows, which the table doesn't hold, on free slots."""
        mask = len(self._slots) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        while len(rows):
            free = self._slots[slot] < 0
            self._slots[slot[free]] = rows[free]
            lost = self._slots[slot] != rows
            slot, rows = (slot[lost] + 1) & mask, rows[lost]

    def rows(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(the number of every word, where the words are that are new): these get the numbers from ``size``, as it was, on."""
        lengths, keys = words.packed()
        out = np.full(len(lengths), -1, np.int64)
        new: list[int] = []
        if not len(lengths):
            return out, np.zeros(0, np.int64)
        h = self._hash(keys, lengths)
        mask = np.int64(len(self._slots) - 1)
        ask = np.flatnonzero(lengths <= PACKED)
        slot = (h[ask] & np.uint64(mask)).astype(np.int64)
        missing = []
        while len(ask):
            row = self._slots[slot]
            same = self._keys[row, 0] == keys[ask, 0]
            same &= (row >= 0) & (self._lengths[row] == lengths[ask])
            long = np.flatnonzero(same & (lengths[ask] > 8))
            same[long] &= (self._keys[row[long], 1:] == keys[ask[long], 1:]).all(axis=1)
            out[ask[same]] = row[same]
            missing.append(ask[row < 0])
            on = ~same & (row >= 0)
            ask, slot = ask[on], (slot[on] + 1) & mask
        ask = np.concatenate([np.zeros(0, np.int64), *missing])
        if len(ask):
            # equal new words side by side, each run a row
            ask = ask[np.argsort(h[ask], kind="stable")]
            fresh = np.ones(len(ask), bool)
            fresh[1:] = (lengths[ask[1:]] != lengths[ask[:-1]]) | (keys[ask[1:]] != keys[ask[:-1]]).any(axis=1)
            # different words of one hash may alternate within a run of it: these go one by one
            clash = np.concatenate([[False], fresh[1:] & (h[ask[1:]] == h[ask[:-1]])])
            if clash.any():
                odd = np.isin(h[ask], h[ask[clash]])
                self._singly(words, ask[odd], out, new)
                ask, fresh = ask[~odd], fresh[~odd]
            self._room(int(fresh.sum()))
            first = ask[fresh]
            rows = self.size + np.arange(len(first))
            self._keys[rows], self._lengths[rows] = keys[first], lengths[first]
            self._place(h[first], rows.astype(np.int32))
            self.size += len(first)
            out[ask] = rows[np.cumsum(fresh) - 1]
            new += first.tolist()
        self._singly(words, np.flatnonzero(lengths > PACKED), out, new)
        return out, np.array(new, np.int64)

    def _singly(self, words: Words, which: np.ndarray, out: np.ndarray, new: list[int]) -> None:
        for i in which.tolist():
            w = words.bytes_at(i)
            row = self._apart.get(w)
            if row is None:
                self._room(1)
                row = self._apart[w] = self.size
                self._lengths[row] = 0  # never equal to a looked up length
                self.size += 1
                new.append(i)
            out[i] = row


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of pieces that begin at ``starts`` and have ``lengths``, piece by piece."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` between neighbouring ``bounds``, in whole numbers or doubles."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
