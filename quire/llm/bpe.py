"""Byte-pair encoding and decoding through a memory-mapped minimal acyclic transducer.

1. Count the pieces that the vocabulary's own pre-tokenisation makes of all texts.
2. Encode the most frequent ones exactly (merges in rank order) and compile them, in byte order,
   into a minimal acyclic transducer: equal suffixes share states, ids sit on the arcs as early as
   they are certain. Its size is bounded by ``lexicon_size``.
3. Ship it to the executors as a file, once a machine, which their workers map into memory and
   walk; a piece that the automaton doesn't hold is merged exactly by the same rule.
4. Decode from the ids.

The encoder follows vocabularies of the kind "NFC, white space to one space, lower case; cut by
pattern; byte-level BPE with a suffix at word ends".
"""

from __future__ import annotations

import atexit
import gc
import heapq
import itertools
import json
import mmap
import os
import re
import shutil
import struct
import tempfile
import unicodedata
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import fresh_name, slices, tidy, worker_state, written
from quire.llm.words import Words, WordTable, ragged

#: Frequent pieces that the automaton holds at most.
LEXICON_SIZE = 1 << 17
#: Pieces longer than this many bytes are not put into the automaton.
LEXICON_BYTES = 64
#: Texts, and bytes of them, whose words are looked up at once.
SLICE, SLICE_BYTES = 4096, 1 << 20
#: Distinct chunks that a counting task holds before it passes its counts on, and that an encoder keeps.
FLUSH, MEMO = 300_000, 700_000
#: Symbols of a piece up to which pieces are merged many at once.
MANY = 64

def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = itertools.count(256)
    names = {b: chr(b) for b in plain}
    return [names[b] if b in names else chr(next(spare)) for b in range(256)]


class Merges:
    """The vocabulary file's exact rule for one piece, and its texts for ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        # a pair of ids as one number -> rank; rank -> the id that the pair becomes
        self.rank, self.becomes = {}, []
        for r, (a, b) in enumerate(pairs):
            self.rank[self.vocab[a] << 32 | self.vocab[b]] = r
            self.becomes.append(self.vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.texts = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        self.letters = byte_letters()
        self._tables = None
        cut = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(cut["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        self.lines = regex.compile(self.pieces.pattern + r"|\n")
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def segments(self, text: str) -> Iterator[tuple[bool, str]]:
        """(is an added token, text): added tokens are found in the raw text, before normalisation."""
        at = 0
        if self.specials is not None and "<|" in text:
            for m in self.specials.finditer(text):
                yield False, text[at : m.start()]
                yield True, m.group()
                at = m.end()
        yield False, text[at:]

    @staticmethod
    def normal(segment: str) -> str:
        """The segment in composed form and lower case, letter by letter (no rule for word ends)."""
        s = segment if segment.isascii() else unicodedata.normalize("NFC", segment).replace("Σ", "σ")
        return s.lower()

    def cut(self, lines: str) -> tuple[list[str | int], list[int]]:
        """(pieces of all lines, and the ids of added tokens; how many of each line), for lines without other ASCII white space.

        Composition, lower case and the pattern never look across ASCII white space, so a text's
        pieces are those of its chunks between it.
        """
        found: list[str | int] = self.lines.findall(self.normal(lines))
        ends = [i for i, p in enumerate(found) if p == "\n"]
        counts = [b - a - 1 for a, b in zip([-1, *ends], ends, strict=False)]
        found = [p for p in found if p != "\n"]
        if "<|" in lines and self.specials is not None:
            at, out = 0, []
            for i, (line, n) in enumerate(zip(lines.split("\n"), counts, strict=False)):
                part, at = found[at : at + n], at + n
                if "<|" in line:
                    part = []
                    for special, s in self.segments(line):
                        part += [self.added[s]] if special else self.pieces.findall(self.normal(s))
                    counts[i] = len(part)
                out += part
            found = out
        return found, counts

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: letters joined pair by pair, lowest rank first, leftmost first."""
        symbols = [self.letters[b] for b in piece.encode("utf-8")]
        if not symbols:
            return []
        symbols[-1] += self.suffix
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        return self._merge_short(ids) if len(ids) <= 64 else self._merge_long(ids)

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, one piece after the other; how many each has): ``merge`` for many at once.

        In each round every piece that has a pair of known rank joins its pair of lowest rank, the
        leftmost of equal ones.
        """
        if self._tables is None:
            self._tables = self._pair_tables()
        inner, last, keys, ranks, becomes = self._tables
        counts = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(counts)
        ids = inner[data]
        ids[ends[counts > 0] - 1] = last[data[ends[counts > 0] - 1]]
        slow = [i for i, p in enumerate(pieces) if len(p) > MANY]
        if (ids < 0).any():  # a vocabulary that doesn't hold every byte
            slow = range(len(pieces))
        out: list[np.ndarray | None] = [None] * len(pieces)
        for i in slow:
            out[i] = np.array(self.merge(pieces[i].decode("utf-8")), np.int64)
        own = np.repeat(np.arange(len(pieces)), counts)
        if slow:
            live = np.ones(len(pieces), bool)
            live[slow] = False
            ids, own = ids[live[own]], own[live[own]]
        none = len(self.becomes)

        def rank(a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
            key = a << 32 | b
            at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - len(keys).bit_length() + 1)).astype(np.int64)
            found = np.full(len(key), none)
            ask = np.flatnonzero(same)
            at = at[ask]
            while len(ask):
                there = keys[at]
                hit = there == key[ask]
                found[ask[hit]] = ranks[at[hit]]
                on = ~hit & (there >= 0)
                ask, at = ask[on], (at[on] + 1) & (len(keys) - 1)
            return found

        done_ids, done_own = [], []
        pair = rank(ids, np.append(ids[1:], 0), np.append(own[1:] == own[:-1], False)) if len(ids) else ids
        while len(ids):
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            least = np.minimum.reduceat(pair, heads)
            sizes = np.diff(np.append(heads, len(ids)))
            each = np.repeat(least, sizes)
            ready = each == none
            if ready.any():  # pieces without a known pair are done
                done_ids.append(ids[ready])
                done_own.append(own[ready])
                keep = ~ready
                ids, own, pair, each = ids[keep], own[keep], pair[keep], each[keep]
                if not len(ids):
                    break
            at = np.flatnonzero(pair == each)
            at = at[np.concatenate([[True], own[at[1:]] != own[at[:-1]]])]
            ids[at] = becomes[pair[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one id to the left of each is gone
            ids, own, pair = ids[keep], own[keep], pair[keep]
            for x in (at, at[at > 0] - 1):
                right = np.minimum(x + 1, len(ids) - 1)
                pair[x] = rank(ids[x], ids[right], (own[x] == own[right]) & (right > x))
        for i in slow:
            done_ids.append(out[i])
            done_own.append(np.full(len(out[i]), i))
        if not done_ids:
            return np.zeros(0, np.int64), counts
        ids, own = np.concatenate(done_ids), np.concatenate(done_own)
        order = np.argsort(own, kind="stable")
        return ids[order], np.bincount(own, minlength=len(pieces))

    def _pair_tables(self) -> tuple[np.ndarray, ...]:
        """(id of each byte inside a piece, and at its end; hashed pairs and their ranks; what a rank's pair becomes)."""
        inner = np.array([self.vocab.get(c, -1) for c in self.letters], np.int64)
        last = np.array([self.vocab.get(c + self.suffix, -1) for c in self.letters], np.int64)
        bits = max(4, (4 * len(self.rank)).bit_length())
        keys, ranks = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        pairs = np.array(list(self.rank), np.int64)
        slots = ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        for k, at, r in zip(pairs.tolist(), slots.tolist(), self.rank.values(), strict=True):
            while keys[at] >= 0:
                at = (at + 1) & (1 << bits) - 1
            keys[at], ranks[at] = k, r
        return inner, last, keys, ranks, np.array(self.becomes, np.int64)

    def _merge_short(self, ids: list[int]) -> list[int]:
        """Merge in place: the smallest of all pair ranks, found anew after each merge."""
        get, none = self.rank.get, len(self.becomes)
        ranks = [get(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            ids[i] = self.becomes[r]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs and linked places: n log n for pieces of any length."""
        n, gone = len(ids), -1
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def push(i: int, j: int) -> None:
            r = self.rank.get(ids[i] << 32 | ids[j])
            if r is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            push(i, i + 1)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = self.becomes[r], gone, right[j]
            if right[i] < n:
                left[right[i]] = i
                push(i, right[i])
            if left[i] >= 0:
                push(left[i], i)
        return [x for x in ids if x != gone]


# --- the automaton ------------------------------------------------------------------------------


class _State:
    """A state that later keys may still change: byte -> [target's number once it is frozen, ids]."""

    __slots__ = ("arcs", "final", "out")

    def __init__(self):
        self.arcs: dict[int, list] = {}
        self.final = False
        self.out: tuple[int, ...] = ()


def _shared(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def compile_lexicon(entries: Iterable[tuple[bytes, list[int] | tuple[int, ...]]]) -> bytes:
    """The minimal acyclic transducer of ``entries`` (distinct keys, any order), serialised.

    Built key by key in byte order: the states that the next key can no longer change are frozen
    and looked up among those already frozen, so equal right-hand parts exist once. A frozen state
    is a few bytes in the table and a few as its key.
    """
    frozen: dict[bytes, int] = {}
    ends, keys, targets, outs, pool = (array("I") for _ in range(5))
    pool.append(0)
    where: dict[tuple, int] = {(): 0}

    def put(ids: tuple) -> int:
        if ids not in where:
            where[ids] = len(pool)
            pool.append(len(ids))
            pool.extend(ids)
        return where[ids]

    def freeze(state: _State) -> int:
        end = put(state.out) if state.final else NO_END
        arcs = [x for b, (t, o) in sorted(state.arcs.items()) for x in (b, t, put(o))]
        key = array("I", [end, *arcs]).tobytes()
        number = frozen.get(key)
        if number is None:
            number = frozen[key] = len(ends)
            ends.append(end)
            # states and labels ascend, so the keys do
            keys.extend(number << 8 | b for b in arcs[::3])
            targets.extend(arcs[1::3])
            outs.extend(arcs[2::3])
        return number

    path, last = [_State()], b""
    for word, ids in sorted(entries):
        out = tuple(ids)
        common = _shared(tuple(last), tuple(word))
        for depth in range(len(last), common, -1):
            path[depth - 1].arcs[last[depth - 1]][0] = freeze(path[depth])
        del path[common + 1 :]
        for depth in range(common, len(word)):
            path.append(_State())
            path[depth].arcs[word[depth]] = [None, ()]
        path[-1].final = True
        for depth in range(common):  # what the older keys put here and this one doesn't share moves on
            arc, below = path[depth].arcs[word[depth]], path[depth + 1]
            k = _shared(arc[1], out)
            moved = arc[1][k:]
            arc[1] = arc[1][:k]
            if moved:
                for other in below.arcs.values():
                    other[1] = moved + other[1]
                if below.final and depth + 1 != len(word):
                    below.out = moved + below.out
            out = out[k:]
        if common < len(word):
            path[common].arcs[word[common]][1] = out
        else:
            path[common].out = out
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1].arcs[last[depth - 1]][0] = freeze(path[depth])
    root = freeze(path[0])
    parts = (ends, keys, targets, outs, pool)
    return b"".join([struct.pack("<6I", root, *map(len, parts)), *(np.array(x, np.uint32).tobytes() for x in parts)])


#: In the table of final outputs: this state ends no key.
NO_END = 0xFFFFFFFF


class Lexicon:
    """A serialised automaton in a file, mapped into memory: all workers of a machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self._root, *sizes = struct.unpack_from("<6I", self._map)
        at, parts = 24, []
        for n in sizes:
            parts.append(np.frombuffer(self._map, np.uint32, n, at))
            at += 4 * n
        self._ends, self._keys, self._targets, self._outs, self._pool = parts

    def walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether each word is held, ids of those that are, one word after the other, how many each word has).

        All words take a step at a time, so a step is a few array operations for all of them.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        starts, data = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(words), np.uint8)
        state, places = np.full(len(words), self._root, np.int64), np.zeros((len(words), int(lengths.max(initial=0)) + 1), np.int64)
        held, live = np.zeros(len(words), bool), np.arange(len(words))
        for i in range(places.shape[1]):
            ended = live[lengths[live] == i]
            last = self._ends[state[ended]]
            held[ended] = last != NO_END
            places[ended[last != NO_END], i] = last[last != NO_END]
            live = live[lengths[live] > i]
            if not len(live) or not len(self._keys):
                break
            key = state[live] << 8 | data[starts[live] + i]
            arc = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            there = self._keys[arc] == key
            live, arc = live[there], arc[there]
            state[live], places[live, i] = self._targets[arc], self._outs[arc]
        places[~held] = 0
        sizes = self._pool[places].astype(np.int64)  # place 0 holds no ids
        ids = self._pool[ragged((places + 1).ravel(), sizes.ravel())].astype(np.int64)
        return held, ids, sizes.sum(axis=1)

    def get(self, word: bytes) -> list[int] | None:
        """The ids of ``word``, or None if the automaton doesn't hold it."""
        held, ids, _ = self.walk([word])
        return ids.tolist() if held[0] else None


def ship_lexicon(spark: SparkSession, data: bytes) -> str:
    """Send a serialised automaton to every machine of the session; the name under which ``SparkFiles`` finds it."""
    name = f"quire-lexicon-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(path)  # the driver serves it to executors that start later, too
    return name


# --- over tables --------------------------------------------------------------------------------


def piece_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``piece``, ``n``: how often each piece occurs in all texts (summed in tasks first)."""

    def run(batches):
        rule, chunks = Merges(tokenizer), WordTable(FLUSH)
        counts, lines = np.zeros(0, np.int64), []

        def out():
            pieces = Counter()
            found, sizes = rule.cut(b"".join(lines).decode("utf-8"))
            for p, n in zip(found, np.repeat(counts, sizes).tolist(), strict=True):
                pieces[p] += n
            for p in [p for p in pieces if isinstance(p, int) or len(p) > LEXICON_BYTES // 4 and len(p.encode()) > LEXICON_BYTES]:
                del pieces[p]
            return pa.RecordBatch.from_pydict({"piece": pa.array(pieces.keys(), pa.string()), "n": pa.array(pieces.values(), pa.int64())})

        for batch in batches:
            for lo, rows in slices(batch.column(0), SLICE, SLICE_BYTES):
                words = Words(batch.column(0).slice(lo, rows))
                at, new = chunks.rows(words)
                lines.append(words.lines(new))
                seen = np.bincount(at, minlength=chunks.size)
                seen[: len(counts)] += counts
                counts = seen
                if chunks.full():
                    yield out()
                    chunks.clear()
                    counts, lines = np.zeros(0, np.int64), []
            tidy()
        yield out()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, tokenizer: str, text: str = "text", size: int = LEXICON_SIZE) -> bytes:
    """The automaton of the most frequent pieces of all texts: as many whole classes of equal counts as ``size`` holds.

    Which counts are high enough is found from the number of pieces per count, so that no task and
    no sort returns more than the ``size`` pieces that are compiled.
    """
    counted = written(piece_counts(docs, tokenizer, text), "pieces")
    # counts above ``size`` each hold few pieces; they need no class of their own
    classes = counted.groupBy(F.least("n", F.lit(size)).alias("n")).agg(F.count("*").alias("pieces")).orderBy(F.col("n").desc()).collect()
    held, least = 0, None
    for n, pieces in classes:
        held += pieces
        if held > size:
            break
        least = n
    top = [] if least is None else counted.filter(F.col("n") >= least).select("piece").toArrow().column(0).cast(pa.binary()).to_pylist()
    data = compile_lexicon(_with_ids(top, tokenizer))
    del top
    gc.collect()
    tidy()
    return data


def _with_ids(pieces: list[bytes], tokenizer: str) -> Iterator[tuple[bytes, tuple[int, ...]]]:
    """Each piece and its ids, merged some thousands at once."""
    rule = Merges(tokenizer)
    for lo in range(0, len(pieces), SLICE):
        part = pieces[lo : lo + SLICE]
        ids, sizes = rule.merge_many(part)
        for p, x in zip(part, np.split(ids.astype(np.int32), np.cumsum(sizes)[:-1]), strict=True):
            yield p, tuple(x.tolist())


class Decoder:
    """Texts of ids, as a vocabulary without a decoder gives them: joined by single spaces; ids without a text give nothing."""

    def __init__(self, rule: Merges):
        top = max(rule.texts, default=-1) + 1
        self._texts = pa.array([rule.texts.get(i) for i in range(top)], pa.string())
        self._known = np.array([i in rule.texts for i in range(top)], bool)

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The text of ``ids[bounds[i]:bounds[i + 1]]`` for every i."""
        ok = (ids >= 0) & (ids < len(self._known))
        ok[ok] = self._known[ids[ok]]
        if not ok.all():
            bounds = np.concatenate([[0], np.cumsum(ok)])[bounds]
            ids = ids[ok]
        return _joined(self._texts.take(pa.array(ids)), bounds)


def _joined(parts: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), parts), " ")


class Encoder:
    """Encodes texts with the automaton first and exact merges for the rest; what a chunk gave is kept."""

    def __init__(self, tokenizer: str, lexicon: str, memo: int = MEMO):
        self.rule, self.lexicon = Merges(tokenizer), Lexicon(lexicon)
        self.decoder = Decoder(self.rule)
        self._numbers = pa.array([str(i) for i in range(max(self.rule.texts, default=-1) + 1)], pa.string())
        self._words = WordTable(memo)
        self._clear()

    def _clear(self) -> None:
        self._words.clear()
        self._pool, self._used = np.zeros(1 << 16, np.int32), 0
        self._starts = np.zeros(0, np.int64)
        self._sizes = np.zeros(0, np.int64)

    def _learn(self, lines: bytes) -> None:
        """The ids of new chunks, a line each."""
        cut, per_chunk = self.rule.cut(lines.decode("utf-8"))
        number = {p: i for i, p in enumerate(dict.fromkeys(cut))}
        order = np.array([number[p] for p in cut], np.int64)
        ids, sizes = self._ids(list(number))
        starts = np.cumsum(sizes) - sizes
        found = ids[ragged(starts[order], sizes[order])]
        # ids of each chunk: those of its pieces
        ends = np.concatenate([[0], np.cumsum(sizes[order])])
        cuts = ends[np.concatenate([[0], np.cumsum(per_chunk)])]
        while self._used + len(found) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._pool[self._used : self._used + len(found)] = found
        self._starts = np.concatenate([self._starts, self._used + cuts[:-1]])
        self._sizes = np.concatenate([self._sizes, np.diff(cuts)])
        self._used += len(found)

    def _ids(self, pieces: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after the other, how many each has): from the automaton, or merged."""
        coded = [p.encode("utf-8") if isinstance(p, str) else b"" for p in pieces]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        plain = lengths > 0
        held, ids, sizes = self.lexicon.walk([c if len(c) <= LEXICON_BYTES else b"" for c in coded])
        held &= plain & (lengths <= LEXICON_BYTES)
        kept = np.repeat(held, sizes)
        rest = np.flatnonzero(plain & ~held)
        more, more_sizes = self.rule.merge_many([coded[i] for i in rest.tolist()])
        added = np.flatnonzero(~plain)
        owner = np.concatenate([np.repeat(np.arange(len(pieces)), sizes)[kept], np.repeat(rest, more_sizes), added])
        every = np.concatenate([ids[kept], more, np.array([pieces[i] for i in added.tolist()], np.int64)])
        return every[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pieces))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin and end)."""
        if self._words.full():
            self._clear()
        words = Words(texts)
        rows, new = self._words.rows(words)
        if len(new):
            self._learn(words.lines(new))
        sizes = self._sizes[rows]
        found = self._pool[ragged(self._starts[rows], sizes)]
        return found, np.concatenate([[0], np.cumsum(sizes)])[words.bounds]

    def encode_many(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Arrays of decimal ids joined by one space, of the texts decoded from the ids, and of numbers of ids."""
        ids, bounds = self.ids(texts)
        return _joined(self._numbers.take(pa.array(ids)), bounds), self.decoder.texts(ids, bounds), pa.array(np.diff(bounds), pa.int64())

    def encode(self, text: str) -> tuple[str, str, int]:
        """``encode_many`` of one text."""
        return tuple(x[0].as_py() for x in self.encode_many(pa.array([text], pa.string())))


def decode(ids: Iterable[int], rule: Merges) -> str:
    """The text of ids."""
    ids = np.array(list(ids), np.int64)
    return Decoder(rule).texts(ids, np.array([0, len(ids)]))[0].as_py()


def encode_documents(docs: DataFrame, tokenizer: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), lexicon_size: int = LEXICON_SIZE) -> DataFrame:
    """``keep`` columns, ``ids`` (decimal, joined by one space), ``n_tokens``, ``decoded`` (from the ids).

    Null text counts as empty: no ids, empty decoding. Texts of any length are encoded whole, piece
    by piece; rows with equal text are each encoded; an empty table gives an empty result (the
    automaton is then empty). Columns beyond ``keep`` and ``text`` are ignored.
    """
    lexicon = ship_lexicon(docs.sparkSession, build_lexicon(docs, tokenizer, text, lexicon_size))
    names, source = list(keep), fresh_name(docs, "text")
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "ids string, n_tokens long, decoded string"])

    def run(batches):
        encoder = worker_state(lexicon, lambda: Encoder(tokenizer, SparkFiles.get(lexicon)))
        for batch in batches:
            for lo, rows in slices(batch.column(source), SLICE, SLICE_BYTES):
                part = batch.slice(lo, rows)
                ids, decoded, n = encoder.encode_many(part.column(source))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), ids, n, decoded], [*names, "ids", "n_tokens", "decoded"])
            tidy()

    return docs.select(*names, F.col(text).alias(source)).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, tokenizer: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` computed from its ids column (null ids: null)."""
    schema = encoded.drop("decoded").schema.simpleString()[len("struct<") : -1]
    frame = encoded.drop("decoded")

    def run(batches):
        decoder = Decoder(Merges(tokenizer))
        for batch in batches:
            words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(batch.column(ids), "")))
            flat = words.flatten()
            some = pc.not_equal(flat, "")  # an empty text splits into one empty word
            bounds = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[words.offsets.to_numpy() - words.offsets[0].as_py()]
            texts = decoder.texts(flat.filter(some).cast(pa.int64()).to_numpy(), bounds)
            texts = pc.if_else(batch.column(ids).is_null(), pa.scalar(None, pa.string()), texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return frame.mapInArrow(run, f"{schema},decoded:string")
