"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's likelihood
in a language is the sum over all its segmentations into pieces, by the forward algorithm; a text's
is the product over its words. The piece probabilities are fitted by expectation maximisation: the
expected piece counts of a word, over all segmentations, come from forwards and backwards sums.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh_name, release, slices, tidy, worker_state, written
from quire.llm.words import Words, WordTable, sums_between

#: Documents of a language that the fit uses, about (those with the smallest hashes of their ids).
TRAIN_DOCS = 3000
#: Rounds of expectation maximisation.
ROUNDS = 2
#: Pseudo-count of a piece; and the probability of a letter that no piece covers.
PSEUDO, UNKNOWN = 0.05, 1e-8
#: Words whose evidence counts in full; the evidence of longer texts is scaled to as many.
FULL_WORDS = 20
#: Symbols of words whose sums are taken together, about, and of a word whose sum can't underflow as a plain number.
TOGETHER, PLAIN = 1 << 15, 36
#: Log-likelihoods are added up as whole multiples of 1 / UNIT, so that their sums don't depend on the order.
UNIT = float(1 << 20)

UNDETERMINED = "und"
MARK = "▁"


def vocabulary_pieces(model: str) -> list[str]:
    """The lower-case pieces of a sentencepiece vocabulary that hold letters only (after a word mark)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return sorted({p for p in found if p == p.lower() and regex.fullmatch(r"▁?\p{L}+", p)})


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """(the lower-case letter of every code point, whether it is part of a word).

    Parts of words are letters and, so that scripts and accents that write them apart stay whole,
    the marks that follow letters.
    """
    low, part = np.arange(0x110000, dtype=np.int32), np.zeros(0x110000, bool)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if c.isalpha():
            part[ord(c)] = True
            low[ord(c)] = ord(c.lower()[0])
    marks = regex.compile(r"\p{M}")
    part[[ord(c) for c in map(chr, [*range(0x300, 0xD800), *range(0xE000, 0x20000), *range(0xE0100, 0xE0200)]) if marks.match(c)]] = True
    return low, part


class Runs:
    """Words of lines of text: symbols one word after the other, each led by the word mark."""

    def __init__(self, lines: bytes):
        low, part = _letters()
        code = np.frombuffer(lines.decode("utf-8", "replace").encode("utf-32-le"), np.int32)
        inside = part[code]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        # a run of marks without a letter is no word
        marks = np.concatenate([[0], np.cumsum(_is_mark()[code])])
        real = marks[ends] - marks[starts] < ends - starts
        starts, ends = starts[real], ends[real]
        self.lengths = ends - starts + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.symbols = np.full(int(self.lengths.sum()), ord(MARK), np.int32)
        inner = np.ones(len(self.symbols), bool)
        inner[self.starts] = False
        keep = np.zeros(len(code) + 1, np.int32)
        np.add.at(keep, starts, 1)
        np.add.at(keep, ends, -1)
        self.symbols[inner] = low[code[np.cumsum(keep[:-1]) > 0]]
        #: of each line, the words from ``bounds[i]`` to ``bounds[i + 1]``
        self.bounds = np.searchsorted(starts, np.concatenate([[0], np.flatnonzero(code == 10) + 1]))

    def words(self) -> list[str]:
        text = self.symbols.astype(np.uint32).tobytes().decode("utf-32-le")
        return [text[a : a + n] for a, n in zip(self.starts.tolist(), self.lengths.tolist(), strict=True)]


@cache
def _is_mark() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[c for c in np.flatnonzero(_letters()[1]).tolist() if not chr(c).isalpha()]] = True
    return out


def words_of(chunk: str) -> list[str]:
    """Words of a text: runs of letters, lower case, each after the word mark."""
    return Runs(chunk.encode("utf-8", "replace")).words()


class Pieces:
    """Piece probabilities of all languages: ``table[i]`` has an entry per language for ``pieces[i]``.

    Sums over segmentations run over many words at once. Walks through a trie of the pieces, from
    all places of all words in step, find all occurrences; each is an arc from its begin to its end.
    """

    def __init__(self, prob: dict[str, tuple[float, ...]], langs: list[str]):
        self.langs = langs
        self.pieces = sorted(prob)
        # the last row is for letters that no piece covers
        self.table = np.array([*(prob[p] for p in self.pieces), [UNKNOWN] * len(langs)], dtype=np.float64).reshape(len(prob) + 1, len(langs))
        self._trie = None

    def __getstate__(self):
        return self.__dict__ | {"_trie": None}

    def _built(self):
        """(symbol of a code point, hashed edges of the trie: keys and targets, piece that ends at a node or -1)."""
        if self._trie is None:
            letters = sorted(set("".join(self.pieces)))
            symbol = np.zeros(0x110000, np.int64)
            symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
            width = len(letters) + 1
            edges: dict[int, int] = {}
            ends = [-1]
            for i, p in enumerate(self.pieces):
                node = 0
                for c in symbol[[ord(c) for c in p]].tolist():
                    node = edges.setdefault(node * width + c, len(ends))
                    if node == len(ends):
                        ends.append(-1)
                ends[node] = i
            bits = max(4, (4 * len(edges)).bit_length())
            keys, to = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
            for k, v in edges.items():
                at = self._slot(np.array([k], np.int64), bits)[0]
                while keys[at] >= 0:
                    at = (at + 1) & (1 << bits) - 1
                keys[at], to[at] = k, v
            self._trie = symbol, width, bits, keys, to, np.array(ends, np.int64)
        return self._trie

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _arcs(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """(begin, end, piece, step) of all arcs by end, where a word has places from its start + its number on, one more than symbols.

        ``step`` is the end's place in its word. Symbols without a piece of their own get an arc alone.
        """
        symbol, width, bits, keys, to, ends = self._built()
        size, mask = len(symbols), (1 << bits) - 1
        word = np.repeat(np.arange(len(starts)), lengths)
        left = np.repeat(starts + lengths, lengths) - np.arange(size)  # symbols from here to the word's end
        code = symbol[symbols]
        at, node = np.flatnonzero(code > 0), None
        node = np.zeros(len(at), np.int64)
        begin, extent, piece = [], [], []
        depth = 0
        bare = np.ones(size, bool)
        while len(at):
            key = node * width + code[at + depth]
            slot = self._slot(key, bits)
            target = np.full(len(at), -1, np.int64)
            open_ = np.arange(len(at))
            while len(open_):
                there = keys[slot[open_]]
                hit = there == key[open_]
                target[open_[hit]] = to[slot[open_[hit]]]
                open_ = open_[~hit & (there >= 0)]
                slot[open_] = (slot[open_] + 1) & mask
            on = target >= 0
            at, node = at[on], target[on]
            depth += 1
            done = ends[node] >= 0
            begin.append(at[done])
            extent.append(np.full(int(done.sum()), depth))
            piece.append(ends[node[done]])
            if depth == 1:
                bare[at[done]] = False
            more = left[at] > depth
            more[more] = code[at[more] + depth] > 0
            at, node = at[more], node[more]
        lone = np.flatnonzero(bare)
        begin, extent = np.concatenate([*begin, lone]), np.concatenate([*extent, np.ones(len(lone), np.int64)])
        piece = np.concatenate([*piece, np.full(len(lone), len(self.pieces))])
        place = begin + word[begin]  # every word before this one has one place more than symbols
        # places in the order in which sums reach them; numbers below 2^16 are sorted in linear time
        number = np.arange(size + len(starts)) - np.repeat(starts + np.arange(len(starts)), lengths + 1)
        reach = np.argsort(_narrow(number), kind="stable")
        rank = np.empty(len(reach), np.int64)
        rank[reach] = np.arange(len(reach))
        order = np.argsort(_narrow(rank)[place + extent], kind="stable")
        place, extent, piece = place[order], extent[order], piece[order]
        return place, place + extent, piece, number[place + extent]

    def _sums(self, arcs: tuple[np.ndarray, ...], size: int, origins: np.ndarray, weights: np.ndarray, add: np.ufunc, over: np.ufunc, one: float, none: float) -> np.ndarray:
        """Sums over all ways from the origins to each place, step by step; plain numbers or logarithms."""
        begin, end, _, step = arcs
        f = np.full((size, weights.shape[1]), none)
        f[origins] = one
        cuts = np.searchsorted(step, np.arange(1, int(step[-1]) + 2))
        first = np.concatenate([[True], end[1:] != end[:-1]])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            heads = np.flatnonzero(first[lo:hi])
            f[end[lo:hi][heads]] = add.reduceat(over(f[begin[lo:hi]], weights[lo:hi]), heads, axis=0)
        return f

    def likelihoods(self, runs: Runs) -> np.ndarray:
        """log of the sum over segmentations, per word and language."""
        out = np.zeros((len(runs.lengths), len(self.langs)))
        if not len(out):
            return out
        order = np.argsort(runs.lengths, kind="stable")
        # words of like lengths together; those whose sums might underflow in logarithms
        total = np.cumsum(runs.lengths[order])
        short = int(np.searchsorted(runs.lengths[order], PLAIN, side="right"))
        lo = 0
        while lo < len(order):
            limit = short if lo < short else len(order)
            hi = min(limit, max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + TOGETHER, side="right"))))
            part = order[lo:hi]
            symbols, starts, lengths = _picked(runs, part)
            arcs = self._arcs(symbols, starts, lengths)
            origins = starts + np.arange(len(part))
            goal, weights = origins + lengths, self.table[arcs[2]]
            if lo < short:
                out[part] = np.log(self._sums(arcs, len(symbols) + len(part), origins, weights, np.add, np.multiply, 1.0, 0.0)[goal])
            else:
                out[part] = self._sums(arcs, len(symbols) + len(part), origins, np.log(weights), np.logaddexp, np.add, 0.0, -np.inf)[goal]
            lo = hi
        return out

    def expected(self, words: list[str], times: np.ndarray, lang: int) -> np.ndarray:
        """Expected counts of the pieces over all segmentations of ``words`` in one language."""
        lengths = np.array([len(w) for w in words])
        symbols = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
        starts = np.cumsum(lengths) - lengths
        arcs = begin, end, piece, step = self._arcs(symbols, starts, lengths)
        origins = starts + np.arange(len(words))
        goal, size, p = origins + lengths, len(symbols) + len(words), np.log(self.table[piece, lang])[:, None]
        f = self._sums(arcs, size, origins, p, np.logaddexp, np.add, 0.0, -np.inf)[:, 0]
        # the same from the ends backwards: begins and ends change places
        owner = np.searchsorted(origins, begin, side="right") - 1
        back = goal[owner] - begin
        order = np.lexsort((begin, back))
        b = self._sums((end[order], begin[order], piece[order], back[order]), size, goal, p[order], np.logaddexp, np.add, 0.0, -np.inf)[:, 0]
        share = np.exp(f[begin] + p[:, 0] + b[end] - f[goal][owner]) * times[owner]
        return np.bincount(piece, weights=share, minlength=len(self.pieces) + 1)[:-1]


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint16) if not len(x) or x.max() < 1 << 16 else x


def _picked(runs: Runs, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, lengths) of some of the words."""
    from quire.llm.words import ragged

    lengths = runs.lengths[which]
    return runs.symbols[ragged(runs.starts[which], lengths)], np.cumsum(lengths) - lengths, lengths


def _word_counts(train: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``n``, summed within tasks first."""

    def run(batches):
        counts: dict[tuple[str, str], int] = defaultdict(int)

        def out():
            b = pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in counts], pa.string()), "word": pa.array([k[1] for k in counts], pa.string()), "n": pa.array(counts.values(), pa.int64())})
            counts.clear()
            return b

        for batch in batches:
            for lo, rows in slices(batch.column(1), 256):
                for lang, text in zip(batch.column(0).slice(lo, rows).to_pylist(), batch.column(1).slice(lo, rows).to_pylist(), strict=True):
                    for w in words_of(text):
                        counts[lang, w] += 1
                if len(counts) > 300_000:
                    yield out()
        yield out()

    return train.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, model: str, *, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> Pieces:
    """Fit on rows of ``train`` (doc_id, lang, text) with a language.

    About ``train_docs`` documents of each language are used, chosen by hash of the id; all of them
    where there are fewer. What comes to the driver is one number per language and piece.
    """
    spark = train.sparkSession
    train = train.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    pieces = vocabulary_pieces(model)
    if not langs:
        return Pieces({}, [])
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.create_map(*(F.lit(v) for lang in langs for v in (lang, min(1_000_000, math.ceil(1e6 * train_docs / sizes[lang])))))
    words = written(_word_counts(train.filter(cell < share[F.col("lang")])), "words")
    prob = {p: tuple([1 / len(pieces)] * len(langs)) for p in pieces}
    for _ in range(rounds):
        known = spark.sparkContext.broadcast(Pieces(prob, langs))

        def run(batches, known=known):
            model, no = known.value, {lang: i for i, lang in enumerate(langs)}
            counts = np.zeros((len(langs), len(model.pieces)))
            for batch in batches:
                lang, word, times = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_numpy().astype(np.float64)
                for one in np.unique(lang):
                    at = np.flatnonzero(lang == one)
                    sizes = np.cumsum([len(word[i]) for i in at])
                    for part in np.split(at, np.flatnonzero(np.diff(sizes // TOGETHER)) + 1):
                        counts[no[str(one)]] += model.expected([word[i] for i in part], times[part], no[str(one)])
            for i, one in enumerate(langs):
                hit = np.flatnonzero(counts[i])
                if len(hit):
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([one] * len(hit), pa.string()), "piece": pa.array([model.pieces[j] for j in hit], pa.string()), "n": pa.array(counts[i][hit], pa.float64())})

        # rounding to whole millionths makes the sums, and so the model, the same in any order
        sums = words.mapInArrow(run, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.sum(F.round(F.col("n") * 1e6).cast("long")).alias("n"))
        counted: dict[str, dict[str, float]] = {lang: {} for lang in langs}
        for lang, piece, n in sums.collect():
            counted[lang][piece] = n / 1e6
        total = {lang: sum(sorted(counted[lang].values())) + PSEUDO * len(pieces) for lang in langs}
        prob = {p: tuple((counted[lang].get(p, 0.0) + PSEUDO) / total[lang] for lang in langs) for p in pieces}
        known.unpersist()
    release(spark)
    return Pieces(prob, langs)


class Scorer:
    """Scores texts; what a chunk between white spaces adds is kept for the next time it is met."""

    def __init__(self, model: Pieces, memo: int = 500_000):
        self.model, self._words = model, WordTable(memo)
        self._values = np.zeros((4096, len(model.langs) + 1), np.int64)

    def _learn(self, chunks: bytes, count: int) -> None:
        """Log-likelihoods and numbers of words of ``count`` new chunks, a line each."""
        size = self._words.size
        if size > len(self._values):
            more = max(size, 2 * len(self._values)) - len(self._values)
            self._values = np.concatenate([self._values, np.zeros((more, self._values.shape[1]), np.int64)])
        runs = Runs(chunks)
        found = np.rint(self.model.likelihoods(runs) * UNIT).astype(np.int64)
        counted = np.concatenate([found, np.ones((len(found), 1), np.int64)], axis=1)
        self._values[size - count : size] = sums_between(counted, runs.bounds)

    def scores(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(language, confidence) of each text; ties go to the smaller language name."""
        langs = np.array([*self.model.langs, UNDETERMINED], object)
        if not self.model.langs:
            return pa.array([UNDETERMINED] * len(texts), pa.string()), pa.array(np.zeros(len(texts)), pa.float64())
        if self._words.full():
            self._words.clear()
        words = Words(texts)
        rows, new = self._words.rows(words)
        if len(new):
            self._learn(words.lines(new), len(new))
        total = sums_between(self._values[rows], words.bounds)
        n = total[:, -1]
        z = total[:, :-1] / UNIT * np.minimum(1.0, FULL_WORDS / np.maximum(n, 1))[:, None]
        best = z.argmax(axis=1)
        score = 1 / np.exp(z - z[np.arange(len(z)), best][:, None]).sum(axis=1)
        best[n == 0], score[n == 0] = len(self.model.langs), 0.0
        return pa.array(langs[best].tolist(), pa.string()), pa.array(score, pa.float64())


def accepted(docs: DataFrame, train: DataFrame, model: str, **options) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose language is not ``und``."""
    names = fresh_name(docs, "lang"), fresh_name(docs, "score")
    found = identify(docs, train, model, keep=tuple(docs.columns), names=names, **options)
    return found.filter(F.col(names[0]) != UNDETERMINED).select(*(found[f"`{c}`"] for c in docs.columns))


def identify(docs: DataFrame, train: DataFrame, model: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score"), train_docs: int = TRAIN_DOCS) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` (or other ``names``) for every row of ``docs``.

    ``model`` is the path of a public sentencepiece vocabulary. Null text and text without a letter
    are ``und`` with score 0, as is everything when ``train`` has no labelled row. Texts are scored
    whole, words of any length included (no cut that a segmentation couldn't cross); marks that are
    written apart belong to the word they follow. Repeated rows get equal answers. Columns beyond
    ``keep`` and ``text`` are never read.
    """
    source = text if text in keep else fresh_name(docs, "text")
    shipped, tag, kept = docs.sparkSession.sparkContext.broadcast(fit(train, model, train_docs=train_docs)), uuid.uuid4().hex, list(keep)
    as_lang, as_score = names
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"{as_lang} string, {as_score} double"])

    def run(batches):
        scorer = worker_state(tag, lambda: Scorer(shipped.value))
        for batch in batches:
            for lo, rows in slices(batch.column(source), 1024):
                part = batch.slice(lo, rows)
                found = scorer.scores(part.column(source))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *found], [*kept, as_lang, as_score])
            tidy()

    extra = [] if text in keep else [F.col(text).alias(source)]
    return docs.select(*kept, *extra).mapInArrow(run, schema)
