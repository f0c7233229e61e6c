"""Licence texts inside documents, by a generalised suffix automaton of the words of templates.

1. Automaton: the words of all templates (base phrases are templates too) in one suffix automaton;
   each state knows where in the templates its strings end.
2. Matching statistics: texts are streamed word by word; at each word the state and length of the
   longest string of templates that ends there. Stretches without two neighbouring words that
   neighbour in a template can hold no match of two words, and array operations skip them.
3. Phrases: a base phrase stands where its state is on the suffix path of the state reached.
4. Chains: maximal matches of some words are chained along a template, in both orders, over small
   gaps; a chain that covers enough of the template is a span of its licence.

The automaton's size is bounded by the templates, a constant, so it is sent to every task.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices, tidy
from quire.llm.grams import Cuts
from quire.session import ship

#: Words of ASCII letters and digits and whatever isn't ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_INSIDE = np.ones(256, bool)
_INSIDE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# What public licences ask to be put at the head of files, or their central paragraph.
TEMPLATES: list[tuple[str, str]] = [
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3
        of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either
        version 2.1 of the License, or (at your option) any later version."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must
        retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        https://mozilla.org/MPL/2.0/."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]

#: Words of a match that takes part in a chain, words that a chain may skip on either side, and the share of a template that makes a span.
LEAST, GAP, COVER = 4, 24, 0.6
#: Bytes of text that are cut at once.
SLICE = 4 << 20


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Automaton:
    """The suffix automaton of several word sequences: states by number, 0 for the empty string."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        self._ends = ends
        for t, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extended(last, word)
                ends[last].append((t, i))
        # a state's strings also end where those of the states below it end
        self.ends = [list(e) for e in ends]
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[s]] += self.ends[s]
        self.ends[0] = []
        del self._ends

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self._ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state of p's longest string and ``word``, taken out of q, which has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = part
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = part
            p = self.link[p]
        return part

    def _extended(self, last: int, word: int) -> int:
        if word in self.next[last]:  # an earlier template has this string
            return self._split(last, self.next[last][word], word)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][word], word)
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The state and length of the longest known string that ends with ``word``."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        follow = self.next[state].get(word)
        return (0, 0) if follow is None else (follow, length + 1)

    def state_of(self, sequence: Sequence[int]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state


class Scanner:
    """Templates ready to be looked for."""

    def __init__(self, phrases: dict[str, str] | None = None, templates: Sequence[tuple[str, str]] | None = None, least: int = LEAST, gap: int = GAP, cover: float = COVER):
        phrases = PHRASES if phrases is None else phrases
        templates = TEMPLATES if templates is None else templates
        texts = [words_of(p) for p in phrases] + [words_of(t) for _, t in templates]
        self.labels = [*phrases.values(), *(x for x, _ in templates)]
        self.sizes, self.n_phrases = [len(t) for t in texts], len(phrases)
        self.least, self.gap, self.cover = least, gap, cover
        number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        coded = [[number[w] for w in t] for t in texts]
        self.automaton = Automaton(coded)
        vocabulary = Cuts(pa.array(number), _INSIDE)
        first, second = vocabulary.hashes(11), vocabulary.hashes(13)
        self._order = np.argsort(first)
        self._first, self._second = first[self._order], second[self._order]
        self._pairs = np.zeros((len(number), len(number)), bool)
        for t in coded:
            self._pairs[t[:-1], t[1:]] = True
        # by state: phrases that end with it, with the length that a match there must have
        of_state: dict[int, list[tuple[int, int]]] = {}
        for p, t in enumerate(coded[: self.n_phrases]):
            of_state.setdefault(self.automaton.state_of(t), []).append((p, len(t)))
        self._ending: list[list[tuple[int, int]]] = [[] for _ in self.automaton.length]
        for s in range(len(self.automaton.length)):
            at = s
            while at > 0:
                self._ending[s] += [(p, n if at == s else 0) for p, n in of_state.get(at, ())]
                at = self.automaton.link[at]

    def known(self, cuts: Cuts) -> np.ndarray:
        """Each word's number among the templates' words, or -1."""
        if not len(cuts) or not len(self._first):
            return np.full(len(cuts), -1)
        first = cuts.hashes(11)
        at = np.minimum(np.searchsorted(self._first, first), len(self._first) - 1)
        out = np.where(self._first[at] == first, self._order[at], -1)
        some = np.flatnonzero(out >= 0)
        if len(some):
            out[some[self._second[at[some]] != cuts.hashes(13)[some]]] = -1
        return out

    def stretches(self, ids: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
        """Maximal runs, as (begin, end), of two and more words of one text in which all neighbours neighbour in a template."""
        if len(ids) < 2:
            return []
        near = (ids[1:] >= 0) & (ids[:-1] >= 0) & (text[1:] == text[:-1])
        some = np.flatnonzero(near)
        near[some] = self._pairs[ids[some], ids[some + 1]]
        edge = np.diff(np.r_[False, near, False].astype(np.int8))
        return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + 1).tolist(), strict=True))

    def matches(self, ids: Sequence[int], at: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Of a stretch that begins at word ``at``: (phrase, first word) places, and maximal matches of ``least`` words as (first word, length, state)."""
        places, long = [], []
        state = length = 0
        step, least = self.automaton.step, self.least
        for i, word in enumerate(ids):
            before, had = state, length
            state, length = step(state, length, word)
            if had >= least and length != had + 1:
                long.append((at + i - had, had, before))
            places += [(p, at + i - self.sizes[p] + 1) for p, n in self._ending[state] if length >= n]
        if length >= least:
            long.append((at + len(ids) - length, length, state))
        return places, long

    def chains(self, long: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word, covered share) of each template's best chains, none overlapping another of it.

        A match is put after the chain before it that covers most words and ends at most ``gap`` words
        before it on both sides; where two overlap, the later one counts without what they share.
        """
        by: dict[int, list[tuple[int, int, int]]] = {}
        for first, length, state in long:
            for t, end in self.automaton.ends[state]:
                if t >= self.n_phrases:
                    by.setdefault(t, []).append((first, end - length + 1, length))
        out = []
        for t, found in sorted(by.items()):
            found.sort()
            best: list[tuple[int, int]] = []  # (words covered, first word of the chain)
            low = 0
            for k, (x, y, n) in enumerate(found):
                score, begin = n, x
                while found[low][0] + self.sizes[t] + self.gap < x:
                    low += 1
                for j in range(low, k):
                    u, v, m = found[j]
                    shared = max(0, u + m - x, v + m - y)
                    if u < x and v < y and shared < n and x - u - m <= self.gap and y - v - m <= self.gap and best[j][0] + n - shared > score:
                        score, begin = best[j][0] + n - shared, best[j][1]
                best.append((score, begin))
            taken: list[tuple[int, int]] = []  # by place; none overlaps another
            for score, begin, k in sorted(((s, b, k) for k, (s, b) in enumerate(best)), key=lambda c: (-c[0], c[1], c[2])):
                end = found[k][0] + found[k][2] - 1
                at = bisect(taken, (begin, end))
                if (at == 0 or taken[at - 1][1] < begin) and (at == len(taken) or taken[at][0] > end):
                    taken.insert(at, (begin, end))
                    out.append((t, begin, end, score / self.sizes[t]))
        return out


SPANS = "array<struct<label:string,first_word:long,last_word:long,covered:double>>"
SCANNED = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def _rows(scanner: Scanner, texts: pa.Array) -> list[dict]:
    """SCANNED of a slice of texts."""
    cuts = Cuts(texts, _INSIDE)
    ids = scanner.known(cuts)
    places: dict[int, list[tuple[int, int]]] = {}
    long: dict[int, list[tuple[int, int, int]]] = {}
    for begin, end in scanner.stretches(ids, cuts.text):
        t = int(cuts.text[begin])
        p, m = scanner.matches(ids[begin:end].tolist(), begin - int(cuts.bounds[t]))
        if p:
            places.setdefault(t, []).extend(p)
        if m:
            long.setdefault(t, []).extend(m)
    out = []
    for t, n in enumerate(np.diff(cuts.bounds).tolist()):
        base = places.get(t, [])
        chains = scanner.chains(long[t]) if t in long else []
        spans = [(scanner.labels[c], a, b, share) for c, a, b, share in chains if share >= scanner.cover]
        named = sorted({scanner.labels[p] for p, _ in base})
        first, last = (min(a for _, a in base), max(a for _, a in base)) if base else (None, None)
        score = 1.0 if base else min(1.0, max((c[3] for c in chains), default=0.0))
        labels = sorted({*named, *(s[0] for s in spans)})
        out.append({"n_words": n, "n_base": len(base), "first_word": first, "last_word": last, "base_labels": ",".join(named), "labels": ",".join(labels), "score": score, "spans": [dict(zip(("label", "first_word", "last_word", "covered"), s, strict=True)) for s in sorted(spans, key=lambda s: s[1:3])]})
    return out


def scan(docs: DataFrame, scanner: Scanner | None = None, text: str = "text") -> DataFrame:
    """``doc_id`` and SCANNED of every row: words, places of base phrases, their labels, all labels, the score and the spans.

    A span is where a chain covers ``cover`` of a template; the score is the greatest share of a
    template that the text covers, 1 where a phrase stands. Null and empty texts have no words, no
    label and score 0; rows that repeat are scanned each, long texts whole; other columns are
    ignored; an empty table stays empty.
    """
    ship(docs.sparkSession)
    found = scanner or Scanner()
    schema = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n in slices(batch.column(1), 1 << 14, SLICE):
                rows = pa.Table.from_pylist(_rows(found, batch.column(1).slice(lo, n)), schema)
                yield from rows.add_column(0, "doc_id", batch.column(0).slice(lo, n)).combine_chunks().to_batches()
        tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, {SCANNED}")
