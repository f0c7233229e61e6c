"""Token counts by overlap resynchronisation.

A text longer than ``chunk_chars`` is encoded in overlapping chunks with offsets, so that memory
stays bounded by the chunk and not by the document. Two neighbouring chunks are spliced at a
boundary inside their overlap that is

* proven stable: the vocabulary cuts pieces there before it merges, whatever is on either side
  (``json_boundaries`` and ``model_boundaries`` say which places these are and why), so what is on
  one side can't change the pieces on the other;
* common: both encodings start a token there, and from there to the last stable boundary of the
  overlap they agree token for token.

An overlap is widened, before anything is encoded, until it holds two stable boundaries, and
doubled if the encodings don't align in it. Only a stretch without any stable boundary, which is
one piece to the vocabulary, is encoded in one call whatever its length.

Shorter texts are encoded whole; where white space is a stable boundary, word by word, and a word
met before isn't encoded again.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fresh_name, slices, tidy, worker_state
from quire.llm.words import Words, WordTable, sums_between

#: Texts above this many characters are encoded in chunks of about as many.
CHUNK_CHARS = 1 << 15
#: Characters that neighbouring chunks share at least.
OVERLAP_CHARS = 1 << 9
#: Distinct words whose counts a worker keeps.
MEMO = 800_000

#: One encoding: token ids and, for each, the character offset at which it starts.
Encoded = tuple[list[int], list[int]]

#: Marks that no vocabulary served here joins to a letter before them and that Unicode composition leaves alone.
_STOPS = r"[,.;:!?。，、；：！？…]"


def json_encoder(path: str) -> Callable[[str], Encoded]:
    """Ids and start offsets as the tokenizers library gives them, special strings as by default."""
    tok = _tokenizer(path)

    def encode(text: str) -> Encoded:
        e = tok.encode(text, add_special_tokens=False)
        return e.ids, [a for a, _ in e.offsets]

    return encode


def model_encoder(path: str) -> Callable[[str], Encoded]:
    """The same for sentencepiece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(text: str) -> Encoded:
        found = model.encode(text, return_type="proto", num_threads=1).pieces
        # its offsets count bytes
        place = np.cumsum(np.frombuffer(text.encode("utf-8") + b"\0", np.uint8) & 0xC0 != 0x80) - 1
        return [p.id for p in found], place[[p.begin for p in found]].tolist() if len(found) else []

    return encode


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def json_boundaries(path: str) -> regex.Pattern | None:
    """Where a ``.json`` vocabulary always cuts (None: nowhere for sure).

    * White space between other characters, if the vocabulary removes it before it merges.
    * Otherwise one space or line end between letters or digits: runs of letters and of digits are
      pieces, with a space on their left at most.
    * A full stop or the like after a letter, since letters and marks are never of one piece.
    * Between digits, if every digit is a piece.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if _drops_white_space(spec):
        parts = [r"(?<=\S)[ \t\n\r\x0b\x0c](?=\S)"]
        if r"|[\p{N}]|" in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\"):
            parts.append("(?<=[0-9])(?=[0-9])")
    else:
        kinds = {x.get("type") for x in [spec.get("pre_tokenizer") or {}, *((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [])]}
        if not kinds & {"ByteLevel", "Split"}:
            return None
        parts = [r"(?<=[\p{L}\p{N}])[ \n](?=[\p{L}\p{N}])"]
    return regex.compile("|".join([*parts, r"(?<=\p{L})(?=" + _STOPS + ")"]))


def model_boundaries(path: str) -> regex.Pattern | None:
    """A single space between letters, if no piece of the sentencepiece vocabulary goes on past a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return None if any("▁" in p.lstrip("▁") for p in pieces) else regex.compile(r"(?<=\p{L}) (?=\p{L})")


class JsonCounter:
    """Token counts of texts by the tokenizers library.

    Where the vocabulary's first step cuts at white space and drops it, white space is a stable
    boundary on both sides: a text's count is the sum of its words' counts, and a word met before
    is not encoded again. Other vocabularies get the whole text.
    """

    def __init__(self, path: str, memo: int = MEMO):
        self._tok, self._words, self._sizes = _tokenizer(path), WordTable(memo), np.zeros(0, np.int64)
        with open(path, encoding="utf-8") as f:
            self.by_words = _drops_white_space(json.load(f))

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self._tok.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        if not self.by_words:
            return np.array(self._encode(pc.fill_null(texts, "").to_pylist()), np.int64)
        if self._words.full():
            self._words.clear()
            self._sizes = np.zeros(0, np.int64)
        words = Words(texts)
        rows, new = self._words.rows(words)
        if len(new):
            self._sizes = np.concatenate([self._sizes, np.array(self._encode(words.lines(new).decode("utf-8").split("\n")[:-1]), np.int64)])
        return sums_between(self._sizes[rows], words.bounds)


def _drops_white_space(spec: dict) -> bool:
    """Whether white space is collapsed and then lies outside every piece of a removing, inverted split."""
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", " ")
    added = all(not t["lstrip"] and not t["rstrip"] and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", []))
    return added and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and " " not in pattern.replace(r"[^\s", "") and "\\s" not in pattern.replace(r"[^\s", "")


def covered(text: str, begin: int, end: int, overlap: int, stable: regex.Pattern) -> tuple[int, list[int]]:
    """(where the chunk that begins at ``begin`` ends, at ``end`` or later; the stable boundaries in its overlap with the next).

    The overlap holds two boundaries at least, unless the chunk ends with the text.
    """
    if end >= len(text):
        return len(text), []
    places = [m.start() for m in stable.finditer(text, max(begin + 1, end - overlap), end)]
    if len(places) < 2:
        for m in stable.finditer(text, end):
            places.append(m.start())
            if len(places) >= 2:
                break
        else:
            return len(text), []
        end = min(len(text), places[-1] + 2)
    return end, places


def splice_point(left: Encoded, left_at: int, right: Encoded, right_at: int, places: list[int]) -> tuple[int, int] | None:
    """Where to splice: token numbers in both encodings, or None.

    The first of ``places`` at which a token begins in both encodings (at the space or just after
    it, as the vocabulary has it) and from which both agree up to the last place. Offsets of an
    encoding are relative to its own chunk, which begins at ``left_at``/``right_at``.
    """
    if len(places) < 2:
        return None

    def first(e: Encoded, at: int, place: int) -> int | None:
        i = bisect_left(e[1], place - at)
        return i if i < len(e[1]) and e[1][i] + at <= place + 1 else None

    x, y = first(left, left_at, places[-1]), first(right, right_at, places[-1])
    if x is None or y is None:
        return None
    for p in places[:-1]:
        a, b = first(left, left_at, p), first(right, right_at, p)
        if a is not None and b is not None and left[0][a:x] == right[0][b:y] and [s + left_at for s in left[1][a:x]] == [s + right_at for s in right[1][b:y]]:
            return a, b
    return None


def spliced(text: str, encode: Callable[[str], Encoded], stable: regex.Pattern | None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[list[int]]:
    """The ids of ``text``, piece by piece, exactly as ``encode`` gives them for the whole text."""
    n, chunk = len(text), max(2, chunk)
    if stable is None or n <= chunk:
        yield encode(text)[0]
        return
    begin = 0
    end, places = covered(text, 0, chunk, overlap, stable)
    ids, starts = encode(text[:end])
    done = 0  # tokens of the current chunk before this one are already out
    while end < n:
        wide = overlap
        while True:
            lo = min(max(begin, end - wide), max(begin, places[0] - 1))
            nxt, ahead = covered(text, lo, lo + chunk + (end - lo), overlap, stable)
            nids, nstarts = encode(text[lo:nxt])
            at = splice_point((ids, starts), begin, (nids, nstarts), lo, places)
            if at is not None or lo == begin:
                break
            wide = 2 * (end - lo)
            places = [m.start() for m in stable.finditer(text, max(begin + 1, end - wide), end)]
        if at is None:
            # the overlap is the whole chunk, so the next encoding begins where this one does and is
            # longer: it replaces it. What is out ends at a stable boundary, where its tokens go on.
            end, places, ids, starts = nxt, ahead, nids, nstarts
            continue
        yield ids[done : at[0]]
        done = at[1]
        begin, end, places, ids, starts = lo, nxt, ahead, nids, nstarts
    yield ids[done:]


def count_tokens(docs: DataFrame, tokenizer: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 2048, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``keep`` columns, ``n_bytes``, ``n_tokens``, ``over_limit`` for every row of ``docs``.

    ``tokenizer`` is the path of a ``.json`` vocabulary (tokenizers library) or a ``.model`` one
    (sentencepiece). Null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each;
    an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_bytes long, n_tokens long, over_limit boolean"])
    names, source = list(keep), fresh_name(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer.endswith(".json"):
            encode, stable = json_encoder(tokenizer), json_boundaries(tokenizer)
            counts_of = worker_state(f"counts of {tokenizer}", lambda: JsonCounter(tokenizer)).counts
        else:
            encode, stable = model_encoder(tokenizer), model_boundaries(tokenizer)
            counts_of = lambda texts: np.array([len(encode(t or "")[0]) for t in texts.to_pylist()], np.int64)
        for batch in batches:
            for lo, rows in slices(batch.column(source), 1024):
                part = batch.slice(lo, rows)
                texts = part.column(source)
                long = pc.fill_null(pc.greater(pc.utf8_length(texts), chunk_chars), False)
                n_tokens = counts_of(pc.if_else(long, "", texts)).copy()
                for i in np.flatnonzero(long.to_numpy(zero_copy_only=False)).tolist():
                    n_tokens[i] = sum(map(len, spliced(texts[i].as_py(), encode, stable, chunk_chars, overlap_chars)))
                n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), n_bytes, pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit, pa.bool_())], [*names, "n_bytes", "n_tokens", "over_limit"])
            tidy()

    return docs.select(*names, F.col(text).alias(source)).mapInArrow(run, schema)
