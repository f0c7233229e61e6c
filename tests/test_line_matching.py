"""Line alignment: one evaluation a pair, bounded objects in Python, difflib's results."""

import random
from difflib import SequenceMatcher

import pytest

from quire.functions import text as T
from quire.operators import align, blocks, compare, fuse


def expanded(ops):
    out = []
    for tag, i, i2, j, j2 in ops:
        out += [(tag, i + k, i + k + 1, j + k, j + k + 1) for k in range(i2 - i)] if tag == "equal" else [(tag, i, i2, j, j2)]
    return out


def test_opcodes_and_ratios_are_difflibs():
    rng = random.Random(3)
    pairs = []
    for _ in range(1500):
        words = rng.choice([4, 30, 200])
        a = [str(rng.randrange(words)) for _ in range(rng.randrange(rng.choice([3, 8, 20])))]
        b = [x for x in a if rng.random() < 0.8]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), str(rng.randrange(words)))
        assert expanded(align.opcodes(a, b)) == expanded(SequenceMatcher(None, a, b, autojunk=False).get_opcodes())
        pairs.append((" ".join(a), " ".join(b)))
    assert align.ratios_of(pairs) == [float(x == y) if not x or not y else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in pairs]


@pytest.mark.parametrize("made", [lambda p: compare.diff_lines(p, "doc"), lambda p: fuse.line_vote(p, "doc")])
def test_the_alignment_is_evaluated_once(spark, made):
    pairs = spark.createDataFrame([(1, "a\nb\nc7", "a\nc\nb"), (2, "x", "x\ny")], "doc long, text_a string, text_b string")
    plan = made(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Join") == 0 and plan.count("Union") == 0


def test_rows_are_those_of_the_matcher(spark):
    cases = [("a\nb", "a\nb\nc"), ("a\nb\nc", "a"), ("", "a"), (None, "a"), ("a", " "), ("k\na\nk", "k\na7\nk"), ("one\ntwo\nthree", "three\none\ntwo"), ("q", "z"), ("  a\x0b  b \t c\r\n", "a\rb c")]
    pairs = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "doc long, text_a string, text_b string")
    got = {}
    for r in compare.diff_lines(pairs, "doc").orderBy("doc", "row_no").collect():
        got.setdefault(r.doc, []).append((r.kind, r.text_a, r.text_b, r.similarity))
    lines = lambda x: [y for y in (" ".join(z.split()) for z in (x or "").splitlines()) if y]
    assert got == {i: align.diff_rows(lines(a), lines(b)) for i, (a, b) in enumerate(cases)}
    assert [r.x for r in pairs.orderBy("doc").select(T.lines("text_a").alias("x")).collect()] == [lines(a) for a, _ in cases]


def test_ratios_of_columns(spark):
    rows = [("row 3 of x", "row  3  of x"), ("abc", "xabcx"), ("", ""), (None, "a"), ("abcd", "bcda")]
    got = [r.r for r in spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "n long, a string, b string").orderBy("n").select(align.ratio("a", "b").alias("r")).collect()]
    assert got == [align.ratio_of(a or "", b or "") for a, b in rows]


def test_python_holds_a_slice_of_a_batch():
    import pyarrow as pa

    seen = [len(x) for x in align._slices(pa.array([["a"]] * 1000), pa.array([["b"]] * 1000))]
    assert max(seen) == align.SLICE and sum(seen) == 1000


def test_short_texts_are_matched_many_at_once(monkeypatch):
    rng = random.Random(7)
    pairs = [("row 3 | part 12 | of 4", "row  3  |  part 12  | of 4"), ("x" * 250, "xy" * 125), ("x" * 251, "xy" * 120)]
    for alphabet in ("ab", "é日a😀 1", "abcdefghijklmnop 0123", "ÿþa\ud800"):
        for _ in range(150):
            a = "".join(rng.choice(alphabet) for _ in range(rng.randrange(rng.choice([1, 6, 40, 260]))))
            b = "".join(c * rng.choice([0, 1, 1, 1, 1, 2]) for c in a)
            pairs.append((a, b))
    want = [sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) for a, b in pairs]
    short = [k for k, p in enumerate(pairs) if max(map(len, p)) <= blocks.SHORT]
    assert blocks.matched_characters([a for a, _ in pairs], [b for _, b in pairs]) == want and 3 < len(short) < len(pairs)
    monkeypatch.setattr(align, "_matched", None)  # no pair is matched by itself
    assert blocks.matched_characters([pairs[k][0] for k in short], [pairs[k][1] for k in short]) == [want[k] for k in short]


def test_python_holds_few_long_documents_of_a_batch():
    import pyarrow as pa

    long = pa.array([["a line of some length " * 3] * 150] * 400)
    seen = [len(x) for x in align._slices(long, long)]
    assert max(seen) < 32 and sum(seen) == 400


def test_statements_are_spread_over_tasks(spark, sf_dir):
    from quire.plans import catalogue

    assert "RepartitionByExpression [doc" in catalogue.QUERIES["positional_alignment"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("band", [1, 1 << 20])
def test_large_blocks_are_aligned_as_small_ones(monkeypatch, band):
    monkeypatch.setattr(align, "BAND", band)
    a = [f"entry {i} of {i * 37 % 1009} euro" for i in range(130)]
    b = [x + " paid" if i % 9 else f"# {i}" for i, x in enumerate(a) if i not in (0, 1, 60)]
    got = align.aligned_block(a, b, 0.55)  # more cells than MAX_CELLS
    monkeypatch.setattr(align, "MAX_CELLS", 10**9)
    assert len(a) * len(b) > 15_000 and got == align.aligned_block(a, b, 0.55)
    assert [r[:2] for r in got[:2]] == [("only_a", a[0]), ("only_a", a[1])]


def test_the_vote_on_a_large_block_keeps_each_line_once(spark):
    a = [f"entry {i} of {i * 37 % 1009} euro" for i in range(130)]
    pairs = spark.createDataFrame([(1, "\n".join(a), "\n".join(x + " paid" for x in a[2:]))], "doc long, text_a string, text_b string")
    row = fuse.line_vote(pairs, "doc").first()
    assert row.text.split("\n") == a[:2] + [x + " paid" for x in a[2:]] and row.reconciled == 128
