"""Operators on documents of any length: ranks by ranges, alignment by anchors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import accuracy, align, anchors, blocks, ranks


def test_running_values_by_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randint(-50, 50)) for i in range(3000)] + [("one", 1, 5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(7)
    values = {"s": ("sum", F.col("v"), False), "top": ("max", F.col("v"), False), "low": ("min", F.col("v"), True), "n": ("count", F.lit(1), False)}
    table = ranks.dealt(df, ["k"], [F.col("i")])
    assert table.filter("k = 'a'").select(ranks.PART).distinct().count() > 1  # a group is spread
    got = {(r.k, r.i): (r.s, r.top, r.low, r.n) for r in ranks.running(table, ["k"], [F.col("i")], values).collect()}
    for k in ("a", "b", None, "one"):
        of = sorted((i, v) for x, i, v in rows if x == k)
        for p, (i, _) in enumerate(of):
            upto, on = [v for _, v in of[: p + 1]], [v for _, v in of[p:]]
            assert got[k, i] == (sum(upto), max(upto), min(on), p + 1)


def reading(rng, lines):
    """A reading that drops, doubles, edits and moves lines."""
    out = []
    for x in lines:
        k = rng.random()
        out += [] if k < 0.06 else [x, x] if k < 0.09 else [x + " edited"] if k < 0.16 else [x, f"new {rng.random()}"] if k < 0.2 else [x]
    if len(out) > 6 and rng.random() < 0.6:
        n, at, to = rng.randint(1, len(out) // 3), rng.randint(0, len(out) // 2), rng.randint(0, len(out) // 2)
        block = out[at : at + n]
        del out[at : at + n]
        out[to:to] = block
    return out


def rows_of_lines(spark, docs):
    rows = [(d, "x", n, line) for d, lines in docs.items() for n, line in enumerate(lines)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "doc int, line_a string, line_no int, line string").repartition(5)


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.row_no):
        rows = out.setdefault(r.doc, [])
        assert r.row_no == len(rows)
        rows.append((r.kind, r.text_a, r.text_b, round(r.similarity, 9)))
    return out


def plain(a, b):
    return [(k, x, y, round(r, 9)) for k, x, y, r in align.diff_rows(a, b)]


def test_anchored_rows_equal_whole_matching(spark):
    rng = random.Random(4)
    left, right = {}, {}
    for d in range(150):
        words = [f"w{rng.randint(0, rng.choice([3, 12, 400]))}" for _ in range(rng.randint(0, 60))]
        lines = [" ".join(words[i : i + 2]) for i in range(0, len(words), 2)] + [f"line {i} of document {d}" for i in range(rng.randint(0, 30))]
        if rng.random() < 0.5:
            rng.shuffle(lines)
        left[d], right[d] = lines, reading(rng, lines)
    left[99], right[98] = ["only here", "and here"], ["only there"]
    got = found(anchors.aligned(rows_of_lines(spark, left), rows_of_lines(spark, right), "doc", at_once=5, cut=10**9))
    for d in {*left, *right}:
        assert got.get(d, []) == plain(left.get(d, []), right.get(d, [])), d


def test_long_documents_meet_the_matcher_in_short_stretches(spark, monkeypatch):
    lines = [f"entry {i} carries amount {i * 37 % 1009}" if i % 11 else "carried forward" for i in range(30_000)]
    other = [x + "7" if i % 50 == 5 else x for i, x in enumerate(lines) if i % 70 != 3]
    sizes = []
    real = align.diff

    def noted(a, b, least):
        sizes.append((a, b))
        return real(a, b, least)

    monkeypatch.setattr(align, "diff", noted)
    rows = anchors.aligned(rows_of_lines(spark, {1: lines}), rows_of_lines(spark, {1: other}), "doc", at_once=500)
    kinds = {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()}
    changed = sum(i % 50 == 5 and i % 70 != 3 for i in range(30_000))
    dropped = sum(i % 70 == 3 for i in range(30_000))
    assert kinds == {"equal": 30_000 - changed - dropped, "changed": changed, "only_a": dropped} and sizes
    assert [r.row_no for r in rows.orderBy("row_no").collect()] == list(range(30_000))


def test_stretches_without_separators_are_cut_by_place(spark):
    a, b = ["x", "y"] * 60, ["x", "z"] * 80
    got = found(anchors.aligned(rows_of_lines(spark, {1: a}), rows_of_lines(spark, {1: b}), "doc", at_once=20, cut=40))[1]
    want = [r for i in range(0, 160, 10) for r in plain(a[i : i + 10], b[i : i + 10])]
    assert got == want


def test_empty_sides(spark):
    none = rows_of_lines(spark, {})
    some = rows_of_lines(spark, {3: ["p", "", "q"]})
    assert found(anchors.aligned(none, none, "doc")) == {}
    assert found(anchors.aligned(none, some, "doc")) == {3: [("only_b", "", "p", 0.0), ("only_b", "", "q", 0.0)]}


def test_seed_matching_is_difflibs():
    rng = random.Random(5)
    for doublings in (1, 2, 3, 4):
        a, b = [], []
        for _ in range(150):
            letters = rng.choice(["ab", "abcd", "abcdefghijklmnopqrstuvwxyz "])
            x = [rng.choice(letters) for _ in range(rng.choice([0, 3, 40, 200]))]
            x += x[: rng.randint(0, 80)] * rng.randint(0, 2)
            y = list(x)
            for _ in range(rng.randint(0, 12) if y else 0):
                p, q, n = rng.randrange(len(y) + 1), rng.randrange(len(y) + 1), rng.randint(1, 50)
                part = y[p : p + n]
                if rng.random() < 0.6:
                    del y[p : p + n]
                y[q:q] = part if rng.random() < 0.6 else [rng.choice(letters)]
            a.append(x)
            b.append(y)
        a, b = [*a, [], ["z"], []], [*b, ["z"], [], []]
        codes = [np.array([ord(c) for x in side for c in x]) for side in (a, b)]
        bounds = [blocks._bounds(list(map(len, side))) for side in (a, b)]
        assert blocks.matched_sizes(codes[0], bounds[0], codes[1], bounds[1], doublings).tolist() == [align._matched(x, y) for x, y in zip(a, b, strict=True)]


def test_measures_of_rows(spark):
    texts = [("Total: 1,250.00 due", "total 1,250.00 due (5)"), ("a b a c", "c a"), (None, ""), ("", "x 7"), ("-$- (1) 1 2 ...", "1 3"), ("same same", "same same"), ("word " * 3000, "word " * 2999 + "ward"), ("É Straße 10:30", "stra e 10:30")]
    df = spark.createDataFrame([(1 if i < 2 else i, *t) for i, t in enumerate(texts)], "i int, reference string, hypothesis string")
    folded = df.select(F.array_join(T.fold("reference"), " "), T.folded("reference"), F.array_join(T.fold("hypothesis"), " "), T.folded("hypothesis")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in folded)
    rows = accuracy.measures(df, "i", limit=9_000).collect()
    assert sorted(r.i for r in rows) == [1, 1, 2, 3, 4, 5, 6, 7]  # rows that repeat a key are pages of their own
    by = {(r.i, r.reference_words, r.hypothesis_words): r for r in rows}
    assert (by[1, 3, 4].wer, by[1, 3, 4].recall, by[1, 3, 4].figure_recall) == (0, 1, 1)
    assert (by[1, 4, 2].wer, by[1, 4, 2].recall) == (0.75, 0.75)
    assert (by[2, 0, 0].wer, by[2, 0, 0].cer, by[2, 0, 0].recall, by[2, 0, 0].figure_recall) == (0, 0, 1, 1)
    assert (by[3, 0, 2].wer, by[3, 0, 2].recall) == (1, 1)
    assert by[4, 3, 2].figure_recall == 1 / 3 and by[4, 3, 2].recall == 2 / 3
    assert by[6, 3000, 3000].cer is None and by[6, 3000, 3000].wer == pytest.approx(1 / 3000)
    assert accuracy.measures(df.limit(0), "i").count() == 0


def test_rates_of_long_pages_are_averaged_too(spark, sf_dir, tmp_path):
    from quire.plans import catalogue

    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(6_000)) + " the end 05"
    spark.createDataFrame([(1, text, "s"), (2, "a the b 0", "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalogue.error_rates(spark, str(tmp_path)).collect()}
    whole = spark.createDataFrame([(text, text.replace("05", "17").replace(" the ", " teh ") + " (total: 1,250.00)")], "r string, h string").select(T.folded("r"), T.folded("h")).first()
    assert len(whole[0]) > 20_000 and got[1].cer == pytest.approx(1 - align.matched_size(list(whole[0]), list(whole[1])) / len(whole[0]))
    row = catalogue.accuracy_report_aligned(spark, str(tmp_path)).first()
    assert row.pages == 2 and row.cer == pytest.approx((got[1].cer + got[2].cer) / 2)


def test_only_the_rows_table_of_an_alignment_stays(spark):
    import os

    from quire.shared import work_dir

    lines = [f"entry {i} of {i * 37 % 1009}" for i in range(400)]
    folder = work_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    rows = anchors.aligned(rows_of_lines(spark, {1: lines}), rows_of_lines(spark, {1: lines[:100] + lines[103:]}), "doc", at_once=50)
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["ranges"] and rows.filter("kind = 'only_a'").count() == 3
