"""Texts are assessed once, by classes that match fast; backward windows add up once; few large sources are dealt out."""

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import accuracy, anchors, fuse, ranks, routing
from quire.plans.fixtures import fixture


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _characters(spark):
    points = spark.range(1, 0x3100).filter("id < 55296").unionByName(spark.createDataFrame([(0xFF21,), (0x1D400,), (0x1F600,), (0x10FFFF,)], "id long"))
    return points.select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))


def test_fast_classes_hold_the_same_characters(spark):
    df = _characters(spark)
    ends = r"\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}"
    plain = {T.UNFOLDED: r"[^a-z0-9.,%$/:()\-\s]", T.INNER: rf"{T.SPACE[:-1]}&&[^{ends}]]", T.INNER_ODD: rf"{T.SPACE[:-1]}&&[^{ends} ]]", T.SPACE_ODD: rf"{T.SPACE[:-1]}&&[^ ]]"}
    for fast, slow in plain.items():
        assert df.filter(F.col("c").rlike(fast) != F.col("c").rlike(slow)).count() == 0, fast
    assert df.filter(T.may_change("c") != F.col("c").rlike(T.NORMAL)).count() == 0


def test_backward_values_are_added_up_in_opposite_order(spark):
    df = spark.createDataFrame([("a", i, i * 7 % 11) for i in range(50)] + [("b", 1, 5)], "k string, i long, v long")
    got = ranks.running(ranks.dealt(df, ["k"], [F.col("i")]), ["k"], [F.col("i")], {"low": ("min", F.col("v"), True), "left": ("count", F.col("v"), True)})
    assert "unboundedfollowing" not in _plan(got).lower()
    for r in got.collect():
        rest = [i * 7 % 11 for i in range(r["i"], 50)] if r["k"] == "a" else [5]
        assert (r["low"], r["left"]) == (min(rest), len(rest))


def test_routes_assess_a_page_once(spark, sf_dir):
    routes = routing.routed(fixture(spark, sf_dir, "pages"))
    assert "EvalPython" not in _plan(routes.filter("page_class = 'needs_ocr'"))
    assert "EvalPython" not in _plan(accuracy.gold_summary(fixture(spark, sf_dir, "pages")))


def test_pages_of_a_large_source_are_dealt_out(spark, sf_dir):
    for name in ("pages", "engines"):
        assert "hashpartitioning(doc" in _plan(fixture(spark, sf_dir, name)) and "page_number" in _plan(fixture(spark, sf_dir, name)).split("hashpartitioning(doc", 1)[1][:40]


def test_the_guard_shuffles_no_words(spark):
    rows = [(1, "a b b C", "a b", "c d"), (2, "", "a", "b"), (3, "x y", None, None), (4, "Übung 1,5 1,5", "übung 1,5", "1,5 1,5"), (5, "- -", "-", "-")]
    got = fuse.guarded(spark.createDataFrame(rows, "k int, fused string, text_a string, text_b string"), "k")
    assert "Exchange" not in _plan(got)
    assert {r["k"]: r["containment"] for r in got.collect()} == {1: 0.75, 2: None, 3: 0.0, 4: 1.0, 5: None}


def test_long_documents_are_normalised_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def watched(x):
        seen.add(1)
        return x

    lines = spark.createDataFrame([("d", i, f"line {i}") for i in range(40)], "doc string, line_no long, line string")
    anchors.aligned(lines.withColumn("line", watched("line")), lines, "doc").count()
    assert seen.value == 40
