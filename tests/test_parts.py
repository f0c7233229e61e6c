"""Ordered output in bounded parts."""

from pathlib import Path

from pyspark.sql import functions as F

from quire.operators import compare
from quire.sources import export, parts


def pages_of(spark, n=400):
    long = spark.range(n).select(F.lit("long").alias("doc"), (F.lit(n) - F.col("id")).alias("page_number"), F.concat(F.lit("page "), F.lit(n) - F.col("id"), F.repeat(F.lit("é"), (F.col("id") % 7).cast("int"))).alias("text"))
    other = spark.createDataFrame([("short", 1, " one\ntwo "), ("short", 2, ""), ("short", 3, None), ("tie", 1, "b"), ("tie", 1, "a"), ("tie", 1, "a"), (None, 1, "none"), ("empty", 1, "")], "doc string, page_number bigint, text string")
    return long.unionByName(other)


def test_parts_join_to_the_whole_text(spark):
    pages = pages_of(spark)
    whole = {r["doc"]: r["text"] for r in compare.joined_text(pages, "doc").collect()}
    got = {}
    rows = parts.joined_parts(pages, "doc", part_bytes=300).orderBy("doc", "part").collect()
    for r in rows:
        got.setdefault(r["doc"], []).append(r["text"])
        assert r["bytes"] <= 300 + 20
    assert {d: "\n\n".join(x) for d, x in got.items()} == whole
    assert len(got["long"]) > 10 and len(got["tie"]) == 1 and "empty" not in got
    assert [r["part"] for r in rows if r["doc"] == "long"] == list(range(len(got["long"])))


def test_no_task_meets_a_whole_document(spark):
    placed = parts.placed(pages_of(spark, 4000).filter("doc = 'long'"), "doc", part_bytes=300)
    sizes = placed.groupBy("part").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).agg(F.max("b"), F.sum("n"), F.count("*")).first()
    assert sizes[0] <= 330 and sizes[1] == 4000 and sizes[2] > 100


def test_files_hold_a_document_in_order(spark, tmp_path):
    pages = pages_of(spark).filter("doc is not null")
    parts.write_texts(parts.joined_parts(pages, "doc", part_bytes=300), f"{tmp_path}/texts", "doc")
    whole = {r["doc"]: r["text"] for r in compare.joined_text(pages, "doc").collect()}
    for doc, text in whole.items():
        files = sorted(Path(f"{tmp_path}/texts/doc={doc}").glob("part=*/part-*"), key=lambda p: p.parent.name)
        assert "".join(p.read_bytes().decode() for p in files) == text + "\n"


def test_paginated_parts(spark):
    pages = pages_of(spark).filter("doc = 'long' or doc = 'short'")
    whole = {r["doc"]: r["content"].strip() for r in export.paginated(pages).collect()}
    got = {}
    for r in export.paginated_parts(pages, 500).orderBy("doc", "part").collect():
        got.setdefault(r["doc"], []).append(r["text"])
    assert {d: "\n\n".join(x) for d, x in got.items()} == whole


def test_no_pages_no_parts(spark):
    assert parts.joined_parts(pages_of(spark).limit(0), "doc").count() == 0


def test_csv_in_order(spark, tmp_path):
    rows = spark.range(500).select(F.lit("d").alias("doc"), F.lit(1).alias("place"), F.lit("E").alias("engine"), (500 - F.col("id")).cast("string").alias("page"))
    export.write_csv_in_order(rows, f"{tmp_path}/csv")
    lines = [x for p in sorted(Path(f"{tmp_path}/csv").glob("part-*")) for x in p.read_text().splitlines() if x.startswith('"E"')]
    assert lines == [f'"E","{n}"' for n in range(1, 501)]
