"""Command line: run, check, providers, profiles, batch, bench and accuracy, as thin calls of the transforms."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.operators import accuracy, batch, cascade, compare, fuse, reports, routing
from quire.params import PROFILES, Settings, profile_of, with_profile
from quire.shared import written
from quire.sources import documents, parts

ENGINES = cascade.Registry([cascade.Engine("text_layer", "Embedded text", lambda page: {}), cascade.stub_engine("vision_a"), cascade.stub_engine("vision_b"), cascade.stub_engine("classic")])


def _spark() -> SparkSession:
    return SparkSession.builder.appName("quire").getOrCreate()


def _pages(spark: SparkSession, path: str):
    """Pages from Parquet (doc, page_number, embedded_text, ink) or from document files: PDF and images."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return documents.pages_under(spark, path).filter("error is null").drop("error")


def settings_of(args: argparse.Namespace) -> Settings:
    """The profile first, then what the flags say: a flag wins over the profile."""
    s = with_profile(Settings(), args.profile) if getattr(args, "profile", None) else Settings()
    if getattr(args, "fusion", None):
        s = Settings(**{**s.__dict__, "fusion": args.fusion})
    return s


def transcribed(pages, s: Settings, mode: str = "cascade"):
    """(routes or None, page results, final texts) of pages: a cascade over routed pages, or all engines on all pages.

    Texts are fused page by page where engines divide the pages between them, else as wholes.
    """
    routes = routing.routed_or_all(pages, rule=s.routing) if mode == "cascade" else None
    engines = ENGINES.ordered(s.engine_order)
    results = cascade.all_engines(pages, engines) if routes is None else cascade.cascade(routes, engines, s.confidence)
    status = cascade.engine_status(results, "doc", "engine_id").select("doc", "engine_id", "engine_status")
    known = results.join(status, ["doc", "engine_id"])
    if routes is None:
        return routes, known, fuse.fused(compare.joined_text(known, "doc", "engine_id", "engine_ord", "engine_status"), s.fusion).select("doc", "text")
    return routes, known, fuse.pagewise(known, s.fusion).select("doc", "text")


def run(args: argparse.Namespace) -> int:
    s = settings_of(args)
    _, results, texts = transcribed(_pages(_spark(), args.path), s, args.mode)
    texts.write.mode("overwrite").parquet(args.output)
    if args.texts:
        parts.write_texts(parts.joined_parts(fuse.page_choices(results, s.fusion), "doc", trim=True), args.texts, "doc")
    return 0


def check(args: argparse.Namespace) -> int:
    for h in ENGINES.health_report():
        print(json.dumps(h))
    found = documents.described(documents.files(_spark(), args.path))
    found.groupBy("kind", F.col("load_error").isNull().alias("loadable")).count().show(truncate=False)
    return 0


def providers(args: argparse.Namespace) -> int:
    for e in ENGINES.describe():
        print(json.dumps(e))
    return 0


def profiles(args: argparse.Namespace) -> int:
    now = profile_of(Settings())
    for name, values in PROFILES.items():
        print(name + (" (current)" if name == now else ""), json.dumps(values))
    return 0


def batch_documents(found, s: Settings):
    """A batch of files to (doc, state, pages, pages_via_model, pages_flagged, seconds, error, text), one row per file.

    A file that can't be loaded is failed with its error; the others are transcribed together.
    """
    from quire.operators.confidence import scored

    seen = documents.described(found, s.documents)
    fine = found.join(seen.filter("load_error is null").select(F.col("doc").alias("path"), "kind"), "path")
    pages = documents.loaded_pages(fine.filter("kind <> 'image'").drop("kind"), s.documents).withColumn("ink", F.lit(None).cast("double"))
    images = [r["path"] for r in fine.filter("kind = 'image'").select("path").collect()]  # a batch is bounded
    if images:
        pages = pages.unionByName(documents.image_pages(found.sparkSession, images, s.documents, s.routing))
    pages = written(pages, "batch-pages")
    bad = pages.filter("error is not null").groupBy("doc").agg(F.first("error").alias("page_error"))
    good = pages.filter("error is null").drop("error")
    routes, results, texts = transcribed(good, s)
    read = results.join(good.select("doc", "page_number", "ink"), ["doc", "page_number"], "left")
    judged = scored(read.filter("engine_id <> 'text_layer'"), s.confidence)
    totals = results.groupBy("doc").agg(F.count_distinct("page_number").alias("pages"), F.count_distinct(F.when(F.col("engine_id") != "text_layer", F.col("page_number"))).alias("pages_via_model"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
    flagged = judged.filter(F.size("flags") > 0).groupBy("doc").agg(F.count_distinct("page_number").alias("pages_flagged"))
    df = seen.select("doc", "load_error")
    for part in (bad, totals, flagged, texts):
        df = df.join(part, "doc", "left")
    df = df.fillna(0, ["pages", "pages_via_model", "pages_flagged", "seconds"])
    error = F.coalesce("load_error", "page_error")
    return df.select("doc", batch.next_state(error, F.lit(None).cast("string"), F.col("pages_flagged"), F.lit(1)).alias("state"), "pages", "pages_via_model", "pages_flagged", "seconds", error.alias("error"), "text")


def run_batch(args: argparse.Namespace) -> int:
    """Transcribe the files that no earlier run has finished; a killed run goes on where it was."""
    from quire.streaming.ingest import finished, gate, run_new_files

    s, spark = settings_of(args), _spark()
    held = finished(
        run_new_files(spark, args.path, f"{args.output}/_checkpoint", f"{args.output}/documents", lambda found: batch_documents(found, s), files_per_batch=args.files_at_once, gate=gate(spark, f"{args.output}/_cancel", args.memory_floor_mb))
    )
    if held:
        print(f"stopped: {held}; what is left will be done by the next run")
    done = _spark().read.parquet(f"{args.output}/documents")
    batch.progress(done.withColumn("source", F.col("doc"))).show(vertical=True)
    return 0


def bench(args: argparse.Namespace) -> int:
    """Transcribe each document; a row per document, then the totals."""
    began = time.time()
    pages = _pages(_spark(), args.path)
    routes, results, texts = transcribed(pages, Settings())
    docs = pages.select("doc").distinct().withColumn("load_error", F.lit(None).cast("string"))
    rows = reports.document_benchmark(docs, routes, results, texts)
    for r in rows.orderBy("doc").toLocalIterator():
        print(json.dumps(r.asDict()))
    row = reports.benchmark_totals(rows.withColumn("memory_mb", F.lit(None).cast("double"))).first().asDict()
    print(json.dumps(row | {"seconds": round(time.time() - began, 2)}))
    return 0


def measure_accuracy(args: argparse.Namespace) -> int:
    spark = _spark()
    gold = accuracy.gold_set(_pages(spark, args.path), limit=args.limit)
    read = spark.read.parquet(args.results).select("doc", "page_number", F.col("text").alias("hypothesis"))
    accuracy.report(accuracy.scores(gold.join(read, ["doc", "page_number"]), "doc", "page_number")).show(vertical=True)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, f, paths in (("run", run, 2), ("check", check, 1), ("providers", providers, 0), ("profiles", profiles, 0), ("batch", run_batch, 2), ("bench", bench, 1), ("accuracy", measure_accuracy, 1)):
        c = sub.add_parser(name)
        c.set_defaults(call=f)
        if paths:
            c.add_argument("path")
        if paths > 1:
            c.add_argument("--output", required=True)
        if name in ("run", "batch"):
            c.add_argument("--profile", choices=sorted(PROFILES))
        if name == "batch":
            c.add_argument("--files-at-once", type=int, default=1000)
            c.add_argument("--memory-floor-mb", type=float, default=0)
        if name == "run":
            c.add_argument("--mode", choices=["cascade", "all_engines"], default="cascade")
            c.add_argument("--texts", help="a folder for text files, page by page, in parts of bounded size")
            c.add_argument("--fusion", choices=["prefer_primary", "prefer_longest", "line_vote"])
        if name == "accuracy":
            c.add_argument("--results", required=True)
            c.add_argument("--limit", type=int, default=0)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.call(args)


if __name__ == "__main__":
    raise SystemExit(main())
