"""Job states as a keyed store, gates of batches, exact percentiles by selection."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.operators import batch, reports
from quire.streaming import ingest, jobs


def event(source, at, load=None, run=None, flagged=0, seconds=1.0, kind="attempt"):
    return (source, at, kind, load, run, 4, flagged, float(seconds))


@pytest.fixture
def stream(spark, tmp_path):
    def feed(*batches, **options):
        for rows in batches:
            df = spark.createDataFrame(rows, jobs.EVENTS.replace("timestamp", "long", 1)).withColumn("at", F.timestamp_seconds("at"))
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        events = spark.readStream.schema(jobs.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")
        return jobs.keep_states(spark, events, f"{tmp_path}/checkpoint", f"{tmp_path}/changes", **options)

    return feed


def test_states_follow_attempts_over_restarts(spark, stream, tmp_path):
    stream([event("good", 1), event("flagged", 1, flagged=2), event("corrupt", 1, load="no pages"), event("later", 1, run="timeout", seconds=2), event("never", 1, run="gone", seconds=3)], max_attempts=2).awaitTermination()
    states = lambda: {r.source: (r.state, r.attempts, r.seconds, r.error) for r in jobs.job_states(spark, f"{tmp_path}/changes").collect()}
    assert states() == {"good": ("completed", 1, 1, None), "flagged": ("review_required", 1, 1, None), "corrupt": ("failed", 1, 1, "no pages"), "later": ("retrying", 1, 2, None), "never": ("retrying", 1, 3, None)}
    # a restart goes on from the kept states; a load error is never tried again, a finished job stays
    more = [event("later", 2, seconds=5), event("never", 2, run="gone", seconds=4), event("corrupt", 2), event("good", 2, run="timeout"), event("new", 2, kind="cancel"), event("good", 3, kind="cancel"), event("new", 3)]
    stream(more, max_attempts=2).awaitTermination()
    assert states() == {
        "good": ("completed", 1, 1, None), "flagged": ("review_required", 1, 1, None), "corrupt": ("failed", 1, 1, "no pages"), "later": ("completed", 2, 5, None),
        "never": ("failed", 2, 7, "failed after 2 attempt(s): gone"), "new": ("cancelled", 0, 0, "cancelled before it started"),
    }
    changes = spark.read.parquet(f"{tmp_path}/changes")
    assert changes.groupBy("source", "no").count().filter("count > 1").isEmpty()
    assert [r.state for r in changes.filter("source = 'never'").orderBy("no").collect()] == ["retrying", "failed"]


def test_retries_come_due_by_timer(spark, stream, tmp_path):
    query = stream([event("a", 1, run="timeout"), event("b", 1)], retry_seconds=0.5, trigger={"processingTime": "300 milliseconds"})
    try:
        for _ in range(120):
            time.sleep(0.5)
            assert query.exception() is None
            try:
                due = spark.read.parquet(f"{tmp_path}/changes").filter("due").collect()
            except Exception:  # noqa: BLE001 - nothing is written yet
                due = []
            if due:
                break
    finally:
        query.stop()
    assert [(r.source, r.state, r.attempts) for r in due] == [("a", "retrying", 1)]


def test_rules_of_one_job():
    fresh = (0, "queued", 0, 0, 0, 0.0, None)
    at = lambda **x: dict(kind="attempt", load_error=None, run_error=None, pages=3, flagged=0, seconds=1.0) | x
    once = jobs.after(fresh, at(run_error="x"), 3)
    twice = jobs.after(once, at(run_error="x"), 3)
    assert (once[1:3], twice[1:3], jobs.after(twice, at(run_error="y"), 3)[1:]) == (("retrying", 1), ("retrying", 2), ("failed", 3, 0, 0, 3.0, "failed after 3 attempt(s): y"))
    assert jobs.after(once, at(load_error="bad"), 3)[1] == "failed" and jobs.after(once, at(kind="cancel"), 3)[1] == "cancelled"
    assert all(jobs.after((1, s, 1, 0, 0, 0.0, None), at(), 3) is None for s in batch.FINISHED)


def test_gates_end_batches_and_the_next_run_goes_on(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    for i in range(3):
        (files / f"{i}.txt").write_text(f"text {i}")
        time.sleep(0.01)
    run = lambda gate: ingest.finished(ingest.run_new_files(spark, str(files), f"{tmp_path}/c", f"{tmp_path}/out", lambda df: df.select("path"), files_per_batch=1, gate=gate))
    asked = []

    def after_one():
        asked.append(1)
        if len(asked) > 1:
            (tmp_path / "cancel").write_text("")
        return ingest.gate(spark, f"{tmp_path}/cancel")()

    assert run(after_one) == "cancelled"
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    assert run(ingest.gate(spark, None, 1000, lambda: 10.0)) == "paused for memory"
    assert run(ingest.gate(spark, None, 1000, lambda: None)) is None  # what can't be seen blocks nothing
    assert spark.read.parquet(f"{tmp_path}/out").select("path").distinct().count() == 3
    assert (ingest.free_memory() or 1) > 0
    with pytest.raises(Exception, match="other"):
        (files / "4.txt").write_text("more")
        ingest.finished(ingest.run_new_files(spark, str(files), f"{tmp_path}/c", f"{tmp_path}/out", lambda df: df.select(F.raise_error(F.lit("other"))), gate=None))


def test_percentiles_by_selection(spark):
    rng = random.Random(3)
    rows = [("many", float(rng.randint(0, 900))) for _ in range(4000)] + [("two", 1.0), ("two", 4.0), ("one", 7.0), ("none", None), (None, 2.0), (None, 8.0)]
    got = {r.k: r for r in reports.percentiles(spark.createDataFrame(rows, "k string, seconds double").repartition(6), "k").collect()}
    assert set(got) == {"many", "two", "one", None}
    for k, r in got.items():
        v = sorted(x for n, x in rows if n == k)
        at = lambda f, v=v: v[min(len(v) - 1, round((len(v) - 1) * f))]
        assert (r.measured, r.median, r.p90, r.p95, r.max) == (len(v), (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2, at(0.9), at(0.95), v[-1])
        assert r.mean == pytest.approx(sum(v) / len(v))
