"""The states of batch jobs as a keyed store: a stream of attempts in, a stream of state changes out.

Each job's state is kept by Spark's state store under the job's name, so a restarted stream goes on
where it was, and the table of all jobs is never rewritten. A job that is to be tried again sets a
timer; when it runs out, the job is given out as due.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quire.operators.batch import FINISHED
from quire.session import ship

#: What an attempt reports: ``kind`` is ``attempt``, or ``cancel`` for a job that is not to go on.
EVENTS = "source string, at timestamp, kind string, load_error string, run_error string, pages bigint, flagged bigint, seconds double"
#: A state change; ``due`` marks a job whose wait for the next attempt is over.
CHANGES = "source string, no bigint, state string, attempts int, pages bigint, pages_flagged bigint, seconds double, error string, at timestamp, due boolean"
STATE = "no bigint, state string, attempts int, pages bigint, pages_flagged bigint, seconds double, error string"
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def known(x):
    return None if x is None or pd.isna(x) else x


def after(job: tuple, event: dict, max_attempts: int) -> tuple | None:
    """The state (STATE) of a job after an event; None if the event changes nothing.

    A job that is finished stays as it is. A load error is final at once. A run error is tried again
    until ``max_attempts``; the seconds of such attempts add up. A good attempt counts alone.
    """
    no, state, attempts, pages, flagged, seconds, _ = job
    if state in FINISHED:
        return None
    no += 1
    if event["kind"] == "cancel":
        return no, "cancelled", attempts, pages, flagged, seconds, "cancelled before it started"
    attempts, took = attempts + 1, float(known(event["seconds"]) or 0)
    load_error, run_error = known(event["load_error"]), known(event["run_error"])
    if load_error is not None:
        return no, "failed", attempts, pages, flagged, took, load_error
    if run_error is not None:
        if attempts >= max_attempts:
            return no, "failed", attempts, pages, flagged, seconds + took, f"failed after {attempts} attempt(s): {run_error}"
        return no, "retrying", attempts, pages, flagged, seconds + took, None
    pages, flagged = int(known(event["pages"]) or 0), int(known(event["flagged"]) or 0)
    return no, "review_required" if flagged else "completed", attempts, pages, flagged, took, None


class JobStates(StatefulProcessor):
    """One job's events to its state changes."""

    def __init__(self, max_attempts: int, retry_ms: int):
        self.max_attempts, self.retry_ms = max_attempts, retry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _changes(self, source: str, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in CHANGES.split(", ")]
        out = pd.DataFrame([(source, *r) for r in rows], columns=names)
        return out.astype({"at": "datetime64[ns]"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job = self.job.get() if self.job.exists() else (0, "queued", 0, 0, 0, 0.0, None)
        events = pd.concat(list(rows)).sort_values(["at", "kind"], kind="stable").to_dict("records")
        changes, job = [], tuple(job)
        for event in events:
            new = after(job, event, self.max_attempts)
            if new is not None:
                job = new
                changes.append((*job, event["at"], False))
        if changes:
            self.job.update(job)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if job[1] == "retrying":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retry_ms)
            yield self._changes(key[0], changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = tuple(self.job.get())
        if job[1] == "retrying":
            job = (job[0] + 1, *job[1:])
            self.job.update(job)
            yield self._changes(key[0], [(*job, pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), True)])


def state_changes(events: DataFrame, max_attempts: int = 2, retry_seconds: float = 30) -> DataFrame:
    """A stream of EVENTS to a stream of CHANGES. Events of one job that arrive together are taken by time."""
    ship(events.sparkSession)
    return events.groupBy("source").transformWithStateInPandas(statefulProcessor=JobStates(max_attempts, int(retry_seconds * 1000)), outputStructType=CHANGES, outputMode="Append", timeMode="ProcessingTime")


def keep_states(spark: SparkSession, events: DataFrame, checkpoint: str, output: str, *, trigger: dict | None = None, **options) -> StreamingQuery:
    """Append the changes that a stream of EVENTS makes to tables under ``output``, one a micro-batch, written again if it was lost half way.

    By default it takes what is there and stops; waits that are over by the next start come due then.
    (availableNow would go on for ever: a store with timers always asks for one more batch.)
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={number}")

    name, wanted = PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, wanted)
    try:  # a query keeps the settings that it was started with
        return state_changes(events, **options).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"once": True})).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def job_states(spark: SparkSession, output: str) -> DataFrame:
    """The last state of every job under ``output``, from partial maxima."""
    changes = spark.read.schema(f"{CHANGES}, batch long").parquet(output)
    last = changes.groupBy("source").agg(F.max_by(F.struct("state", "attempts", "pages", "pages_flagged", "seconds", "error", "at"), "no").alias("last"))
    return last.select("source", "last.*")
