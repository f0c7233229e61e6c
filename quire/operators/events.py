"""Stages of a run and its log: kept by the driver and handed over as tables, or appended to a table at once."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

STATUSES = ("waiting", "running", "completed", "failed", "skipped")
STAGES = "place int, key string, label string, status string, seconds double, detail string"
EVENTS = "at timestamp, level string, message string, stage string, data map<string,string>"


class RunLog:
    """Stages in order of insertion, and events; subscribers hear of each event at once."""

    def __init__(self, clock: Callable[[], float] = time.perf_counter):
        self._clock, self._stages, self._events, self._heard = clock, {}, [], []

    def subscribe(self, hear: Callable[[dict], None]) -> None:
        self._heard.append(hear)

    def add_stage(self, key: str, label: str) -> None:
        self._stages.setdefault(key, {"label": label, "status": "waiting", "began": None, "seconds": None, "detail": ""})

    def start(self, key: str, message: str = "") -> None:
        self._stages[key] |= {"status": "running", "began": self._clock()}
        self.log("info", message or self._stages[key]["label"], key)

    def finish(self, key: str, status: str = "completed", detail: str = "") -> None:
        s = self._stages[key]
        s |= {"status": status, "detail": detail, "seconds": None if s["began"] is None else self._clock() - s["began"]}
        self.log("error" if status == "failed" else "info", detail or s["label"], key)

    def skip(self, key: str, why: str) -> None:
        self._stages[key] |= {"status": "skipped", "detail": why}
        self.log("info", f"{self._stages[key]['label']} skipped - {why}", key)

    def log(self, level: str, message: str, stage: str | None = None, **data: object) -> None:
        event = {"at": datetime.now(), "level": level, "message": message, "stage": stage, "data": {k: str(v) for k, v in data.items()}}
        self._events.append(event)
        for hear in self._heard:
            hear(event)

    def stages(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, k, s["label"], s["status"], s["seconds"], s["detail"]) for i, (k, s) in enumerate(self._stages.items())], STAGES)

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e["at"], e["level"], e["message"], e["stage"], e["data"]) for e in self._events], EVENTS)


#: An append-only table of what happened to the stages of runs, written by whoever runs them.
STAGE_EVENTS = "run string, stage string, at timestamp, status string, rows bigint, detail string"


class StageTable:
    """Stages of a run appended to a table at ``path``: one row when a stage begins and one when it ends."""

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.spark, self.path, self.run = spark, path, run

    def append(self, stage: str, status: str, rows: int | None = None, detail: str = "") -> None:
        row = self.spark.createDataFrame([(self.run, stage, datetime.now(), status, rows, detail)], STAGE_EVENTS)
        row.coalesce(1).write.mode("append").parquet(self.path)

    @contextmanager
    def stage(self, key: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
        """Gives a function that lets the executors count the rows of a table in passing, without a pass of their own.

        Of several watched tables the counts add up; one that no action has read counts nothing. An
        error inside the stage is its last event, and goes on.
        """
        watched: list[Observation] = []

        def watch(df: DataFrame) -> DataFrame:
            watched.append(Observation())
            return df.observe(watched[-1], F.count(F.lit(1)).alias("rows"))

        self.append(key, "running")
        try:
            yield watch
        except Exception as e:
            self.append(key, "failed", None, str(e).split("\n", 1)[0])
            raise
        # counts come in after their action, in the order of actions: once this one's is there, so are all before it
        last = Observation()
        self.spark.range(1).observe(last, F.count(F.lit(1)).alias("rows")).collect()
        last.get  # noqa: B018 - waits
        seen = [o.get["rows"] for o in watched if o._jo is not None and not o._jo.future().value().isEmpty()]
        self.append(key, "completed", sum(seen) if seen else None)

    def skip(self, key: str, why: str) -> None:
        self.append(key, "skipped", None, why)

    def events(self) -> DataFrame:
        return self.spark.read.schema(STAGE_EVENTS).parquet(self.path)


def stage_timings(events: DataFrame) -> DataFrame:
    """Per run and stage of a table like STAGE_EVENTS: the latest ``status``, ``attempts``, ``seconds`` and ``rows``.

    ``seconds`` go from the latest beginning to the latest end; null while the stage is running, or
    where it never began. Of events at one time the one whose status sorts last counts. One
    aggregate with partial sums, whatever the number of events.
    """
    began, ended = F.col("status") == "running", F.col("status").isin("completed", "failed")
    at = F.struct("at", "status")
    last = lambda c, on=None: F.max_by(c, at if on is None else F.when(on, at))
    found = events.groupBy("run", "stage").agg(last("status").alias("status"), F.count_if(began).alias("attempts"), F.max(F.when(began, F.col("at"))).alias("b"), F.max(F.when(ended, F.col("at"))).alias("e"), last("rows", ended).alias("rows"))
    seconds = F.when((F.col("status") != "running") & (F.col("e") >= F.col("b")), (F.unix_micros(F.col("e").cast("timestamp")) - F.unix_micros(F.col("b").cast("timestamp"))) / 1e6)
    return found.select("run", "stage", "status", "attempts", seconds.alias("seconds"), "rows")


def line(at: Column, message: Column) -> Column:
    """``[HH:MM:SS] message``."""
    return F.concat(F.lit("["), F.date_format(at, "HH:mm:ss"), F.lit("] "), message)


def text_summary(c: str | Column, redact: bool = True, preview: int = 80) -> Column:
    """``N characters, M words``, with a preview only if texts may be shown."""
    said = F.concat(F.format_number(F.length(T.column(c)), 0), F.lit(" characters, "), F.format_number(T.word_count(c), 0), F.lit(" words"))
    return said if redact else F.concat(said, F.lit(": "), F.substring(T.normal_line(c), 1, preview))
