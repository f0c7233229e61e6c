"""Which engine reads which page: a registry of engines, the cascade, and what routing fills in itself."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.confidence import scored, selected_for_rereading
from quire.operators.routing import assessed
from quire.params import Confidence, Routing
from quire.session import ship
from quire.shared import written

RESULT = "doc string, page_number bigint, engine_id string, engine_ord int, text string, status string, error string, done_reason string, seconds double, input_tokens bigint, output_tokens bigint"


@dataclass(frozen=True)
class Engine:
    """An engine: ``read(page) -> dict`` runs on the executors, once per page, and may raise."""

    engine_id: str
    name: str
    read: Callable[[dict], dict]
    model: str | None = None
    location: str = "local"
    retries: int = 1
    #: Seconds before the first further try, and before any at most.
    wait: float = 0.2
    longest_wait: float = 30.0
    options: dict = field(default_factory=dict)
    #: Whether the engine can be used now: (available, message, remedy); asked on the driver, once a run.
    health: Callable[[], tuple[bool, str, str | None]] = lambda: (True, "ready", None)


class Registry:
    """Engines by id, in order of registration."""

    def __init__(self, engines: Iterable[Engine] = ()):
        self._engines: dict[str, Engine] = {}
        self._on: set[str] = set()
        for e in engines:
            self.register(e)

    def register(self, engine: Engine, replace: bool = False) -> None:
        if engine.engine_id in self._engines and not replace:
            raise ValueError(f"engine {engine.engine_id} is registered already")
        self._engines[engine.engine_id] = engine
        self._on.add(engine.engine_id)

    def unregister(self, engine_id: str) -> None:
        self._engines.pop(engine_id, None)
        self._on.discard(engine_id)

    def get(self, engine_id: str) -> Engine:
        return self._engines[engine_id]

    def enable_only(self, ids: Iterable[str]) -> None:
        self._on = set(ids) & set(self._engines)

    def ordered(self, first: Iterable[str] = ()) -> list[Engine]:
        """Enabled engines: those of ``first`` in that order, then the others as registered."""
        ids = [i for i in first if i in self._on]
        return [self._engines[i] for i in ids + [i for i in self._engines if i in self._on and i not in ids]]

    def health_report(self) -> list[dict]:
        """What every enabled engine says of itself; an engine whose check raises is not available."""
        out = []
        for e in self.ordered():
            try:
                available, message, remedy = e.health()
            except Exception as error:  # noqa: BLE001
                available, message, remedy = False, str(error), None
            out.append({"engine_id": e.engine_id, "available": available, "message": message, "remedy": remedy})
        return out

    def describe(self) -> list[dict]:
        return [{"engine_id": e.engine_id, "name": e.name, "model": e.model, "location": e.location, "enabled": e.engine_id in self._on} for e in self._engines.values()]


CUT = "the output reached the token limit and was cut off"
EMPTY = "the engine returned no text"


def page_status(text: str, done_reason: str | None, error: str | None) -> tuple[str, str | None]:
    """(status, error) of a page: empty output failed; output cut at the limit succeeded, with a note."""
    if not (text or "").strip():
        return "failed", error or EMPTY
    if error is not None:
        return "failed", error
    return "success", CUT if done_reason == "length" else None


def run_engine(pages: DataFrame, engine: Engine, order: int) -> DataFrame:
    """Results of one engine for its pages (RESULT); a page that fails is a row with its error, never a lost row.

    A failed read is tried again after a wait that doubles each time; an error marked ``permanent``
    isn't. Empty output is a failed page. Evaluating the result again asks the engine again:
    ``read_once`` keeps it.
    """
    ship(pages.sparkSession)
    columns = [c for c in pages.columns if c not in ("cleaned", "reason", "route_reason", "fingerprint")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch.to_dict("records"):
                out, error = {}, None
                for attempt in range(engine.retries + 1):
                    if attempt:
                        time.sleep(min(engine.wait * 2 ** (attempt - 1), engine.longest_wait))
                    try:
                        out, error = engine.read(page), None
                        break
                    except Exception as e:  # noqa: BLE001 - whatever an engine raises is that page's error
                        error = str(e)
                        if getattr(e, "permanent", False):
                            break
                text = out.get("text") or ""
                status, said = page_status(text, out.get("done_reason"), error or out.get("error"))
                rows.append((page["doc"], page["page_number"], engine.engine_id, order, text, status, said, out.get("done_reason"), out.get("seconds"), out.get("input_tokens"), out.get("output_tokens")))
            names = [c.split()[0] for c in RESULT.split(", ")]
            frame = pd.DataFrame(rows, columns=names)
            for c in ("input_tokens", "output_tokens"):
                frame[c] = frame[c].astype("Int64")
            frame["seconds"] = frame["seconds"].astype("float64")
            yield frame

    return pages.select(*columns).mapInPandas(run, RESULT)


def read_once(pages: DataFrame, engine: Engine, order: int) -> DataFrame:
    """``run_engine``, kept as a table: whatever is made of the results, the engine is asked once a page.

    Engines cost far more than the table, and some answer differently when asked again.
    """
    return written(run_engine(pages, engine, order), f"read-{order}")


def text_layer_results(pages: DataFrame, order: int = 0, rule: Routing = Routing()) -> DataFrame:
    """The engine that reads embedded text, in the JVM: the cleaned layer, or a failed page with the reason."""
    df = pages if {"usable", "cleaned", "reason"} <= set(pages.columns) else assessed(pages, rule=rule)
    none = lambda kind: F.lit(None).cast(kind)
    return df.select(
        "doc", F.col("page_number").cast("bigint").alias("page_number"), F.lit("text_layer").alias("engine_id"), F.lit(order).alias("engine_ord"), F.when(F.col("usable"), F.col("cleaned")).otherwise("").alias("text"),
        F.when(F.col("usable"), "success").otherwise("failed").alias("status"), F.when(~F.col("usable"), F.col("reason")).alias("error"), none("string").alias("done_reason"), F.lit(0.0).alias("seconds"), none("bigint").alias("input_tokens"), none("bigint").alias("output_tokens"),
    )


def engine_status(results: DataFrame, *keys: str) -> DataFrame:
    """Per engine run: all pages well ``success``, none (or no page) ``failed``, else ``partial``; the first error in page order."""
    ok = F.count_if(F.col("status") == "success")
    status = F.when(ok == 0, "failed").when(ok == F.count("*"), "success").otherwise("partial")
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page_number")))
    return results.groupBy(*keys).agg(F.count("*").alias("pages"), ok.alias("succeeded"), status.alias("engine_status"), first.alias("first_error"))


def cascade(routes: DataFrame, engines: list[Engine], rule: Confidence = Confidence(), *, fallback_on_total_failure: bool = False) -> DataFrame:
    """Results of all engines over routed pages: the text layer reads its own, the first engine the
    rest, the others what verification flags. Each engine is asked once for each of its pages.

    If the first engine has no result for a page, nothing flags that page; with
    ``fallback_on_total_failure`` such pages are flagged as empty.
    """
    others = [e for e in engines if e.engine_id != "text_layer"]
    # routes are read once; what follows reads the table, and its filters on the class are pushed down
    kept = ["doc", "page_number", "ink", "embedded_text", "image", "usable", "cleaned", "reason", "page_class"]
    routes = written(routes.select(*(c for c in kept if c in routes.columns)), "routes")
    out = text_layer_results(routes.filter("page_class = 'text_layer'"))
    todo = routes.filter("page_class = 'needs_ocr'").drop("cleaned", "reason", "usable", "page_class")
    if not others:
        return out
    first = read_once(todo, others[0], 1)
    out = out.unionByName(first)
    if len(others) == 1 or not rule.fallback_enabled:
        return out
    judged = first.join(todo.select("doc", "page_number", "ink"), ["doc", "page_number"], "right" if fallback_on_total_failure else "inner")
    again = written(todo.join(selected_for_rereading(scored(judged, rule), rule).select("doc", "page_number"), ["doc", "page_number"], "left_semi"), "again")
    for i, e in enumerate(others[1:], start=2):
        out = out.unionByName(read_once(again, e, i))
    return out


def all_engines(pages: DataFrame, engines: list[Engine], *, continue_on_error: bool = True) -> DataFrame:
    """Every engine reads every page, once; unless ``continue_on_error``, engines after one without any good page don't run."""
    out = None
    for i, e in enumerate(engines):
        part = text_layer_results(pages, i) if e.engine_id == "text_layer" else read_once(pages, e, i)
        out = part if out is None else out.unionByName(part)
        if not continue_on_error and i + 1 < len(engines) and part.filter("status = 'success'").isEmpty():
            break
    return out


def skipped(docs: DataFrame, results: DataFrame, engines: list[Engine]) -> DataFrame:
    """``doc``, ``engine_id``, ``engine_status``: engines that had no page of a document to read (a cascade's usual case)."""
    ids = F.array(*(F.lit(e.engine_id) for e in engines))
    each = docs.select("doc").distinct().withColumn("engine_id", F.explode(ids))
    return each.join(results.select("doc", "engine_id").distinct(), ["doc", "engine_id"], "left_anti").withColumn("engine_status", F.lit("skipped"))


def with_remedy(status: DataFrame, health: list[dict]) -> DataFrame:
    """``engine_status`` rows with ``first_remedy``: what the engine's own health report advises, where a run failed."""
    advice = {h["engine_id"]: h["remedy"] for h in health if h["remedy"]}
    if not advice:
        return status.withColumn("first_remedy", F.lit(None).cast("string"))
    known = F.create_map(*(F.lit(x) for pair in advice.items() for x in pair))
    return status.withColumn("first_remedy", F.when(F.col("engine_status") != "success", known[F.col("engine_id")]))


def unread(routes: DataFrame, results: DataFrame) -> DataFrame:
    """Pages that need an engine and that none has read."""
    return routes.filter("page_class = 'needs_ocr'").join(results.select("doc", "page_number"), ["doc", "page_number"], "left_anti")


def filled(routes: DataFrame, results: DataFrame) -> DataFrame:
    """Results for pages that routing answers: blanks are empty, copies take the text of their original."""
    texts = results.filter("text <> ''").groupBy("doc", F.col("page_number").alias("duplicate_of")).agg(F.min_by("text", "engine_ord").alias("original"))
    df = routes.filter("page_class in ('blank', 'duplicate')").join(texts, ["doc", "duplicate_of"], "left")
    blank = F.col("page_class") == "blank"
    return df.select("doc", "page_number", "page_class", F.when(blank, "").otherwise(F.coalesce("original", F.lit(""))).alias("text"), F.lit("success").alias("status"), F.when(blank, 1.0).alias("confidence"))


def processing_location(endpoint: Column) -> Column:
    """``local`` for a loopback host, else ``remote``."""
    host = F.lower(F.regexp_extract(endpoint, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://)?(?:[^/@]*@)?(\[[^\]]*\]|[^/:]+)", 1))
    return F.when(host.isin("localhost", "::1", "[::1]") | host.rlike(r"^127\.[0-9.]+$"), "local").otherwise("remote")


def stub_engine(engine_id: str, edit: Callable[[str], str] = str) -> Engine:
    """A deterministic engine for tests and demonstrations: it returns the page's layer, edited."""
    return Engine(engine_id, engine_id, lambda page: {"text": edit(page.get("embedded_text") or ""), "seconds": 0.0})
