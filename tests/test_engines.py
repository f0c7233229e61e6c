"""Engines asked once, engines behind HTTP, image pages, reports: cases with known results."""

import json
import struct
import threading
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import backends, batch, cache, cascade, compare, fuse, panels, reports, routing
from quire.params import Documents, Output, Routing
from quire.sources import documents, export


def counting(path, text="a good page of many words that says enough"):
    """An engine's ``read`` that leaves a line in ``path`` for every call."""

    def read(page):
        with open(path, "a") as f:
            f.write(f"{page['doc']} {page['page_number']}\n")
        return {"text": text, "seconds": 1.0}

    return read


def calls(path):
    return path.read_text().splitlines() if path.exists() else []


@pytest.fixture()
def pages(spark):
    long = " ".join(["reasonable words of a page"] * 12)
    rows = [("d", 1, long, 0.2), ("d", 2, "", 0.3), ("d", 3, "x", 0.3), ("e", 1, "y", 0.9), ("e", 2, "", 0.0)]
    return spark.createDataFrame(rows, "doc string, page_number bigint, embedded_text string, ink double")


def test_every_engine_is_asked_once_a_page(spark, pages, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"
    engines = [cascade.Engine("a", "A", counting(first, "## ##")), cascade.Engine("b", "B", counting(second))]
    got = cascade.cascade(routing.routed(pages), engines)
    assert got.count() == 6 and got.filter("engine_id = 'a'").count() == 3
    got.collect()
    assert sorted(calls(first)) == ["d 2", "d 3", "e 1"] and sorted(calls(second)) == ["d 2", "e 1"]


def test_models_are_asked_once_a_pair(spark, tmp_path):
    seen = tmp_path / "asked"

    def call(a, b):
        with open(seen, "a") as f:
            f.write("x\n")
        return a

    pairs = spark.createDataFrame([(i, "one line\ntwo lines", "one line\ntwo lines more") for i in range(10)], "doc int, text_a string, text_b string")
    out = fuse.with_model(pairs, call, "doc")
    assert out.count() == 10 and out.filter("not fallback_used").count() == 10 and len(calls(seen)) == 10


def test_all_engines_stops_when_told(spark, pages, tmp_path):
    def fails(page):
        raise ValueError("no")

    engines = [cascade.Engine("a", "A", fails, retries=0), cascade.Engine("b", "B", counting(tmp_path / "b"))]
    assert {r[0] for r in cascade.all_engines(pages, engines, continue_on_error=False).select("engine_id").distinct().collect()} == {"a"}
    assert not calls(tmp_path / "b")
    assert cascade.all_engines(pages, engines).count() == 10


def test_retries_wait_longer_each_time(spark, pages, tmp_path, monkeypatch):
    path = tmp_path / "tries"

    def fails(page):
        with open(path, "a") as f:
            f.write("try\n")
        error = ValueError("busy")
        error.permanent = page["doc"] == "e"
        raise error

    out = cascade.run_engine(pages.filter("page_number = 1"), cascade.Engine("a", "A", fails, retries=2, wait=0.01), 1).collect()
    assert {r["status"] for r in out} == {"failed"} and {r["error"] for r in out} == {"busy"} and len(calls(path)) == 4


@pytest.mark.parametrize(("text", "done", "error", "expected"), [("", None, None, ("failed", cascade.EMPTY)), ("t", "length", None, ("success", cascade.CUT)), ("t", "stop", None, ("success", None)), (" ", "stop", "why", ("failed", "why")), ("t", "stop", "why", ("failed", "why"))])
def test_page_status(text, done, error, expected):
    assert cascade.page_status(text, done, error) == expected


def test_routing_can_be_off(pages):
    assert routing.routed_or_all(pages, rule=Routing(enabled=False)) is None and routing.routed_or_all(pages).count() == 5


def test_cached_reads(spark, pages, tmp_path):
    path, empty = tmp_path / "reads", spark.createDataFrame([], cache.SCHEMA)
    engine = cascade.Engine("a", "A", counting(path), model="m", options={"prompt": "p"})
    df = pages.withColumn("image", F.concat("doc", F.lit("img"), F.col("page_number").cast("string")).cast("binary"))
    results, after, _ = cache.read_cached(df.filter("doc = 'd'"), empty, engine, 1, now=1.0)
    assert results.count() == 3 and cache.count(after) == 3 and len(calls(path)) == 3
    results, later, stats = cache.read_cached(df, after, engine, 1, now=2.0)
    assert results.count() == 5 and len(calls(path)) == 5 and cache.count(later) == 5
    by = {r["doc"]: r for r in stats.collect()}
    assert (by["d"]["hits"], by["d"]["misses"], by["d"]["seconds_saved"]) == (3, 0, 3.0) and (by["e"]["hits"], by["e"]["misses"]) == (0, 2)
    assert {r["seconds"] for r in results.filter("doc = 'd'").collect()} == {0.0}
    assert {r["engine_status"] for r in cache.rolled_up(results).collect()} == {"success"}
    assert cache.count(cache.cleared(later)) == 0
    other = cascade.Engine("a", "A", counting(path), model="m", options={"prompt": "another"})
    assert cache.read_cached(df.filter("doc = 'd'"), after, other, 1, now=3.0)[0].count() == 3 and len(calls(path)) == 8
    free = cascade.Engine("text_layer", "T", counting(path))
    assert cache.count(cache.read_cached(df, empty, free, 0, now=1.0)[1]) == 0


def test_new_results_of_one_key_are_kept_once(spark):
    new = [("k", 1, "p", "m", t, None, None, 1.0, at, "success") for t, at in (("old", 1.0), ("new", 2.0))]
    results = spark.createDataFrame(new, cache.SCHEMA + ", status string")
    assert [r["text"] for r in cache.stored(spark.createDataFrame([], cache.SCHEMA), results).collect()] == ["new"]


def test_checkpoints_are_whole_or_none(spark, tmp_path):
    path = f"{tmp_path}/state"
    assert batch.load(spark, path) is None
    jobs = spark.createDataFrame([("a", "queued", 1, 0, 0, 1.0, 1, None, None, None)], batch.SCHEMA)
    batch.save(jobs, path)
    batch.save(jobs.withColumn("state", F.lit("completed")), path)
    assert [r["state"] for r in batch.load(spark, path).collect()] == ["completed"] and len(list((tmp_path / "state").iterdir())) == 1
    (tmp_path / "state" / f"{3:020d}").mkdir()  # a save that never ended
    assert [r["state"] for r in batch.load(spark, path).collect()] == ["completed"]
    for f in (tmp_path / "state").rglob("*.parquet"):
        f.write_bytes(b"damaged")
    assert batch.load(spark, path) is None


def test_batches_transcribe(spark, tmp_path, monkeypatch):
    from quire import cli
    from quire.params import Settings

    monkeypatch.setattr(documents, "READERS", {})
    long = " ".join(["reasonable words of a page"] * 12)
    (tmp_path / "good.pdf").write_bytes(b"%PDF-1.7 " + long.encode())
    (tmp_path / "thin.pdf").write_bytes(b"%PDF-1.7 Total")
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.7 bad")

    def read(path, content, rule):
        if content.endswith(b"bad"):
            raise ValueError("damaged")
        yield {"page_number": 1, "embedded_text": content[9:].decode()}

    documents.register_reader("pdf", read)
    (tmp_path / "white.png").write_bytes(png(np.full((50, 40, 1), 255, np.uint8)))
    found = documents.files(spark, str(tmp_path))
    got = {r["doc"].rsplit("/", 1)[-1]: r for r in cli.batch_documents(found, Settings()).collect()}
    assert {k: r["state"] for k, r in got.items()} == {"good.pdf": "completed", "thin.pdf": "completed", "bad.pdf": "failed", "white.png": "completed"}
    assert got["white.png"]["pages"] == 0  # blank: no engine has anything to read
    assert (got["good.pdf"]["text"], got["good.pdf"]["pages"], got["good.pdf"]["pages_via_model"]) == (long, 1, 0)
    assert (got["thin.pdf"]["text"], got["thin.pdf"]["pages_via_model"]) == ("Total", 1)
    assert "damaged" in got["bad.pdf"]["error"] and got["bad.pdf"]["pages"] == 0


def test_modes_choose_how_texts_are_fused(spark, pages):
    from quire import cli
    from quire.params import Settings

    routes, results, texts = cli.transcribed(pages, Settings(), "all_engines")
    assert routes is None and results.select("engine_id").distinct().count() == 4
    assert {r["doc"] for r in texts.collect()} == {"d", "e"}
    routes, results, texts = cli.transcribed(pages, Settings())
    assert routes is not None and results.filter("engine_id = 'text_layer'").count() == 1 and texts.count() == 2


def test_documents_of_a_benchmark(spark):
    docs = spark.createDataFrame([("a", None), ("b", "damaged")], "doc string, load_error string")
    routes = spark.createDataFrame([("a", "needs_ocr"), ("a", "blank")], "doc string, page_class string")
    results = spark.createDataFrame([("a", 2.5)], "doc string, seconds double")
    got = {r["doc"]: r.asDict() for r in reports.document_benchmark(docs, routes, results, spark.createDataFrame([("a", "x y")], "doc string, text string")).collect()}
    assert got["a"] == {"doc": "a", "error": None, "pages": 2, "pages_needing_ocr": 1, "seconds": 2.5, "final_words": 2, "pages_avoided": 1}
    assert got["b"]["error"] == "could not be loaded: damaged" and got["b"]["pages"] == 0


# --- over HTTP --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def _send(self, code, body):
            data = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            if self.path == "/v1/models":
                self._send(401, {}) if self.headers.get("Authorization") == "Bearer bad" else self._send(200, {"data": [{"id": "reader"}]})
            else:
                self._send(200, {"models": [{"name": "small:latest"}, {"name": ""}]})

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/api/generate":
                if asked["model"] == "gone":
                    return self._send(404, {})
                if asked["model"] == "odd":
                    return self._send(200, b"<html>")
                return self._send(200, {"response": "said " + asked["prompt"], "eval_count": 30, "prompt_eval_count": 7, "eval_duration": 2_000_000_000, "load_duration": 0, "done_reason": "length"})
            said = asked["messages"][0]["content"]
            if asked["model"] == "broken":
                return self._send(503, b"later")
            if asked["model"] == "shapeless":
                return self._send(200, {"choices": []})
            return self._send(200, {"choices": [{"message": {"content": said[1]["text"] + " " + said[0]["image_url"]["url"][:22]}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 5, "completion_tokens": 6}})

    found = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}"
    found.shutdown()


def test_page_server(spark, server):
    reader = backends.PageServer(f"{server}/v1", "reader")
    df = spark.createDataFrame([("d", 1, bytearray(b"png"))], "doc string, page_number bigint, image binary")
    (row,) = cascade.run_engine(df, reader.engine("h", "H", "local"), 1).collect()
    assert row["text"] == "Transcribe this page. data:image/png;base64," and (row["input_tokens"], row["output_tokens"], row["status"]) == (5, 6, "success")
    assert reader.health()[0] and not backends.PageServer(f"{server}/v1", "other").health()[0]
    assert backends.PageServer(f"{server}/v1", "reader", key="bad").health()[2] == "check the key"
    with pytest.raises(backends.Busy):
        backends.PageServer(f"{server}/v1", "broken").read({"image": b""})
    with pytest.raises(backends.Refused) as refused:
        backends.PageServer(f"{server}/v1", "shapeless").read({"image": b""})
    assert refused.value.permanent
    available, said, remedy = backends.PageServer("http://127.0.0.1:9", "reader").health()
    assert not available and "nothing answers" in said and remedy


def test_model_server(server):
    s = backends.ModelServer(server)
    got = s.generate("small", "hello", max_tokens=9)
    assert got.text == "said hello" and got.truncated and got.inference_seconds == 2.0 and got.load_seconds is None and got.total_seconds is None and got.tokens_per_second == 15
    assert s.has_model("small") and not s.has_model("small:big")
    with pytest.raises(backends.ModelMissing):
        s.generate("gone", "x")
    with pytest.raises(backends.Refused):
        s.generate("odd", "x")
    assert [backends.seconds_of(x) for x in (None, "3", 0, -1, True, 5e8)] == [None, None, None, None, None, 0.5]


def test_model_server_as_an_engine(spark, server):
    engine = backends.ModelServer(server).engine("o", "O", "small", prompt="read")
    df = spark.createDataFrame([("d", 1, bytearray(b"png"))], "doc string, page_number bigint, image binary")
    (row,) = cascade.run_engine(df, engine, 1).collect()
    assert row["text"] == "said read" and row["error"] == cascade.CUT and row["status"] == "success" and row["seconds"] is None and row["output_tokens"] == 30
    assert engine.health()[0] and backends.ModelServer(server).engine("o", "O", "big").health()[2] == "pull big"


def test_commands_as_engines(spark):
    df = spark.createDataFrame([("d", 1, bytearray(b"page text"))], "doc string, page_number bigint, image binary")
    (row,) = cascade.run_engine(df, backends.CommandReader(("cat",)).engine("c", "C"), 1).collect()
    assert row["text"] == "page text" and row["seconds"] > 0 and backends.CommandReader(("cat",)).health()[0]
    (row,) = cascade.run_engine(df, backends.CommandReader(("false",)).engine("c", "C"), 1).collect()
    assert row["status"] == "failed" and "ended with 1" in row["error"]
    with pytest.raises(backends.TimedOut):
        backends.CommandReader(("sleep", "9"), timeout=0.05).read({"image": b""})
    assert not backends.CommandReader(("no-such-program",)).health()[0]
    with pytest.raises(backends.Refused):
        backends.CommandReader(("no-such-program",)).read({"image": b""})


# --- images -----------------------------------------------------------------------------------------


def png(pixels):
    height, width, channels = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def saved(folder, data):
    other = folder.parent / f"{folder.name}-again"
    other.mkdir()
    (other / "page.png").write_bytes(bytes(data))
    return str(other)


def test_image_pages(spark, tmp_path):
    page = np.full((300, 400, 3), 255, np.uint8)
    page[:150, :200] = (10, 20, 30)
    (tmp_path / "quarter.png").write_bytes(png(page))
    (tmp_path / "white.png").write_bytes(png(np.full((50, 40, 1), 255, np.uint8)))
    clear = np.zeros((60, 60, 4), np.uint8)
    (tmp_path / "clear.png").write_bytes(png(clear))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing")
    got = {r["doc"].rsplit("/", 1)[-1]: r for r in documents.image_pages(spark, str(tmp_path), Documents(max_dimension=200)).collect()}
    q = got["quarter.png"]
    assert (q["width"], q["height"]) == (200, 150) and abs(q["ink"] - 0.25) < 0.01 and spark.read.format("image").load(saved(tmp_path, q["image"])).select("image.width").first()[0] == 200
    assert got["white.png"]["ink"] == 0.0 and got["clear.png"]["ink"] == 0.0
    assert got["broken.png"]["ink"] is None and got["broken.png"]["error"] == documents.ERROR_TEXTS["corrupt"]
    routes = {r["doc"].rsplit("/", 1)[-1]: r["page_class"] for r in routing.routed(documents.image_pages(spark, str(tmp_path)), image="image").collect()}
    assert routes == {"quarter.png": "needs_ocr", "white.png": "blank", "clear.png": "blank", "broken.png": "needs_ocr"}


def test_scaling_keeps_means_and_sizes():
    x = np.arange(64, dtype=np.uint8).reshape(8, 8, 1) * 4
    assert np.array_equal(documents.scaled(x, 8, 8), x)
    half = documents.scaled(x, 4, 4)
    assert half.shape == (4, 4, 1) and abs(float(half.mean()) - float(x.mean())) < 2
    assert documents.ink_of(np.zeros((0, 0, 3), np.uint8)) is None and documents.ink_of(np.zeros((5, 500, 3), np.uint8)) == 1.0


# --- PDF files --------------------------------------------------------------------------------------


def pdf_file(objects, extra=b""):
    out = b"%PDF-1.5\n%\xe2\xe3\n"
    for n, body in objects.items():
        out += b"%d 0 obj\n" % n + (body if isinstance(body, bytes) else body.encode("latin-1")) + b"\nendobj\n"
    return out + extra + b"trailer << /Root 1 0 R >>\n%%EOF"


def stream(data, head=b""):
    return b"<< /Length %d %s >>\nstream\n" % (len(data), head) + data + b"\nendstream"


def simple_pdf():
    text = b"BT /F1 12 Tf 72 700 Td (First \\(line\\)) Tj 0 -14 Td [(Sec) -20 (ond) -400 (line)] TJ T* ET q 1 0 0 1 0 -50 cm BT /F2 10 Tf 1 0 0 1 72 650 Tm <00410042> Tj ET Q"
    cmap = b"begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0041> <03b1> endbfchar 1 beginbfrange <0042> <0043> <03b2> endbfrange"
    return pdf_file({
        1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 595 842] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>",
        3: "<< /Type /Page /Parent 2 0 R /Contents 7 0 R >>", 4: "<< /Type /Page /Parent 2 0 R /Rotate 90 /MediaBox [0 0 100 200] >>",
        5: "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Differences [65 /eacute /uni20AC] >> >>", 6: "<< /Type /Font /Subtype /Type0 /ToUnicode 8 0 R >>",
        7: stream(zlib.compress(text), b"/Filter /FlateDecode"), 8: stream(cmap),
    })


def test_pdf_text_layers_and_sizes():
    from quire.sources import pdf

    first, second = pdf.read_pages("a.pdf", simple_pdf(), Documents(render_dpi=144))
    assert first["embedded_text"] == "First (line)\nSecond line\nαβ" and (first["width"], first["height"], first["dpi"]) == (1190, 1684, 144)
    assert second["embedded_text"] == "" and (second["width"], second["height"]) == (400, 200) and second["page_number"] == 2
    assert len(list(pdf.read_pages("a.pdf", simple_pdf(), Documents(max_pages=1)))) == 1


def test_pdf_objects_in_streams_forms_and_odd_filters():
    from quire.sources import pdf

    packed = b"2 0 3 60 " .ljust(20) + b"<< /Type /Pages /Kids [3 0 R] /MediaBox [0 0 72 72] >>".ljust(60) + b"<< /Type /Page /Contents [9 0 R] /Resources << /XObject << /X 10 0 R >> >> >>"
    predicted = b"".join(b"\x02" + bytes((a - b) & 255 for a, b in zip(packed[i : i + 10].ljust(10), packed[i - 10 : i] if i else bytes(10), strict=True)) for i in range(0, len(packed), 10))
    form = b"BT /F 9 Tf (In a form) ' ET BI /W 1 ID \x00(\xff EI"
    data = pdf_file({
        1: "<< /Type /Catalog /Pages 2 0 R >>", 8: stream(zlib.compress(predicted), b"/Type /ObjStm /N 2 /First 20 /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 10 >>"),
        9: stream(b"/X Do".hex().encode() + b">", b"/Filter /ASCIIHexDecode"), 10: stream(form, b"/Type /XObject /Subtype /Form /Resources << /Font << /F 11 0 R >> >>"), 11: "<< /Type /Font /Subtype /Type1 >>",
    })
    (page,) = pdf.read_pages("a.pdf", data)
    assert page["embedded_text"] == "In a form"
    assert [pdf._letter(x) for x in ("a", "eacute", "Udieresis", "seven", "comma", "uni00E9", "fi", "nothing")] == ["a", "é", "Ü", "7", ",", "é", "fi", ""]


@pytest.mark.parametrize("data", [b"no pdf", b"%PDF-1.4 nothing", pdf_file({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [2 0 R] >>"}), simple_pdf().replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"), pdf_file({1: "[" * 5000})])
def test_pdf_files_that_cannot_be_read(data):
    from quire.sources import pdf

    with pytest.raises(pdf.PdfError):
        list(pdf.read_pages("a.pdf", data))


def test_reports_as_pdf_are_read_again(record):
    from quire.sources import pdf

    found = export.exported(record(), "pdf").first()["content"]
    text = "\n".join(p["embedded_text"] for p in pdf.read_pages("r.pdf", bytes(found)))
    assert "# Result - d & co.pdf" in text and "page 1 | text" in text


def test_folders_of_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(simple_pdf())
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 nothing")
    got = {(r["doc"].rsplit("/", 1)[-1], r["page_number"]): r for r in documents.loaded_pages(documents.files(spark, str(tmp_path))).collect()}
    assert got["a.pdf", 1]["embedded_text"].startswith("First") and got["a.pdf", 2]["error"] is None and "no catalogue" in got["b.pdf", None]["error"]


# --- panels, reports, exports -----------------------------------------------------------------------


def test_panels(spark):
    rows = spark.createDataFrame([("d", 0, "equal", "a", "a", 1.0), ("d", 1, "changed", "sum 12", "sum 13", 0.8), ("d", 2, "only_a", "z", "", 0.0), ("e", 0, "changed", "1", "2", 0.6)], "doc string, row_no bigint, kind string, text_a string, text_b string, similarity double")
    found = compare.conflicts(rows)
    view = {(r["doc"], r["row_no"]): (r["style"], r["total"]) for r in panels.diff_view(rows, found, "doc", limit=2).collect()}
    assert view == {("d", 0): ("", 3), ("d", 1): ("numeric", 3), ("e", 0): ("numeric", 1)}
    assert [(r["doc"], r["row_no"]) for r in panels.shown_conflicts(rows, found, "doc").collect()] == [("d", 1)]


def test_counters(spark):
    pairs = spark.createDataFrame([(1, "one two\nthree", "one two\nfour five six"), (2, "", "x"), (3, None, None)], "k int, text_a string, text_b string")
    got = {r["k"]: r for r in compare.counters(pairs, "k").collect()}
    assert (got[1]["characters_a"], got[1]["words_b"], got[1]["equal_lines"]) == (13, 5, 1)
    assert got[2]["agreement_percent"] == 0.0 and got[2]["only_b_lines"] == 1 and got[3]["total_lines"] == 0


def test_run_totals_leave_out_what_is_off(spark):
    runs = spark.createDataFrame([("d", 90.0, 3, 30.0, 1, 2, None, None, 7, 1234, 12, 87.25)], "doc string, seconds double, pages bigint, average_seconds double, engines_succeeded bigint, engines_run bigint, total_tokens bigint, input_tokens bigint, output_tokens bigint, final_characters bigint, final_words bigint, agreement_percent double")
    got = {r["label"]: r["value"] for r in reports.total_metrics(runs).collect()}
    assert got["Total time"] == "1m 30s" and got["OCR engines"] == "1 of 2 succeeded" and got["Total tokens"] == "N/A" and got["Characters"] == "1,234" and got["Engine agreement"] == "87.3%"
    assert "Words" not in {r["label"] for r in reports.total_metrics(runs, Output(word_count=False)).collect()}


@pytest.fixture()
def record(spark):
    docs = spark.createDataFrame([("d", "d & co.pdf", 2)], "doc string, filename string, pages int")
    engines = spark.createDataFrame([("d", "e", 0, "E", "m", "success", None), ("d", "f", 1, "F", None, "failed", "no <answer>")], "doc string, engine_id string, engine_ord int, engine_name string, model_name string, engine_status string, error string")
    pages = spark.createDataFrame([("d", "e", i, "success", f"page {i} | text", None, 1.5, 3, 6, None) for i in (2, 1)], "doc string, engine_id string, page_number int, status string, text string, error string, seconds double, input_tokens bigint, output_tokens bigint, confidence double")
    fused = spark.createDataFrame([("d", "final <b>", "line_vote")], "doc string, text string, strategy string")
    compared = spark.createDataFrame([("d", "E", "F", 81.5, 4, 3, 1)], "doc string, engine_a string, engine_b string, agreement_percent double, total_lines int, equal_lines int, differing_lines int")
    found = spark.createDataFrame([("d", i, f"sum {i}|", "sum 9") for i in range(30)], "doc string, row_no int, text_a string, text_b string")
    metrics = spark.createDataFrame([("d", 4.25)], "doc string, seconds double")
    logs = spark.createDataFrame([("d", 0, "[10:00:00] began")], "doc string, place int, line string")
    return lambda show=Output(): export.export_record(docs, engines, pages, fused, show, comparison=compared, conflicts=found, metrics=metrics, logs=logs, generated_at="2024-01-01 00:00:00")


def test_records_follow_the_settings(record):
    d = json.loads(record().first()["json"])
    assert [p["page"] for p in d["engines"][0]["pages"]] == [1, 2] and d["engines"][0]["text"] == "page 1 | text\n\npage 2 | text" and d["engines"][0]["input_tokens"] == 6
    assert d["comparison"]["agreement_percent"] == 81.5 and len(d["numeric_conflicts"]) == 30 and d["logs"] and d["routing"] is None and d["final_result"]["word_count"] == 2
    d = json.loads(record(Output(raw_results=False, comparison=False, logs=False)).first()["json"])
    assert "text" not in d["engines"][0] and "pages" not in d["engines"][0] and d["comparison"] is None and d["logs"] == []


def test_reports_in_all_formats(record):
    md = export.exported(record(), "md").first()["content"]
    assert md.startswith("# Result - d & co.pdf\n") and "- **Total time:** 4.25s" in md and "### Numeric disagreements (30)" in md and md.count("| sum 9 |") == 25 and "| sum 0\\| | sum 9 |" in md
    assert "- **Tokens:** in 6, out 12, total 18" in md and "_Failed: no <answer>_" in md and "```\n[10:00:00] began\n```" in md and "final <b>" in md
    html = export.exported(record(), "html").first()["content"]
    assert "<h1>d &amp; co.pdf</h1>" in html and "final &lt;b&gt;" in html and "no &lt;answer&gt;" in html and html.count("<td>sum ") == 50 and "http" not in html
    pdf = bytes(export.exported(record(), "pdf").first()["content"])
    assert pdf.startswith(b"%PDF-1.4") and pdf.endswith(b"%%EOF\n") and b"d & co.pdf" in pdf and pdf[int(pdf.split(b"startxref\n")[1].split()[0]) :].startswith(b"xref")
    short = export.exported(record(), "md", Output(extracted_text=False, raw_results=False, engine_name=False, logs=False)).first()["content"]
    assert "Final result" not in short and "Engine outputs" not in short and "Engines" not in short
    with pytest.raises(ValueError, match="docx"):
        export.exported(record(), "docx")
