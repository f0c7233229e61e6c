"""Expected values of single operators on small inputs."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import accuracy, align, batch, cascade, chat, compare, confidence, events, fuse, reports, routing
from quire.params import Confidence, Routing, Settings, profile_of, with_profile
from quire.sources import documents as D
from quire.sources import export

A = "Acme Trading Ltd\n12 Harbour Street\nInvoice Number: INV-1024\n| Widget | 2 | 1,325.50 |\n| Gadget | 1 | 85.00 |\nTotal due 38,085.10"
B = "## Acme Trading Ltd\n12 Harbour Street\nInvoice No: INV-1024\n| Widget | 2 | 1,325.60 |\n|  Gadget |  1  | 85.00 |\nTotal due 38,085.10\nBank: First National"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("v")).first()["v"]


def pair(spark, a, b):
    return spark.createDataFrame([(1, a, b)], "doc int, text_a string, text_b string")


@pytest.mark.parametrize(
    ("a", "b", "equal", "changed", "only_a", "only_b"),
    [
        ("alpha\nbeta\ngamma", "alpha\nbeta\ngamma", 3, 0, 0, 0),
        ("alpha\nbeta", "zulu\nxray", 0, 0, 2, 2),
        ("| a | b |", "|  a  | b |", 1, 0, 0, 0),
        ("a\n\n\nb", "a\nb", 2, 0, 0, 0),
        ("one\ntwo\nthree", "one\nextra line\ntwo\nthree", 3, 0, 0, 1),
        ("| Widget | 1,325.50 |", "| Widget | 1,325.60 |", 0, 1, 0, 0),
        ("completely different", "0123456789 9876", 0, 0, 1, 1),
        ("hello", "", 0, 0, 1, 0),
        (None, "x\r\ny z", 0, 0, 0, 2),
    ],
)
def test_diff_counts(spark, a, b, equal, changed, only_a, only_b):
    s = compare.summary(compare.diff_lines(pair(spark, a, b), "doc"), "doc").first()
    assert (s["equal_lines"], s["changed_lines"], s["only_a_lines"], s["only_b_lines"]) == (equal, changed, only_a, only_b)
    assert (s["similarity"] == 1.0) == (changed + only_a + only_b == 0)


def test_invoice_pair(spark):
    rows = compare.diff_lines(pair(spark, A, B), "doc")
    s = compare.summary(rows, "doc").first()["similarity"]
    assert 0 < s < 1
    found = compare.conflicts(rows).collect()
    assert any("1325.60" in r["numbers_b"] for r in found)
    text = fuse.line_vote(pair(spark, A, B), "doc").first()["text"]
    assert ("1,325.50" in text) != ("1,325.60" in text)
    assert "12 Harbour Street" in text and "Bank: First National" in text and text.count("12 Harbour Street") == 1


def test_many_changed_lines_stay_fast():
    import time

    a = [f"row {i} of the table amounts to {i * 37},00 euro" for i in range(800)]
    began = time.time()
    rows = align.diff_rows(a, [x.replace(",00", ",01") for x in a])
    assert [r[0] for r in rows] == ["changed"] * 800 and time.time() - began < 5


def test_repositioned_line_is_kept_once(spark):
    r = fuse.line_vote(pair(spark, "body one\nbody two\nHeader", "Header\nbody one\nbody two"), "doc").first()
    assert sorted(r["text"].split("\n")) == ["Header", "body one", "body two"] and r["repositioned"] == 1
    assert fuse.line_vote(pair(spark, "only", None), "doc").first()["text"] == "only"
    assert fuse.line_vote(pair(spark, "Invoice No: 7 a", "Invoice Number: 7 a"), "doc").first()["text"] == "Invoice Number: 7 a"


@pytest.mark.parametrize(("fused", "ok"), [(A, True), (A.upper(), True), ("a summary of an invoice nobody sent to anyone", False), ("Acme Trading", False), ("  ", False), ("!!", False)])
def test_guard(spark, fused, ok):
    df = spark.createDataFrame([(1, fused, A, B)], "doc int, fused string, text_a string, text_b string")
    assert fuse.guarded(df, "doc").first()["accepted"] is ok


def test_model_fusion_falls_back(spark):
    def call(a, b):
        if a.startswith("boom"):
            raise RuntimeError("model is gone")
        return a if a.startswith("Acme") else "an invented summary of everything"

    df = spark.createDataFrame([(1, A, B), (2, "one line\ntwo lines here", "one line"), (3, "boom text", "boom text")], "doc int, text_a string, text_b string")
    got = {r["doc"]: r for r in fuse.with_model(df, call, "doc").collect()}
    assert got[1]["text"] == A and not got[1]["fallback_used"]
    assert got[2]["text"] == "one line\ntwo lines here" and got[2]["warning"] == "not_contained"
    assert got[3]["text"] == "boom text" and got[3]["warning"] == "model is gone"


def test_numbers(spark):
    found = one(spark, T.numbers("t"), t="Invoice INV-1024 total 38,085.10 on 14/03/2025")
    assert "38085.10" in found and "1024" in found
    assert one(spark, T.numbers("t"), t=None) == []


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("```\nHello\n```", "Hello"), ("Here is the text:\n\nHello", "Hello"), ("Sure, here it is:\n```markdown\nHello\n```", "Hello"), ("Hello\n\nLet me know if you need more.", "Hello"), ("A\n\n\n\n\nB   \n", "A\n\nB"), ("", ""), (None, ""), ("use ```x``` inline", "use ```x``` inline")],
)
def test_clean_output(spark, raw, clean):
    assert one(spark, T.clean_output("t"), t=raw) == clean


def page(spark, *rows):
    return spark.createDataFrame([("d", i + 1, t, ink, img) for i, (t, ink, img) in enumerate(rows)], "doc string, page_number int, embedded_text string, ink double, image string")


GOOD = "The account statement for the period shows the opening balance the deposits and the withdrawals of the quarter together with the closing balance on the last day and a note about the interest"


def test_routes(spark):
    df = page(spark, (GOOD, None, "a"), ("Page 4 of 10", 0.0, "b"), (None, 0.4, "c"), (None, 0.4, "c"), (None, None, "d"), ("�" * 400 + " word" * 40, 0.3, "e"), ("xkcd bcdf " * 24, 0.3, "f"), ("12.50 01/02/2024 " * 18, None, "g"))
    got = {r["page_number"]: r for r in routing.routed(df, image="image").collect()}
    assert [got[i]["page_class"] for i in range(1, 9)] == ["text_layer", "blank", "needs_ocr", "duplicate", "needs_ocr", "needs_ocr", "needs_ocr", "text_layer"]
    assert got[4]["duplicate_of"] == 3 and got[1]["fingerprint"] == ""
    assert "too few" in got[2]["reason"] and "encoding" in got[6]["reason"] and got[7]["quality"] < 0.7
    off = routing.routed(df, image="image", rule=Routing(use_text_layer=False, skip_blank_pages=False, detect_duplicates=False))
    assert {r["page_class"] for r in off.collect()} == {"needs_ocr"}


def test_normal_form_only_where_needed(spark):
    df = spark.createDataFrame([(1, "ﬁve １２"), (2, "plain é"), (3, None)], "i int, t string")
    got = {r["i"]: r["t"] for r in T.with_normal_form(df, "t").collect()}
    assert got == {1: "five 12", 2: "plain é", 3: None}


def test_confidence_flags(spark):
    rows = [("clean words on a page", "success", None, None), ("", "success", None, None), ("x", "failed", None, None), ("some words here", "success", "length", None), ("same line\n" * 40, "success", None, None), ("v\n" * 4, "success", None, None), ("word", "success", None, 0.35), ("## ** %% ^^", "success", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, status string, done_reason string, ink double")
    got = {r["i"]: (r["flags"], round(r["score"], 3)) for r in confidence.scored(df).collect()}
    assert got == {0: ([], 1.0), 1: (["empty"], 0.0), 2: (["empty"], 0.0), 3: (["truncated"], 0.7), 4: (["repetition"], 0.7), 5: ([], 1.0), 6: (["sparse_for_ink"], 0.7), 7: (["not_language"], 0.7)}


def test_cascade_with_stubs(spark):
    routes = routing.routed(page(spark, (GOOD, None, "a"), ("scan one", 0.5, "b"), (None, 0.5, "c"), ("boom", None, "d")), image="image")

    def read(p):
        if p["embedded_text"] == "boom":
            raise RuntimeError("engine fell over")
        return {"text": p["embedded_text"]}

    engines = [cascade.Engine("first", "First", read), cascade.stub_engine("second", lambda t: t + " read again")]
    got = cascade.cascade(routes, engines).collect()
    assert sorted((r["engine_id"], r["page_number"], r["status"]) for r in got) == [("first", 2, "success"), ("first", 3, "failed"), ("first", 4, "failed"), ("second", 2, "success"), ("text_layer", 1, "success")]
    assert next(r["error"] for r in got if r["page_number"] == 4) == "engine fell over"
    off = cascade.cascade(routes, engines, Confidence(fallback_enabled=False))
    assert off.filter("engine_id = 'second'").count() == 0


def test_registry():
    r = cascade.Registry([cascade.stub_engine("a"), cascade.stub_engine("b"), cascade.stub_engine("c")])
    with pytest.raises(ValueError):
        r.register(cascade.stub_engine("a"))
    r.enable_only(["a", "c"])
    assert [e.engine_id for e in r.ordered(["c", "b"])] == ["c", "a"]
    sick = cascade.Engine("d", "D", dict, health=lambda: 1 / 0)
    r.register(sick)
    assert [(h["engine_id"], h["available"]) for h in r.health_report()] == [("a", True), ("c", True), ("d", False)]
    r.unregister("d")
    r.unregister("a")
    assert [d["engine_id"] for d in r.describe()] == ["b", "c"]


def test_accuracy_values(spark):
    text = "Statement of account\nTotal: 2,200.00 (due 10:30)\nBalance 1,325.50"
    df = spark.createDataFrame([(0, text, text), (1, text, ""), (2, text, text.upper().replace(":", "")), (3, text, text.replace("2,200.00", "2,2OO.OO")), (4, "one two three four", "four three two one"), (5, "word " * 6000, "word " * 6000), (6, None, None)], "i int, reference string, hypothesis string")
    got = {r["i"]: r for r in accuracy.scores(df, "i").collect()}
    assert (got[0]["wer"], got[0]["cer"], got[0]["recall"], got[0]["figure_recall"]) == (0, 0, 1, 1)
    assert (got[1]["wer"], got[1]["recall"], got[1]["figure_recall"]) == (1, 0, 0)
    assert got[2]["wer"] < 0.2 and got[3]["figure_recall"] < 1
    assert got[4]["recall"] == 1 and got[4]["wer"] > 0.5
    assert got[5]["cer"] is None and got[5]["wer"] == 0
    assert (got[6]["wer"], got[6]["recall"]) == (0, 1)


def test_reports(spark):
    t = spark.createDataFrame([("e", 100.0), ("e", 0.001), ("e", None)], "k string, seconds double")
    p = reports.percentiles(t, "k").first()
    assert p["measured"] == 2 and p["max"] == 100 and reports.percentiles(t.filter("seconds is null"), "k").count() == 0
    d = spark.createDataFrame([(4, 1, 3, 120.0, None)], "pages int, pages_needing_ocr int, pages_avoided int, seconds double, memory_mb double")
    r = reports.benchmark_totals(d).first()
    assert r["pages_per_minute"] == 2.0 and r["memory_mb"] is None
    f = spark.createDataFrame([(12.34, 3037), (125.0, None), (None, 0)], "s double, n int").select(reports.format_duration(F.col("s")), reports.format_int(F.col("n"))).collect()
    assert [tuple(x) for x in f] == [("12.34s", "3,037"), ("2m 5s", "N/A"), ("N/A", "0")]


def test_batch(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    known = spark.createDataFrame([("a", "completed", 3, 10.0), ("gone", "failed", 0, 1.0)], "source string, state string, pages int, seconds double")
    got = {r["source"]: r["state"] for r in batch.reconciled(files, known).collect()}
    assert got == {"a": "completed", "b": "queued", "c": "queued"}
    names = batch.output_names(spark.createDataFrame([("x/a.pdf",), ("y/a.pdf",), ("z/.hidden",)], "source string"), "json")
    assert {r["source"]: r["output"] for r in names.collect()} == {"x/a.pdf": "a.json", "y/a.pdf": "a_1.json", "z/.hidden": ".hidden.json"}
    assert batch.enough_memory(None, 10) and not batch.enough_memory(5, 10)


def test_resume_processes_new_files_once(spark, tmp_path):
    from quire.streaming.ingest import run_new_files

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF-1.7 x")
    go = lambda: run_new_files(spark, f"{tmp_path}/in", f"{tmp_path}/ck", f"{tmp_path}/out", D.described).awaitTermination()
    go()
    (tmp_path / "in/b.txt").write_bytes(b"hello")
    go()
    go()
    got = {r["filename"]: r["load_error"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(got) == {"a.pdf", "b.txt"} and got["a.pdf"] is None and "not supported" in got["b.txt"]


def test_readers_contain_failures(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 good")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 bad")
    (tmp_path / "c.png").write_bytes(b"\x89PNG\r\n\x1a\n")

    def read(path, content, rule):
        if b"bad" in content:
            raise ValueError("damaged")
        yield {"page_number": 1, "embedded_text": "hello", "width": 10, "height": 20, "dpi": rule.render_dpi}

    D.register_reader("pdf", read)
    got = {r["doc"].rsplit("/", 1)[1]: (r["embedded_text"], r["error"]) for r in D.loaded_pages(D.files(spark, str(tmp_path))).collect()}
    assert got["a.pdf"] == ("hello", None) and "damaged" in got["b.pdf"][1] and "no reader" in got["c.png"][1]


def test_chat(spark):
    context, cut = chat.trimmed("t", 10)
    df = spark.createDataFrame([("a" * 6 + "b" * 50 + "c" * 4,), ("short",), (None,)], "t string").select(context, cut)
    rows = [tuple(r) for r in df.collect()]
    assert rows[0][0].startswith("aaaaaa\n\n[... 50 characters") and rows[0][0].endswith("cccc") and rows[0][1]
    assert rows[1] == ("short", False) and rows[2] == (None, False)
    assert chat.render("{a} {b}", a=1) == "1 {b}" and chat.render("{oops", a=1) == "{oops"
    asked = chat.asked(spark.createDataFrame([(" total? ", "text", "f.pdf", "")], "question string, text string, filename string, history string"), "{filename}: {document} {question}").first()
    both = chat.asked(spark.createDataFrame([("q", "text", "f", ""), ("", "text", "f", ""), ("bad", "text", "f", "")], "question string, text string, filename string, history string"), "{question}")

    def call(prompt):
        if prompt == "bad":
            raise RuntimeError("no model")
        return f" answer to {prompt} "

    got = {r["question"]: (r["answer"], r["error"]) for r in chat.answered(both, call).collect()}
    assert got == {"q": ("answer to q", None), "": (None, "Ask a question about the document."), "bad": (None, "no model")}
    assert asked["error"] is None and asked["prompt"] == "f.pdf: text total?"


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([("d", "d.pdf")], "doc string, filename string")
    engines = spark.createDataFrame([("d", "e", 0, "E", None, "success", None)], "doc string, engine_id string, engine_ord int, engine_name string, model_name string, engine_status string, error string")
    pages = spark.createDataFrame([("d", "e", 1, "success", 'say "hi"\nthere', None, 1.5, 3, None, None)], "doc string, engine_id string, page_number int, status string, text string, error string, seconds double, input_tokens bigint, output_tokens bigint, confidence double")
    fused = spark.createDataFrame([("d", "fin\x01al <b>", "line_vote")], "doc string, text string, strategy string")
    record = export.export_record(docs, engines, pages, fused)
    assert '"model_name":null' in record.first()["json"]
    xml = export.exported(record, "xml").first()["content"]
    assert '<model_name nil="true" />' in xml and "<engine>" in xml and "final &lt;b&gt;" in xml
    assert "fin\x01al &lt;b&gt;" in export.exported(record, "html").first()["content"]
    with pytest.raises(ValueError):
        export.exported(record, "odt")
    export.write_csv(export.csv_rows(engines, pages, fused).drop("doc", "place").coalesce(1), f"{tmp_path}/csv")
    raw = next((tmp_path / "csv").glob("part-*")).read_bytes().decode()
    assert '"say ""hi""\nthere"' in raw and raw.startswith('"engine","model"') and "\r\n" in raw and '"Final (line_vote)"' in raw
    conflicts = spark.createDataFrame([("d", i, "1|2", "1|3") for i in range(30)], "doc string, row_no int, text_a string, text_b string")
    md = export.as_markdown(docs, fused, conflicts).first()["content"]
    assert "(30)" in md and md.count("1\\|2") == 25
    assert "--- Page 1 ---" in export.paginated(pages).first()["content"]
    assert export.as_text(docs.withColumns({"engines": F.lit("E"), "seconds": F.lit(1.5)}), fused).first()["content"].startswith("d.pdf\nEngines: E")


def test_events(spark):
    ticks = iter(map(float, range(10)))
    log = events.RunLog(lambda: next(ticks))
    heard = []
    log.subscribe(heard.append)
    log.add_stage("routing", "Routing")
    log.add_stage("fusion", "Fusion")
    log.start("routing")
    log.finish("routing", detail="done")
    log.skip("fusion", "nothing to fuse")
    got = [(r["key"], r["status"], r["seconds"]) for r in log.stages(spark).orderBy("place").collect()]
    assert got == [("routing", "completed", 1.0), ("fusion", "skipped", None)] and len(heard) == log.events(spark).count() == 3
    assert one(spark, events.text_summary("t", redact=False), t="a b") == "3 characters, 2 words: a b"


def test_settings(tmp_path):
    from quire import config

    s = with_profile(Settings(), "fast")
    assert profile_of(s) == "fast" and profile_of(Settings()) == "balanced" and not s.confidence.fallback_enabled
    config.save(s, str(tmp_path / "s.json"))
    assert config.load(str(tmp_path / "s.json"), {}) == s
    got = config.load(None, {"QUIRE_ROUTING__MIN_WORDS": "7", "QUIRE_ROUTING__ENABLED": "maybe", "QUIRE_NOTHING": "x"})
    assert got.routing.min_words == 7 and got.routing.enabled is True
    assert config.redacted({"api_key": "x", "n": {"password": ""}}) == {"api_key": "***", "n": {"password": ""}}


def test_cli():
    from quire import cli

    args = cli.parser().parse_args(["run", "in.parquet", "--output", "o", "--profile", "accurate", "--fusion", "prefer_longest"])
    s = cli.settings_of(args)
    assert s.fusion == "prefer_longest" and s.documents.render_dpi == 150
    assert cli.main(["profiles"]) == 0 and cli.main(["providers"]) == 0


def test_python_runs_only_on_filtered_rows(spark, sf_dir):
    """Plan shape: the matcher sits above the filter that keeps equal pairs away from it."""
    from quire.plans.fixtures import fixture

    df = compare.diff_lines(fixture(spark, sf_dir, "truth").select("doc_id", F.col("reference").alias("text_a"), F.col("hypothesis").alias("text_b")), "doc_id")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("Filter")
    scan = spark.read.parquet(f"{sf_dir}/documents.parquet")
    layer = routing.assessed(scan.select("source", "text"), "text").groupBy("source").agg(F.avg("quality"))
    assert "lang" not in layer._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1][:120]


def test_error_rates_of_whole_pages(spark, sf_dir):
    from difflib import SequenceMatcher

    from quire.plans import catalogue
    from quire.plans.fixtures import fixture

    def missed(a, b):
        if not a:
            return float(len(b) > 0)
        return max(0.0, 1 - sum(x.size for x in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) / len(a))

    truth = fixture(spark, sf_dir, "truth").select("doc_id", T.fold("reference").alias("r"), T.fold("hypothesis").alias("h"))
    got = {r["doc_id"]: r for r in catalogue.QUERIES["error_rates"](spark, sf_dir).collect()}
    pages = truth.collect()
    assert set(got) == {p["doc_id"] for p in pages} and any(g["wer"] > 0 for g in got.values())
    for p in sorted(pages, key=lambda p: len(p["r"]))[:150]:
        g = got[p["doc_id"]]
        assert g["wer"] == pytest.approx(missed(p["r"], p["h"])) and g["cer"] == pytest.approx(missed(" ".join(p["r"]), " ".join(p["h"])))
    by = {r["source"]: r for r in catalogue.QUERIES["accuracy_report_aligned"](spark, sf_dir).collect()}
    some = next(iter(by))
    mine = [got[r["doc_id"]] for r in fixture(spark, sf_dir, "truth").filter(F.col("source") == some).collect()]
    assert by[some]["pages"] == len(mine) and all(by[some][c] == pytest.approx(sum(g[c] for g in mine if g[c] is not None) / len([g for g in mine if g[c] is not None])) for c in ("wer", "cer"))


def test_long_pages_have_no_character_rate(spark):
    text = "word " * 5_000
    df = spark.createDataFrame([(1, text, text + "x"), (2, text, text), (3, "word", "ward")], "doc_id int, reference string, hypothesis string")
    assert {r["doc_id"]: (r["wer"], r["cer"]) for r in accuracy.error_rates(df, "doc_id").collect()} == {1: (0.0, None), 2: (0.0, None), 3: (1.0, 0.25)}


@pytest.mark.parametrize("small", [0, 400])
def test_matched_size_is_difflibs(monkeypatch, small):
    import random

    monkeypatch.setattr(align, "SMALL", small)
    rng = random.Random(small)
    for n in range(120):
        words = ["".join(rng.choices("abcde", k=rng.randint(1, 5))) for _ in range(rng.choice([2, 5, 90]))]
        a = rng.choices(words, k=rng.randint(1, 150))
        b = [w for x in a for w in rng.choice([[x]] * 9 + [[], [rng.choice(words)], [x, rng.choice(words)]])]
        for x, y in ((a, b), (list(" ".join(a)), list(" ".join(b)))):
            assert align.matched_size(x, y) == align._matched(x, y)
