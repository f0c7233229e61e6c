"""Tokenisation, language, quality, mixing, archives, pseudonyms and the pipeline on small inputs."""

import datetime
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from quire.llm import bpe, langid, mixing, pii, quality, queries, token_counts, warc
from quire.llm.common import release, trim_driver
from tests.conftest import duck_rows, rows_of

JSON = queries.vocabulary()
PIECES = ["a", "b ", "é", "é", " \n", "'s", "<|endoftext|>", "12", "ẞ", "İ", "Σ", "!!", "the ", "ing", "́", "\x1c", "\x85", "\xa0", "½", "😀", "​", "_", "\x00", "日本", "'RE", "<|", "  a b c ", "　"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def test_bpe_matches_the_library(spark, library):
    texts = [*odd_texts(600), None, "", "  ", "x" * 5000, "word " * 3000, "***" * 400]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id int, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.encode_documents(df, JSON, lexicon_size=200).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == " ".join(map(str, ids)) and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    again = bpe.decode_documents(spark.createDataFrame([(1, got[3]["ids"]), (2, None)], "i int, ids string"), JSON).collect()
    assert [r["decoded"] for r in again] == [got[3]["decoded"], None]
    assert bpe.encode_documents(df.limit(0), JSON).count() == 0


def test_transducer_is_exact_and_shares_suffixes(tmp_path):
    def mapped(entries):
        (tmp_path / "lexicon").write_bytes(bpe.compile_lexicon(entries))
        return bpe.Lexicon(str(tmp_path / "lexicon"))

    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))).encode(): [rng.randint(1, 5) for _ in range(rng.randint(1, 4))] for _ in range(800)}
    lexicon = mapped(words.items())
    assert all(lexicon.get(w) == ids for w, ids in words.items())
    assert all(lexicon.get(w) is None for w in (b"abcabcabcabc", b"x", b"") if w not in words)
    shared = bpe.compile_lexicon([(p + b"ening", [7]) for p in (b"op", b"happ", b"list")])
    apart = bpe.compile_lexicon([(p + s, [7]) for p, s in ((b"op", b"abcde"), (b"happ", b"fghij"), (b"list", b"klmno"))])
    assert len(shared) < len(apart)
    assert mapped([]).get(b"a") is None


def test_merges_short_and_long_agree():
    rule = bpe.Merges(JSON)
    rng = random.Random(4)
    for _ in range(200):
        ids = [rule.vocab[rng.choice("abcdeinorst")] for _ in range(rng.randint(1, 60))]
        assert rule._merge_short(list(ids)) == rule._merge_long(list(ids))
    pieces = ["".join(rng.choice("abcdeinorsté日!") for _ in range(rng.choice([1, 3, 9, 30, 200]))) for _ in range(200)]
    ids, sizes = rule.merge_many([p.encode() for p in pieces])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [rule.merge(p) for p in pieces]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_splicing_equals_whole_encoding(name):
    path = queries.vocabulary(name)
    if name.endswith(".json"):
        encode, stable, counter = token_counts.json_encoder(path), token_counts.json_boundaries(path), token_counts.JsonCounter(path)
    else:
        encode, stable, counter = token_counts.model_encoder(path), token_counts.model_boundaries(path), None
    for t in [*odd_texts(300, 2), "a b c d e f g " * 40, "no-space" * 100]:
        whole = encode(t)[0]
        if counter:
            assert counter.counts(pa.array([t], pa.string())).tolist() == [len(whole)]
        for chunk, overlap in ((10, 3), (40, 12)):
            assert [i for part in token_counts.spliced(t, encode, stable, chunk, overlap) for i in part] == whole


@pytest.mark.parametrize(("name", "texts"), [("word_bpe_49k.json", ["слово дело ", "日本語学校に行く。今天天气很好，", "0123456789", "some words "]), ("byte_bpe_50k.json", ["слово дело ", "日本語学校に行く。", "some words "]), ("piece_bpe_32k.model", ["слово дело ", "some words "])])
def test_huge_texts_of_any_script_are_encoded_once_and_in_chunks(name, texts):
    path = queries.vocabulary(name)
    of = (token_counts.json_encoder, token_counts.json_boundaries) if name.endswith(".json") else (token_counts.model_encoder, token_counts.model_boundaries)
    encode, stable = (f(path) for f in of)
    for t in texts:
        t, calls = t * (200_000 // len(t)), []

        def counted(x, calls=calls):
            calls.append(len(x))
            return encode(x)

        assert [i for part in token_counts.spliced(t, counted, stable) for i in part] == encode(t)[0]
        assert sum(calls) < 1.2 * len(t) and max(calls) < 1.1 * token_counts.CHUNK_CHARS


def test_token_counts(spark, library):
    texts = ["a b", None, "", "é" * 10, "word " * 30_000, "word " * 2048, "word " * 2049]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(df, JSON, chunk_chars=5000).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048)
    import sentencepiece

    model = queries.vocabulary(queries.PIECES)
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert [r["n_tokens"] for r in token_counts.count_tokens(df.filter("doc_id < 4"), model).orderBy("doc_id").collect()] == [len(sp.encode(t or "")) for t in texts[:4]]


# --- language and quality ---------------------------------------------------------------------------


def held(doc_id, folds, part):
    return zlib.crc32(str(doc_id).encode()) % folds == part


def test_sums_over_segmentations():
    pieces = {"a": 0.1, "b": 0.05, "ab": 0.2, "ba": 0.03, "▁a": 0.04, "abc": 0.01}
    model = langid.Pieces({p: (v, v / 2) for p, v in pieces.items()}, ["x", "y"])

    def segmentations(w):
        if not w:
            yield []
        for k in range(1, len(w) + 1):
            if w[:k] in pieces or k == 1:
                for rest in segmentations(w[k:]):
                    yield [w[:k], *rest]

    words = ["▁ab", "▁abcab", "▁b", "▁zab"]
    runs = langid.Runs("\n".join(w[1:] for w in words).encode())
    assert runs.words() == words
    got = np.exp(model.likelihoods(runs))
    expected = [[sum(np.prod([pieces.get(p, langid.UNKNOWN * (1 + k)) / (1 + k) for p in s]) for s in segmentations(w)) for k in (0, 1)] for w in words]
    assert np.allclose(got, expected)
    counts = dict(zip(model.pieces, model.expected(words[:1], np.array([1.0]), 0), strict=True))
    each = [(s, np.prod([pieces.get(p, langid.UNKNOWN) for p in s])) for s in segmentations(words[0])]
    assert np.isclose(counts["ab"], sum(v for s, v in each if "ab" in s) / sum(v for _, v in each))


def test_words_of_any_length_and_script_are_one_run():
    assert langid.words_of("Straße, 12 नमस्ते e\u0301te\u0301 日本語") == ["▁straße", "▁नमस्ते", "▁e\u0301te\u0301", "▁日本語"]
    long = "ab" * 5000
    assert langid.words_of(long) == ["▁" + long]
    model = langid.Pieces({"ab": (0.5, 0.25), "▁": (0.5, 0.5)}, ["x", "y"])
    got = model.likelihoods(langid.Runs(long.encode()))[0]
    # the only likely segmentation is all pairs
    assert np.allclose(got, [np.log(0.5) + 5000 * np.log(0.5), np.log(0.5) + 5000 * np.log(0.25)])


def test_language_held_out_accuracy(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op9_langid(spark, d).collect() if r["held_out"]]
    assert all(held(r["doc_id"], 4, 2) for r in rows) and len(rows) > 100
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in rows) / len(rows) >= 0.98


def test_language_scores_equal_a_plain_forward_algorithm(spark):
    model = queries.vocabulary(queries.PIECES)
    train = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate([("en", "the house and the garden are green " * 20), ("de", "das haus und der garten sind groß " * 20)] * 5)], "doc_id long, lang string, text string")
    pieces = langid.fit(train, model)
    prob = dict(zip(pieces.pieces, pieces.table, strict=False))

    def word(w, k):
        f = [1.0] + [0.0] * len(w)
        for j in range(1, len(w) + 1):
            f[j] = sum(f[i] * prob[w[i:j]][k] for i in range(j) if w[i:j] in prob) + (0 if w[j - 1] in prob else f[j - 1] * langid.UNKNOWN)
        return np.log(f[-1])

    texts = ["The house", "der Garten, groß!", "xyz 日本 house", "garden " * 50, "éa"]
    langs, scores = langid.Scorer(pieces).scores(pa.array(texts))
    for t, lang, score in zip(texts, langs.to_pylist(), scores.to_pylist(), strict=True):
        words = ["▁" + w.lower() for w in regex.findall(r"\p{L}+", t)]
        z = np.array([sum(word(w, k) for w in words) for k in range(len(pieces.langs))]) * min(1, langid.FULL_WORDS / len(words))
        assert lang == pieces.langs[z.argmax()] and abs(score - 1 / np.exp(z - z.max()).sum()) < 1e-4


def test_languages_beside_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the house", "a", "b")], "doc_id long, text string, __lang string, __SCORE string")
    train = spark.createDataFrame([(1, "en", "the house")], "doc_id long, lang string, text string")
    out = langid.accepted(docs, train, queries.vocabulary(queries.PIECES))
    assert out.columns == docs.columns and out.collect() == docs.collect()


def test_votes_equal_a_plain_vote():
    rng = np.random.default_rng(5)
    rows, labels = rng.random((300, quality.FEATURES)) * (rng.random((300, quality.FEATURES)) < 0.05), rng.integers(0, 2, 300)
    rows[10] = rows[20]  # a tie
    voters = quality.Voters(np.arange(300), rows, labels)
    asked = np.concatenate([rows[:30] + rng.random((30, quality.FEATURES)) * 0.02, np.zeros((1, quality.FEATURES))])
    for x, got in zip(asked, voters.scores(asked), strict=True):
        v = x @ voters.axes
        n = np.linalg.norm(v)
        sims = [round(float(v @ u / n), 9) if n > 1e-12 else 0.0 for u in voters.latent]
        best = sorted(range(300), key=lambda i: (-sims[i], i))[: quality.NEIGHBOURS]
        w = [max(0.0, sims[i]) ** 8 for i in best]
        plain = sum(a * labels[i] for a, i in zip(w, best, strict=True)) / sum(w) if sum(w) > 1e-12 else labels.mean()
        assert abs(got - plain) < 1e-6


def test_shapes_read_whole_words():
    assert quality.shape("a" * 64 + "!!!###") != quality.shape("a" * 64)
    f = quality.Features()
    assert not np.array_equal(f.vector("a" * 70 + "!!!"), f.vector("a" * 70 + "###")) and np.array_equal(f.vector("b" * 90), f.vector("b" * 90))


def test_language_edges(spark):
    model = queries.vocabulary(queries.PIECES)
    train = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate([("en", "the house and the garden " * 20), ("de", "das haus und der garten " * 20), (None, "x"), ("fr", None)] * 5)], "doc_id long, lang string, text string")
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 !! 34", "a"), (4, "THE HOUSE", "a"), (5, "der garten", "a"), (6, "x" * 100_000, "a"), (7, "der garten", "b")], "doc_id long, text string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, train, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "en" and got[5][0] == "de" and got[5] == got[7] and 0 <= got[6][1] <= 1
    kept = langid.accepted(docs, train, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 5, 6, 7]
    assert {r["lang_pred"] for r in langid.identify(docs, train.limit(0), model).collect()} == {"und"}
    assert langid.identify(docs.limit(0), train, model).count() == 0


def test_quality_held_out_accuracy(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in queries.op6_quality(spark, d).collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(held(r["doc_id"], 5, 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert sum(truth[r["doc_id"]] == r["predicted"] for r in rows) / len(rows) >= 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "good words in a row here", 1), (2, "B!! A!! D!! T!! X!!", 1), (3, None, 1), (4, "", 1), (5, "word " * 50_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (9, 1), (None, 1), (3, None)], "doc_id long, quality int")
    known = quality.labelled_sample(docs, labels, "quality")
    assert {(r["doc_id"], r["label"]) for r in known.collect()} == {(1, 1), (2, 0)}
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, known).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4] == 0.5
    assert {r["score"] for r in quality.score_quality(docs, known.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), known).count() == 0


# --- mixing -----------------------------------------------------------------------------------------


def filled(sizes, cap=3):
    w, full = [1 + i % 3 for i in range(len(sizes))], set()
    while True:
        rest = sum(sizes) - sum(cap * sizes[i] for i in full)
        open_w = sum(w[i] for i in range(len(w)) if i not in full)
        t = [cap * s if i in full else rest * w[i] / open_w for i, s in enumerate(sizes)]
        more = {i for i in range(len(sizes)) if t[i] > cap * sizes[i] and i not in full}
        if not more:
            return t
        full |= more


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = []
    for source, n, long in (("a", 30, 50), ("B", 3, 4), (None, 10, 80), ("é", 20, 200), ("huge", 5, 3000), ("none", 4, 0), ("", 6, 30)):
        rows += [(len(rows) + i, source, " ".join(["w"] * int(rng.integers(0, long + 1))) if long else None, 7) for i in range(n)]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, target int")
    got = mixing.mix(df, bucket_rows=8).toPandas()
    assert len(got) == len(rows) and ((got.taken >= 0) & (got.taken <= 3 * got["size"])).all()
    order = sorted({r[1] for r in rows if r[1] is not None}) + [None]
    sizes = [sum(len((r[2] or "").split()) for r in rows if r[1] == s) for s in order]
    for s, size, target in zip(order, sizes, filled(sizes), strict=True):
        part = got[got.source.isna() if s is None else got.source == s]
        assert (part.source_size == size).all() and np.allclose(part.target, target)
        assert abs(part.taken.sum() - target) <= 0.5
    again = mixing.mix(df.repartition(7), bucket_rows=8).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))
    assert mixing.mix(df.limit(0)).count() == 0
    copies = mixing.mixed_documents(df.limit(20))
    assert copies.columns == df.columns


def plain_mix(rows, hashes, bits, weights=(1, 2, 3), cap=3):
    """{row number: words taken}: documents laid end to end and read to the target."""
    named = sorted({r[1] for r in rows if r[1] is not None}) + ([None] if any(r[1] is None for r in rows) else [])
    sizes = [len((r[2] or "").split()) for r in rows]
    size = {x: sum(n for r, n in zip(rows, sizes, strict=True) if r[1] == x) for x in named}
    weight = {x: weights[i % len(weights)] for i, x in enumerate(named)}
    target, free, left = {}, [x for x in named if size[x]], sum(sizes)
    while free:
        level = left / sum(weight[x] for x in free)
        over = [x for x in free if level * weight[x] > cap * size[x]]
        if not over:
            target |= {x: level * weight[x] for x in free}
            break
        target |= {x: cap * size[x] for x in over}
        left, free = left - sum(cap * size[x] for x in over), [x for x in free if x not in over]
    # a source's documents, end to end, are read round and round until its target is met
    share = {x: min(cap * size[x], int(target[x] + 0.5)) for x in named if size[x]}
    taken, at = {}, {x: 0 for x in named}
    for i in sorted(range(len(rows)), key=lambda i: ((hashes[i] % 2**64) >> (64 - bits) if bits else 0, hashes[i], rows[i][0], sizes[i])):
        x, n = rows[i][1], sizes[i]
        taken[i] = sum(at[x] <= p % size[x] < at[x] + n for p in range(share[x])) if n else 0
        at[x] += n
    return taken


@pytest.mark.parametrize("bucket_rows", [4, 1000])
def test_mixing_equals_a_plain_schedule(spark, bucket_rows):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", "b", "c", "d", None]), rng.choice([None, "", "w " * rng.randint(1, 60)])) for i in range(120)]
    rows += [(None, "b", f"null {i} id") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    hashes = [r[0] for r in df.select(F.xxhash64(F.lit(5), F.col("doc_id"), F.xxhash64(F.col("text")))).collect()]
    bits = max(0, int(np.ceil(np.log2(max(1, len(rows) / bucket_rows)))))
    plain = plain_mix(rows, hashes, bits)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["taken"]) for r in mixing.mix(df, slots=256, bucket_rows=bucket_rows).collect())
    assert got == sorted((r[0] if r[0] is not None else -1, len((r[2] or "").split()), plain[i]) for i, r in enumerate(rows))


def test_small_sources_meet_their_targets(spark):
    rows = [(i, f"s{i % 1000:04d}", "ten words " * 5) for i in range(1000)] + [(5000 + i, "huge", "w " * 4000) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    of = mixing.mix(df, slots=512).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") > 3 * F.col("size")).alias("over")).collect()
    assert len(of) == 1001 and all(abs(r.taken - r.target) <= 0.5 and not r.over for r in of)
    # the draw itself follows the schedule: every prefix of the blocks' ranks is there
    sources = spark.createDataFrame([(1, 10, 1, 30.0), (2, 1000, 40, 1250.0), (3, 7, 7, 3.0)], "source_no long, source_size long, blocks long, target double")
    times = {(r.source_no, r.block): (r.times, r.part) for r in mixing.schedule(sources).collect()}
    assert times[1, 0] == (3, 0) and [times[3, b] for b in range(3)] == [(1, 0)] * 3 and (3, 3) not in times
    assert [times[2, b] for b in range(40)] == [(2, 0)] * 10 + [(1, 0)] * 30


def test_mixed_documents_beside_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "x y z", "kept"), (None, "b", "q", "too")], "doc_id long, source string, text string, __copies string")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and {r["__copies"] for r in out.collect()} <= {"kept", "too"} and out.count() >= 1


def test_native_plans_hold_no_python(spark, sf_dir):
    for name in ("op5_mixing", "op10_pii"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# --- archives ---------------------------------------------------------------------------------------


def test_archives_of_any_name_and_many_members(spark, tmp_path):
    import gzip
    import time

    record = lambda i: (f"http://a/{i} 1.2.3.4 20200101000000 text/html 5\nbody{i % 10}\n").encode()
    members = b"".join(gzip.compress(record(i), 1) for i in range(10_000))
    began = time.time()
    assert len(list(warc.arc_records(warc.inflated(members)))) == 10_000 and time.time() - began < 2
    (tmp_path / "in" / "deeper").mkdir(parents=True)
    (tmp_path / "in" / "IA-0001.arc").write_bytes(record(1) + record(2))
    (tmp_path / "in" / "deeper" / "IA-0002.arc.gz").write_bytes(gzip.compress(record(3)) + gzip.compress(record(4)))
    read = lambda **x: sorted(r.url for r in warc.read_arc(spark, str(tmp_path / "in"), **x).collect())
    assert read() == [f"http://a/{i}" for i in range(1, 5)]
    # a member that is cut off, and a file that is no archive
    (tmp_path / "in" / "cut.arc.gz").write_bytes(gzip.compress(record(5)) + gzip.compress(record(6))[:-12])
    with pytest.raises(Exception, match="cut off"):
        read()
    (tmp_path / "in" / "notes.txt").write_text("no archive\n")
    assert read(strict=False)[:5] == [f"http://a/{i}" for i in range(1, 6)]


def test_revisits_of_a_hot_payload_without_a_broadcast(spark):
    rows = [("x.arc", i, f"http://a/{i}", "20200101000000", f"HTTP/1.1 200 OK\r\nX-Page-Id: {i}\r\n\r\n", ("hot " * 40) if i % 3 else f"{i // 6} " * 60, True) for i in range(9000)]
    arc = spark.createDataFrame(rows, "archive string, place long, url string, date string, http_head string, payload string, is_http boolean").repartition(8)
    name = lambda df: sorted((r.page_id, r.record_type, r.refers_to) for r in df.select("page_id", "record_type", "refers_to").collect())
    assert name(warc.arc_to_warc(arc, broadcast_digests=0)) == name(warc.arc_to_warc(arc))


def test_archive_query_matches_sql(spark, sf_dir):
    df = queries.op7_warc(spark, sf_dir)
    names, expected = duck_rows(queries.ORACLES["op7_warc"], sf_dir)
    assert sorted(df.columns) == names and rows_of(df) == expected


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    body = "x" * 100
    rows = [(4, "http://a b/", None, 0), (2, None, body, 0), (1, "", body, 0), (None, "u", body, 0), (9, "v", "x" * 99, 0), (8, "v", "x" * 99, 0), (5, "w", "é\r\n\r\nWARC/1.1\r\nfiledesc://" * 20, 0), (6, "w", "y" * 300_000, 0)]
    got = warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string, payload int"), version=version).collect()
    by = {(r["page_id"], r["payload_bytes"]): r for r in got}
    assert len(got) == len(rows) and by[1, 100]["record_type"] == "response"
    assert by[2, 100]["record_type"] == by[None, 100]["record_type"] == "revisit" and by[2, 100]["refers_to"] == 1
    assert {by[i, 99]["record_type"] for i in (8, 9)} == {"response"}
    assert by[5, len(rows[6][2].encode())]["payload"] == rows[6][2] and by[4, 0]["target_uri"] == "http://a%20b/"
    assert len({r["record_id"] for r in got}) == len(rows) and all(re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", r["record_id"]) for r in got)
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archive_files_are_bounded_by_bytes_and_reruns_agree(spark, tmp_path):
    pages = spark.createDataFrame([(i, "filedesc://odd" if i == 3 else "u", "z%d" % (i % 4) * 40_000) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.arc_files(pages, f"{tmp_path}/arc", file_bytes=200_000)
    sizes = [len(warc.inflated(p.read_bytes())) for p in (tmp_path / "arc").glob("part-*")]
    assert sum(sizes) > 3_000_000 and max(sizes) < 300_000
    arc = warc.read_arc(spark, f"{tmp_path}/arc")
    assert arc.count() == 40
    few = {(r["record_id"], r["record_type"], r["refers_to"]) for r in warc.arc_to_warc(arc).collect()}
    joined = {(r["record_id"], r["record_type"], r["refers_to"]) for r in warc.arc_to_warc(arc, broadcast_digests=0).collect()}
    assert few == joined and sum(t == "revisit" for _, t, _ in few) == 36
    warc.arc_files(pages, f"{tmp_path}/again", file_bytes=200_000)
    assert few == {(r["record_id"], r["record_type"], r["refers_to"]) for r in warc.arc_to_warc(warc.read_arc(spark, f"{tmp_path}/again")).collect()}


def test_foreign_archives():

    head = b"1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://x 0.0.0.0 20010101000000 text/plain %d\n%s\n" % (len(head), head) + b"http://a/with space 1.2.3.4 20010203040506 text/html 5\nhello\ndns:a 1.2.3.4 2001 text/dns 2\nok\nbroken line\n"
    with pytest.raises(ValueError, match="broken line"):
        list(warc.arc_records(data))
    more = data + b"filedesc://y 1.2.3.4 2001 text/plain 2\nhi\n"
    assert [(h["URL"], block) for _, h, block in warc.arc_records(more, strict=False)][-1] == ("filedesc://y", b"hi")
    got = [(h["URL"], block) for _, h, block in warc.arc_records(data, strict=False)]
    assert got[1:] == [("http://a/with space", b"hello"), ("dns:a", b"ok")]
    import gzip

    assert warc.inflated(gzip.compress(b"a") + gzip.compress(b"b")) == b"ab"


# --- pseudonyms -------------------------------------------------------------------------------------


def luhn(s):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(s))) % 10 == 0


def changed(spark, *texts, key="k"):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, n_pii string")
    return [tuple(r) for r in pii.pseudonymised(df, key).orderBy("doc_id").select("text", "n_pii", "pii_kinds").collect()]


def test_formats_are_kept_and_valid(spark):
    card, iban, ssn, phone, day, ip, mail = "4111 1111 1111 1111", "GB82WEST12345698765432", "123-45-6789", "+1 (609) 555-7932", "1984-02-29", "10.1.2.3", "bob.x@mail7.example.com"
    token = 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"'
    (text, n, kinds), = changed(spark, " ; ".join([card, iban, ssn, phone, day, ip, mail, token]))
    assert n == 8 and kinds == ["card", "iban", "ssn", "phone", "date", "ip", "email", "secret"]
    c, i, s, p, d, a, m, t = text.split(" ; ")
    assert re.fullmatch(r"4\d{3}( \d{4}){3}", c) and luhn(c.replace(" ", "")) and c != card
    moved = i[4:] + i[:4]
    assert re.fullmatch(r"GB\d\dWEST\d{14}", i) and int("".join(str(int(x, 36)) for x in moved)) % 97 == 1 and i != iban
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", s) and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", p)
    assert re.fullmatch(r"\d{4}-\d\d-\d\d", d) and np.datetime64(d) != np.datetime64(day) and all(int(x) < 256 for x in a.split("."))
    assert re.fullmatch(r"u[0-9a-f]{12}@d[0-9a-f]{10}\.example", m) and re.fullmatch(r'token = "[0-9a-f]{40}"', t) and t != token


def test_secrets_under_the_usual_names(spark):
    v = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"
    names = [
        f"access_token={v}", f"client_secret: {v}", f'"api_key": "{v}"', f"'api-key': '{v}'", f"AWS_SECRET_ACCESS_KEY={v}", f"Authorization: Bearer {v}", f'"authorization": "Basic {v}"', f"password={v}", f"accessToken = {v}",
        f"MY_APP_DB_PASSWORD:{v}", f"a_b_c_d_e_f_g_h_token={v}", f"private_key = {v}, then more", f"pwd='{v}'.",
    ]
    done = changed(spark, *names)
    new = {re.search("[0-9a-f]{40}", t)[0] for t, _, _ in done}
    assert len(new) == 1 and new != {v} and [(n, k) for _, n, k in done] == [(1, ["secret"])] * len(names)
    assert [t.replace(new.copy().pop(), v) for t, _, _ in done] == names
    signed = "eyJhbGciOiJIUzI1NiIs.eyJzdWIiOiIxMjM0NTY3.SflKxwRJSMeKKF2QT4fw"
    (text, n, _), = changed(spark, f"Authorization: Bearer {signed}. Next")
    assert n == 1 and not any(p in text for p in signed.split(".")) and text.startswith("Authorization: Bearer ") and text.endswith(". Next")
    clean = ["a bearer internationalisations", "broken=internationalisation1", "token short=abc", "the secret of internationalisation", "keyboard=internationalisation1", "tokens: internationalisation1", "x" * 5000 + "_token", "a_" * 3000, "authorization: bearer short"]
    assert changed(spark, *clean) == [(t, 0, []) for t in clean]


def test_what_fails_validation_stays(spark):
    clean = ["4111111111111112", "Version 2.0 of 300.1.2.3", "30.02.2001 and 2001-13-01", "000-12-3456 666-12-3456", "GB82WEST12345698765433", "0000000000000000", "", "plain words", "a@b", "12 or 1,234.50"]
    assert changed(spark, *clean, None) == [*((t, 0, []) for t in clean), (None, 0, [])]


def test_equal_values_stay_linked(spark):
    (a, _, _), (b, _, _), (c, _, _) = changed(spark, "see 4111111111111111 now", "and 4111111111111111!", "or 4012888888881881")
    assert a.split()[1] == b.split()[1].rstrip("!") != c.split()[1]
    assert changed(spark, "see 4111111111111111 now", key="other")[0][0] != a


def test_permutation_is_a_bijection(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = {r[0] for r in df.select(F.expr(pii._let("q", "d", pii._digits("q", "'t'", "'k'")))).collect()}
    assert len(out) == 1000 and all(re.fullmatch(r"\d{3}", x) for x in out)
    one = {r[0] for r in spark.range(10).select(F.expr(pii._let("q", "cast(id as string)", pii._digits("q", "'t'", "'k'")))).collect()}
    assert one == set("0123456789")


def feistel(left, right, a, b, tweak, key):
    for i in range(pii.ROUNDS):
        mix = lambda x: int(hashlib.sha256(f"{key}|{tweak}|{i}|{x}".encode()).hexdigest()[:14], 16)  # noqa: B023, E731
        left, right = ((left + mix(right)) % a, right) if i % 2 == 0 else (left, (right + mix(left)) % b)
    return left, right


def permuted(d, tweak, key):
    half, rest = len(d) // 2, len(d) - len(d) // 2
    x, y = feistel(int("0" + d[:half]), int("0" + d[half:]), 10**half, 10**rest, f"{tweak}{len(d)}", key)
    return (str(x).zfill(half) if half else "") + str(y).zfill(rest)


def plain_card(d, key):
    body = d[1:-1]
    while True:
        body = permuted(body, "card", key)
        if re.match(pii.ISSUERS, d[0] + body):
            break
    return next(x for x in (d[0] + body + str(c) for c in range(10)) if luhn(x))


def plain_ssn(t, key):
    area, group, serial = map(int, t.split("-"))
    x, y = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn", key)
    area = x // 99 + 1
    return f"{area + (area >= 666):03d}-{x % 99 + 1:02d}-{y + 1:04d}"


def plain_ip(t, key):
    a, b, c, d = map(int, t.split("."))
    x, y = feistel(a * 256 + b, c * 256 + d, 65536, 65536, "ip", key)
    return f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"


def plain_day(t, key):
    first, k = datetime.date(1900, 1, 1), (datetime.date.fromisoformat(t) - datetime.date(1900, 1, 1)).days
    a, b = pii.DAY_RANGE
    while True:
        x, y = feistel(k // b, k % b, a, b, "date", key)
        k = x * b + y
        if k < pii.DAYS:
            return (first + datetime.timedelta(k)).isoformat()


def test_pseudonyms_equal_a_plain_network(spark):
    rng = random.Random(8)
    cards = []
    while len(cards) < 40:
        d = rng.choice(["2221", "2720", "30", "34", "38", "4", "51", "59", "65"]) + "".join(rng.choice("0123456789") for _ in range(15))
        d = d[: rng.choice([13, 15, 16, 19])]
        cards += [d] if luhn(d) and re.match(pii.ISSUERS, d) else []
    ssns = [f"{rng.choice([1, 665, 667, 899, 123]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(20)]
    ips = [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(20)]
    days = ["1900-01-01", "2099-12-31", "2099-11-14", *((datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(pii.DAYS))).isoformat() for _ in range(20))]
    texts = [*cards, *ssns, *ips, *days]
    got = [r[0] for r in changed(spark, *texts, key="some key")]
    plain = [f(x, "some key") for xs, f in ((cards, plain_card), (ssns, plain_ssn), (ips, plain_ip), (days, plain_day)) for x in xs]
    assert got == plain
    # a pseudonym is recognised again as what it is
    assert all(n == 1 for _, n, _ in changed(spark, *got, key="other"))


def test_the_parser_keeps_nothing_of_the_pseudonyms(spark):
    """Their expression is long; what the parser would learn of it takes some ninety megabytes."""
    jvm = spark.sparkContext._jvm
    docs, runtime = spark.createDataFrame([(1, "a")], "doc_id long, text string"), jvm.java.lang.Runtime.getRuntime()
    jvm.org.apache.spark.sql.catalyst.parser.SqlBaseParser(None).getInterpreter().clearDFA()  # what earlier texts taught it
    used = []
    for kept in (lambda: None, lambda: pii.pseudonymised(docs, "k")):
        held = kept()
        release(spark)
        used.append((runtime.totalMemory() - runtime.freeMemory()) / 1e6)
    assert held.columns and used[1] - used[0] < 40
    assert spark.conf.get("spark.sql.parser.manageParserCaches") == "false"


def test_the_pseudonyms_are_parsed_in_short_texts(spark, monkeypatch):
    """What the parser needs meanwhile grows faster than a text: for the whole in one, 400 MB of heap."""
    texts, parsed = [], F.expr
    monkeypatch.setattr(pii.F, "expr", lambda t: texts.append(t) or parsed(t))
    found = pii.pseudonymised(spark.createDataFrame([(1, "call +1 202 555 0143 or 10.0.0.1")], "doc_id long, text string"), "k")
    assert max(map(len, texts)) < 5000 and found.collect()[0]["pii_kinds"] == ["phone", "ip"]


def test_the_driver_gives_back_what_it_has_freed_outside_the_heap(spark):
    assert trim_driver(spark)


def test_pseudonyms_need_a_key_and_leave_other_columns(spark):
    df = spark.createDataFrame([(1, "call 4111111111111111", "kept")], "doc_id int, text string, __parts string")
    assert pii.pseudonymised(df, "k").first()["__parts"] == "kept"
    with pytest.raises(ValueError, match="key"):
        pii.pseudonymised(df, "")


def test_very_long_text(spark):
    (text, n, _), = changed(spark, "clean words " * 100_000 + "mail a.b@mail.example.com end")
    assert n == 1 and "a.b@mail" not in text and text.startswith("clean words ")


def test_phones_end_before_other_values(spark):
    alone, *rest = changed(spark, "+1 (826) 555-4081", "+1 (826) 555-4081 190.137.223.204", "+1 (826) 555-4081 190", "+44 20 7946 0958 1984-02-29", "+44 20 7946 0958 123456 123456 x", *["+1 (826) 555-4081 10.1.2.3 "] * 2)
    phone = alone[0]
    (both, n, kinds), (short, *_), (dated, _, second), (long, _, third), twice, again = rest
    assert n == 2 and kinds == ["phone", "ip"] and both.startswith(phone + " ") and "190.137" not in both
    assert short == phone + " 190" and second == ["phone", "date"] and third == ["phone"] and twice == again and "7946" not in long
    (table, n, _), = changed(spark, "+1 (826) 555-4081 10.1.2.3; " * 400)
    assert n == 800 and table == (twice[0].rstrip() + "; ") * 400


def test_text_after_grouped_values(spark):
    values = {"4111 1111 1111 1111": ["123", "12/25", "12/25/1999", "123 456 7890", "4012 8888 8888 1881"], "BE68 5390 0754 7034": ["EUR", "2024"], "ES91 2100 0418 4502 0005 1332": ["2024", "AND 12"], "FR14 2004 1010 0505 0001 3M02 606": ["EUR"], "3782 822463 10005": ["12"]}
    for value, tails in values.items():
        (alone, n, kinds), *rest = changed(spark, value, *(f"{value} {t}" for t in tails))
        assert n == 1 and alone != value
        for (text, _, found), tail in zip(rest, tails, strict=True):
            assert text.startswith(alone + " ") and found[0] == kinds[0]
            assert len(found) == 2 or text == f"{alone} {tail}"
    (text, n, _), = changed(spark, "1234 4111 1111 1111 1111")
    assert n == 1 and text.startswith("1234 4") and "1111 1111" not in text


def test_more_phones_and_month_first_dates(spark):
    phones = ["+14155552671", "+1 (415) 555-2671", "+4915112345678", "+442079460958123", "+35312345678", "555 123 4567", "(555) 123 4567"]
    got = changed(spark, *phones, "call +14155552671, or 555 123 4567.")
    assert [(n, kinds) for _, n, kinds in got[:-1]] == [(1, ["phone"])] * len(phones) and got[-1][1] == 2
    digits = [re.sub("[^0-9]", "", text) for text, *_ in got]
    assert digits[0] == digits[1] and [d[:n] for d, n in zip(digits[2:5], (2, 2, 3), strict=True)] == ["49", "44", "353"]
    assert all(re.sub("[0-9]", "0", t) == re.sub("[0-9]", "0", p) and t != p for (t, *_), p in zip(got, phones, strict=False))
    days = [f"{d.astype('O'):%m/%d/%Y}" for d in np.arange("1999-12-13", "2001-02-01", dtype="datetime64[D]") if d.astype("O").day > 12]
    out = [t for t, n, kinds in changed(spark, *days, "12/25/1999 05/03/1999 13/13/1999")]
    assert len(set(out[:-1])) == len(days) and all(re.fullmatch(r"(0\d|1[0-2])/(1[3-9]|[23]\d)/(19|20)\d\d", t) for t in out[:-1])
    a, b, c = out[-1].split()
    assert a == out[days.index("12/25/1999")] and b != "05/03/1999" and c == "13/13/1999"


def test_long_secrets_and_last_days(spark):
    value = "aB3_" * 1000 + "tail"
    (one, n, kinds), (two, *_), (quoted, *_) = changed(spark, f"token={value}", f"token={value[:-1]}L and more", f'secret: "{value}"')
    assert n == 1 and kinds == ["secret"] and re.fullmatch("token=[0-9a-f]{4004}", one) and quoted == f'secret: "{one[6:]}"'
    assert re.fullmatch("token=[0-9a-f]{4004} and more", two) and two[6:70] != one[6:70]
    days = [str(d) for d in np.arange("2099-10-01", "2100-01-02", dtype="datetime64[D]")]
    out = [t for t, *_ in changed(spark, *days)]
    assert all(a != b and "1900" <= b[:4] <= "2099" for a, b in zip(days[:-1], out[:-1], strict=True)) and out[-1] == days[-1] and len(set(out)) == len(days)


# --- the pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf_dir, library):
    import corpus_pipeline as pipeline
    from quire.llm import jaccard
    from quire.llm.common import table, written

    docs = table(spark, sf_dir, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], sf_dir), name))
    assert all(d.columns == columns for d in seen[:-1])
    before, lang, unique, private, mixed, encoded = seen
    assert lang.count() == before.filter(F.col("text").rlike(r"\p{L}")).count()
    groups = {r["component_id"] for r in jaccard.join_components(lang).collect()}
    assert {r["doc_id"] for r in unique.collect()} == groups
    expected = {r["doc_id"]: r["text"] for r in pii.pseudonymised(unique, queries.TRIAL_KEY).collect()}
    assert {r["doc_id"]: r["text"] for r in private.collect()} == expected
    taken = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) if r["size"] else 0 for r in mixing.mix(private).collect()}
    copies = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies == {d: n for d, n in taken.items() if n}
    got = encoded.collect()
    assert len(got) == mixed.count()
    assert all(r["ids"] == " ".join(map(str, library.encode(expected[r["doc_id"]], add_special_tokens=False).ids)) for r in got[:100])


def test_pipeline_stages_take_nulls_ties_repeats_clashes_and_nothing(spark):
    import corpus_pipeline as pipeline
    from quire.llm.common import written

    english, german = "the house and the garden are green and old ", "das haus und der garten sind alt und schön "
    rows = [(i, english * 3 + f"number {i} of them is here", "en", "a", 10) for i in range(8)] + [(10 + i, german * 3 + f"nummer {i} davon ist hier", "de", "b", 10) for i in range(8)]
    rows += [(30, None, "en", "a", None), (31, "", None, None, 0), (32, "12 !! 34", None, "c", 8), (None, "a text without an id that nobody else has at all", "en", None, 1), (None, None, None, None, None)]
    rows += [(40, "call 4111111111111111 about the house and the green garden now", "en", "c", 62)] * 2 + [(41, english * 20_000, "en", "a", 1)]
    columns = "doc_id long, text string, lang string, source string, n_chars int"
    extra = ", __lang string, __score int, __copies int, __id long, __text string, __parts string, label string"
    df = spark.createDataFrame([(*r, "l", 1, 2, 3, "t", "p", "x") for r in rows], columns + extra)
    for table in (df, df.limit(0)):
        docs = table
        for name, stage in pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, ""), name)
            assert docs.columns == df.columns
            if table is not df:
                assert docs.count() == 0
        out = pipeline.STAGES[-1][1](spark, docs, "")
        assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and (out.count() > 0) == (table is df)
        if table is df:
            assert not [r for r in docs.collect() if r["text"] and "4111111111111111" in r["text"]]
            assert {r["doc_id"] for r in docs.collect()} <= {*range(8), *range(10, 18), None, 40, 41} and {r["__copies"] for r in docs.collect()} == {2}
