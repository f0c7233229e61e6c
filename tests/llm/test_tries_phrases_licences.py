"""Conversation tries, phrases and licence scans against plain versions on small inputs."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest

from quire.llm import collocations, grams, licences, queries, trie
from tests.conftest import TESTDATA, duck_rows, rows_of

CONVERSATION = "role string, conv_id long, turn long, text string, part string, depth int"
WORD = r"[^\x20\x09-\x0D]+"


def plain_trie(rows):
    """Nodes of the rebuilt conversations, by dictionaries of prefixes."""
    own = {}
    for role, conv, turn, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, key, len(re.findall(WORD, text))))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members, words = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            prefix = tuple(t[0] for t in turns[:d])
            members.setdefault(prefix, []).append(c)
            words[prefix] = turns[d - 1][1] if d else 0
    children = {}
    for prefix in members:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)

    leaves, saved = {}, {}
    for prefix in sorted(members, key=len, reverse=True):
        below = children.get(prefix, [])
        leaves[prefix] = sum(leaves[k] for k in below) or 1
        saved[prefix] = (len(members[prefix]) - 1) * words[prefix] + sum(saved[k] for k in below)
    out = []
    for prefix, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(prefix))))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(cs), len(prefix), hashlib.sha256(ends.encode()).hexdigest(), len(children.get(prefix, [])), len(cs), leaves[prefix], parent, saved[prefix]))
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted(((r.conv_id, r.depth, r.ends_sha256, r.n_children, r.n_convs, r.n_leaves, r.parent_conv_id, r.saved_tokens) for r in df.collect()), key=repr)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-90, 400), n):
        for turn in range(rng.randint(1, 6)):
            text = rng.choice(["hi", "yes please", None, "", "a\tb  c", f"only {c}", "long " * 40])
            rows.append((rng.choice(["user", "bot", None]), c, rng.choice([turn, turn, turn, None, 2]), text))
    # copies of one conversation, exact repeats of a row, one long conversation, rows without a conversation
    rows += [("user", 1000 + i, t, f"copy {t}") for i in range(60) for t in range(6)]
    rows += [("user", 77777, 3, "same")] * 5 + [("bot", 500, i, f"turn {i}") for i in range(300)] + [("user", None, 1, "lost")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_dictionaries_of_prefixes(spark, seed):
    rows = conversations(seed, 120)
    df = spark.createDataFrame([(a, b, c, d, "part", 7) for a, b, c, d in rows], CONVERSATION).repartition(5)
    assert trie_rows(trie.conversation_trie(df)) == plain_trie(rows)


def test_trie_of_few_and_turnless_conversations(spark):
    make = lambda rows: spark.createDataFrame([(a, b, c, d, None, None) for a, b, c, d in rows], CONVERSATION)
    assert trie.conversation_trie(make([])).count() == 0
    assert trie.conversation_trie(make([("user", None, 1, "x")])).count() == 0
    # one conversation; and such whose opening is longer than they are, their family's first absent
    openings = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2][:3]
    for rows in ([("user", 40, 1, "a b")], [("user", c, 0, "gone") for c in openings]):
        assert trie_rows(trie.conversation_trie(make(rows))) == plain_trie(rows)
    assert trie.conversation_trie(make([("user", c, 0, "gone") for c in openings])).count() == 1


def test_ends_are_hashed_in_numeric_order(spark):
    ids = [10**12, -5, 3, 100, 20, 9, -10000, 4096, 4095]
    df = spark.createDataFrame([(2, 3, i) for i in ids], "depth long, node long, conv_id long").repartition(4)
    assert [r.ends_sha256 for r in trie._digests(df).collect()] == [hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()]


def test_trie_query_matches_sql(spark, sf_dir):
    assert rows_of(queries.QUERIES["op11_prefix_trie"](spark, sf_dir)) == duck_rows(queries.ORACLES["op11_prefix_trie"], sf_dir)[1]


def test_cut_words_and_hashes():
    texts = ["The CAT,the  cat", None, "", " ÉÀ the cat\x0bthe", "x" * 5000 + " the", "cat"]
    cuts = grams.Cuts(pa.array(texts), collocations._INSIDE, collocations._BREAKS)
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    words = [re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", t) for t in lower]
    assert cuts.strings(pa.array(range(len(cuts))).to_numpy()).to_pylist() == [w for ws in words for w in ws]
    assert [cuts.bounds[i + 1] - cuts.bounds[i] for i in range(len(texts))] == list(map(len, words))
    h = cuts.hashes(11).tolist()
    flat = [w for ws in words for w in ws]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(h)) for j in range(len(h)))
    part = grams.Cuts(pa.array(texts).slice(3, 2), collocations._INSIDE, collocations._BREAKS)
    assert part.hashes(11).tolist() == h[cuts.bounds[3] : cuts.bounds[5]]


def plain_collocations(docs, max_n, least, share, top):
    counts, total = {}, {}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] = total.get(lang, 0) + len(ws)
            for n in range(1, max_n + 1):
                for i in range(len(ws) - n + 1):
                    p = (lang, tuple(ws[i : i + n]))
                    counts[p] = counts.get(p, 0) + 1
    cands = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, ws), a in cands.items():
        inside = any(o[0] == lang and len(o[1]) > len(ws) and any(o[1][i : i + len(ws)] == ws for i in range(len(o[1]))) and 100 * b >= share * a for o, b in cands.items())
        if not inside:
            s, _, left, right = min((1000000 * a * a // (counts[lang, ws[:k]] * counts[lang, ws[k:]]), k, counts[lang, ws[:k]], counts[lang, ws[k:]]) for k in range(1, len(ws)))
            out.setdefault(lang, []).append((-s, -a, " ".join(ws).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, total[lang], -s) for lang, rows in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


@pytest.mark.parametrize(("max_n", "bits", "top"), [(3, 26, 2000), (4, 8, 7), (2, 12, 2000)])
def test_collocations_equal_plain_counts(spark, max_n, bits, top):
    rng = random.Random(max_n)
    vocabulary = ["new", "york", "of", "the", "é", "a-b", "Straße", "x" * 70, " ", "NEW"]
    docs = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", "\n", ", ", "\t"]) for _ in range(rng.randint(0, 40)))) for _ in range(300)]
    docs += [("en", None), ("fr", ""), ("en", "new york city " * 400), *[("de", "guten morgen liebe leute")] * 30]
    df = spark.createDataFrame([(1, a, b, 0) for a, b in docs], "n int, lang string, text string, phrase int").repartition(4)
    got = collocations.collocations(df, max_n=max_n, bits=bits, top=top)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain_collocations(docs, max_n, 10, 50, top)
    assert collocations.collocations(df.limit(0)).count() == 0


def test_large_counts_are_scored_exactly(spark):
    a, left, right = 7_000_000_000_003, 9_000_000_000_001, 8_000_000_000_009
    counts = spark.createDataFrame([("en", "p q", 2, a), ("en", "p", 1, left), ("en", "q", 1, right), ("en", None, 0, 10**14)], "lang string, phrase string, size int, n long")
    row = collocations.ranked(counts).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in row] == [("p q", a, left, right, 10**14, 1000000 * a * a // (left * right))]


def test_collocations_query_matches_sql(spark, sf_dir):
    assert rows_of(queries.QUERIES["op12_collocations"](spark, sf_dir)) == duck_rows(queries.ORACLES["op12_collocations"], sf_dir)[1]


def licence_texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 8)):
            t = rng.choice(licences.TEMPLATES)[1]
            ws = t.split()
            at = rng.randint(0, len(ws) - 1)
            parts.append(rng.choice([t, " ".join(ws[at : at + rng.randint(1, 60)]), rng.choice(list(licences.PHRASES)), rng.choice(["GNU", "general Public", "license", "é", "mit—license", "CC BY 4.0", "Apache—License", "cc by\x00cc by"])]))
        out.append(rng.choice([" ", "\n", " x "]).join(parts))
    return out


def plain_matches(words, templates):
    """Matching statistics by trying: for each word the length of the longest run of template words that ends there."""
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    out = []
    for i in range(len(words)):
        n = out[-1] + 1 if out else 1
        while n and tuple(words[i - n + 1 : i + 1]) not in runs:
            n -= 1
        out.append(n)
    return out


def test_matching_statistics_equal_trying_all_runs():
    scanner = licences.Scanner()
    templates = [licences.words_of(t) for t in [*licences.PHRASES, *(t for _, t in licences.TEMPLATES)]]
    vocabulary = sorted({w for t in templates for w in t})
    number = {w: i for i, w in enumerate(vocabulary)}
    for text in licence_texts(5, 40):
        words = licences.words_of(text)
        state = length = 0
        got = []
        for w in words:
            state, length = scanner.automaton.step(state, length, number[w]) if w in number else (0, 0)
            got.append(length)
            if length >= licences.LEAST:
                assert all(templates[t][e - length + 1 : e + 1] == words[len(got) - length : len(got)] for t, e in scanner.automaton.ends[state])
                held = sum(templates[t][i : i + length] == words[len(got) - length : len(got)] for t in range(len(templates)) for i in range(len(templates[t])))
                assert held == len(scanner.automaton.ends[state])
        assert got == plain_matches(words, templates)


def test_scan_finds_phrases_and_templates(spark):
    whole = [f"Foo\nbar {t.upper()} baz" for _, t in licences.TEMPLATES]
    texts = [*licence_texts(7, 150), None, "", "...", *whole, "cc by " * 3000, ("words " * 5000) + licences.TEMPLATES[1][1]]
    df = spark.createDataFrame([(i if i else None, t, "labels", 1) for i, t in enumerate(texts)], "doc_id int, text string, labels string, score int").repartition(3)
    got = {r.doc_id or 0: r for r in licences.scan(df).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words, row = licences.words_of(text or ""), got[i]
        places = [(at, label) for p, label in licences.PHRASES.items() for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert (row.first_word, row.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert row.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(row.base_labels.split(",")) <= set(row.labels.split(",")) or not places
        assert row.labels == ",".join(sorted({*filter(None, row.base_labels.split(",")), *(s.label for s in row.spans)})) and 0 <= row.score <= 1
        for s in row.spans:
            assert 0 <= s.first_word <= s.last_word < len(words) and s.covered >= licences.COVER
    at = texts.index(whole[0])
    for k, (label, t) in enumerate(licences.TEMPLATES):
        assert [(s.label, s.first_word, s.last_word, s.covered) for s in got[at + k].spans] == [(label, 2, 1 + len(licences.words_of(t)), 1.0)] and got[at + k].score == 1
    last = got[len(texts) - 1]
    assert last.labels == "mit" and last.spans[0].first_word == 5000
    assert licences.scan(df.limit(0)).count() == 0


def test_chains_bridge_gaps_in_order():
    scanner = licences.Scanner({}, [("x", " ".join(f"w{i}" for i in range(40)))], least=4, gap=6, cover=0.5)
    words = [f"w{i}" for i in range(40)]

    def spans(text):
        return [(s["first_word"], s["last_word"], round(s["covered"], 3)) for s in licences._rows(scanner, pa.array([" ".join(text)]))[0]["spans"]]

    assert spans(words) == [(0, 39, 1.0)]
    assert spans([*words[:15], "a", "b", *words[17:40]]) == [(0, 39, 38 / 40)]  # two words replaced
    assert spans([*words[:15], *["z"] * 7, *words[15:40]]) == [(22, 46, 25 / 40)]  # too wide a gap
    assert spans([*words[20:40], *words[:20]]) == [(0, 19, 0.5), (20, 39, 0.5)]  # order matters
    assert spans([*words, "q", *words]) == [(0, 39, 1.0), (41, 80, 1.0)]
    assert spans(words[:3] * 10) == []


def test_licence_query_scans_whole_texts(spark):
    sf = str(TESTDATA / "sf0.001")
    rows = licences.scan(spark.read.parquet(f"{sf}/documents.parquet")).drop("spans").collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, queries.QUERIES["op13_licences"](spark, sf).collect()))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.n_words == len(licences.words_of(texts[r.doc_id] or "")) for r in rows) and any(r.n_base for r in rows)
