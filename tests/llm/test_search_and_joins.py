"""Vector searches and the Jaccard join against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from quire.llm import ann, jaccard, queries, topk
from quire.llm import vectors as V
from quire.llm.components import components


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, part int")


@pytest.fixture(scope="module")
def some_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 12))
    x[50:90] = x[40]  # many equal vectors, some of them queries
    rows = [(i, [float(v) for v in x[i]], "clash", 1) for i in range(700)]
    rows += [(1000, None, "", 1), (1020, [float("nan")] * 12, "", 1), (1040, [float("inf")] + [0.0] * 11, "", 1), (1060, [None] + [0.0] * 11, "", 1), (1080, [1.0] * 3, "", 1), (None, [1.0] * 12, "", 1), (1100, [0.0] * 12, "", 1), (1120, [], "", 1)]
    return vectors(spark, rows)


def kept(df, zero):
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    good = [(i, e) for i, e in rows if i is not None and e is not None and len(e) == 12 and all(v is not None and np.isfinite(v) for v in e) and (zero or any(e))]
    return np.array([g[0] for g in good]), np.array([g[1] for g in good], dtype=np.float64)


def test_top_k_is_exact(some_vectors):
    ids, x = kept(some_vectors, True)
    w = np.floor(64 * x)
    expected = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = w @ w[q]
        s[q] = -np.inf
        for n, i in enumerate(np.lexsort((ids, -s))[:20]):
            expected.append((ids[q], n + 1, ids[i], int(s[i])))
    got = [tuple(r) for r in topk.top_k(some_vectors).collect()]
    assert sorted(got) == sorted(expected)


def test_neighbours_reach_recall_and_measure_exactly(some_vectors):
    ids, x = kept(some_vectors, False)
    got = defaultdict(list)
    for r in ann.neighbours(some_vectors).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids if i % 100 == 0}
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[list(ids).index(q)]) ** 2).sum(1))
        by_id = dict(zip(ids, d, strict=True))
        assert len(found) == 10 and q not in dict(found)
        assert all(abs(by_id[i] - s) < 1e-12 for i, s in found) and found == sorted(found, key=lambda f: (f[1], f[0]))
        d[list(ids).index(q)] = np.inf
        hits += len({i for i, _ in found} & set(ids[np.lexsort((ids, d))[:10]]))
    assert hits / (10 * len(got)) >= 0.9


def test_recall_on_the_data(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in df.collect()}
    ids, m = np.array(list(x)), np.array(list(x.values()))
    got = defaultdict(set)
    for r in queries.op8_ann(spark, sf_dir).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in got:
        d = ((m - x[q]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits += len(got[q] & set(ids[np.argsort(d)[:10]]))
    assert hits / (10 * len(got)) >= 0.9


def test_few_and_no_vectors(spark):
    few = vectors(spark, [(0, [1.0, 0.0], "", 1), (100, [0.0, 1.0], "", 1), (7, [1.0, 1.0], "", 1)])
    assert {(r["query_id"], r["rank"]) for r in topk.top_k(few).collect()} == {(0, 1), (0, 2), (100, 1), (100, 2)}
    assert ann.neighbours(few).count() == 4
    empty = few.limit(0)
    assert topk.top_k(empty).count() == ann.neighbours(empty).count() == 0
    assert ann.neighbours(few.filter("vec_id = 0")).count() == 0


# --- the Jaccard join -------------------------------------------------------------------------------


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[find(i)].append(d)
    return sorted(((d, len(sets[i]), min(smallest[find(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


def joined(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, sid string, bucket int, n int")
    return sorted((tuple(r) for r in jaccard.join_components(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def test_join_edges(spark):
    same = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Two Words"), (5, "two words"), (6, "two  WORDS again"), (7, same), (8, same.upper()), (9, same.replace(" ", "\n")), (10, "É é " * 5), (11, "é é " * 5), (12, "a b c d e"), (12, "v w x y z"), (None, same), (None, "lonely text without any other"), (13, "x" * 50_000), (14, "word " * 40_000)]
    assert joined(spark, rows) == brute(rows)
    assert joined(spark, rows[:0]) == []


def test_join_chains_thresholds_and_groups(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0

    def add(text):
        nonlocal n
        rows.append((n, " ".join(text)))
        n += 1

    base = list(rng.choice(words, 104))
    add(base)
    chain = list(base)
    for _ in range(12):  # each close to the one before, the ends far apart
        at = int(rng.integers(0, len(chain)))
        chain = [*chain[:at], "new" + str(n), "edit" + str(n), *chain[at + 1 :]]
        add(chain)
    for k in range(1, 16):  # around the threshold: k words appended to 80 shingles
        add([*(f"t{i}" for i in range(84)), *(f"u{k}x{i}" for i in range(k + 8))])
    passage = [f"p{i}" for i in range(60)]
    for _ in range(40):  # a passage that many share, next to text of their own
        add([*rng.choice(words, 90), *passage, *rng.choice(words, 30)])
    for _ in range(30):  # mostly the passage: many border points
        add([*passage, *rng.choice(words, int(rng.integers(2, 14)))])
    group = list(rng.choice(words, 200))
    for _ in range(60):  # a dense group of near copies
        g = list(group)
        g[int(rng.integers(0, 200))] = "other"
        add(g)
    assert joined(spark, rows) == brute(rows)


def test_one_document_of_each_group_stays(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (9, "other words in this text here"), (4, ""), (6, None)]
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, extra string")
    kept = jaccard.one_per_component(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 6, 9]


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (7, 7)], "a long, b long")
    got = defaultdict(set)
    for r in components(links).collect():
        got[r["label"]].add(r["node"])
    assert sorted(map(sorted, got.values())) == [[1, 2, 3, 4], [10, 11, 12]]
    assert components(links.limit(0)).count() == 0


def test_near_copies_without_ids_stay_linear(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.choice("abcdefgh") * rng.randint(1, 4) + str(rng.randint(0, 99)) for _ in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        words[i % 120] = f"edit{i}"
        rows.append((None, " ".join(words)))
    rows += [(7, " ".join(base)), (7, " ".join(base)), (8, "nothing of that kind is here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    met = []
    plain = jaccard._measured

    def counted(pairs, points, texts):
        met.append((pairs.count(), texts.count()))
        return plain(pairs, points, texts)

    monkeypatch.setattr(jaccard, "_measured", counted)
    got = jaccard.join_components(df).collect()
    assert sorted({r["component_id"] for r in got if r["n_shingles"] > 100}, key=str) == [7] and len(got) == len(rows)
    assert max(t for _, t in met) <= 302 and sum(p for p, _ in met) < 3000


def test_copies_of_one_set_are_cut_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_ROWS", 20)
    texts = ["this very long sentence is found in most of all rows here"] * 200 + ["this very long sentence is found in most of all rows here too", "another one that is alone in the world"]
    df = spark.createDataFrame([(i if i % 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in jaccard.join_components(df).collect() if r["doc_id"] is not None}
    assert got == {(i, 201 if i == 201 else 1) for i in range(202) if i % 3}


def test_vectors_of_several_lengths_are_searched_apart(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(100 + i, [float(i), 1.0]) for i in range(5)] + [(200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for found in (topk.top_k(df, every=20, k=3), ann.neighbours(df, every=20, k=3)):
        got = {(r["query_id"], r["vec_id"]) for r in found.collect()}
        assert {q for q, _ in got} == {0, 20, 40, 100}
        assert all((q >= 100) == (v >= 100) for q, v in got) and sum(q == 100 for q, _ in got) == 3


def test_rows_that_repeat_an_id_bring_one_sample(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])] * 5000 + [(2, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert len(V.sample(df, 5001, 10)[0]) <= 2


def test_levels_of_shingles_take_little_memory(monkeypatch):
    import tracemalloc

    total = np.random.default_rng(3).integers(0, 60, jaccard.COUNTERS).astype(np.uint32)
    total[::1000] *= 500
    monkeypatch.setattr(jaccard, "_merged", lambda parts, add: total)
    tracemalloc.start()
    got = jaccard.levels(None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == np.floor(np.log2(np.maximum(total / total.mean(), 1))).astype(np.uint8)).all() and got.max() > 5
    assert peak < 20_000_000
