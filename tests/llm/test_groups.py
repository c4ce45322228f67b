"""Near duplicates, by words and by vectors, and exact search: against brute force."""

import re

import numpy as np
import pytest

import corpus_pipeline
from weftline.operators.connect import components
from weftline.llm import cosine_dedup, shingle_join, topk_search


def least_reachable(ids, links):
    low = {i: i for i in ids}
    while True:
        before = dict(low)
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_words(texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], least_reachable(range(len(sets)), links)


def texts_with_copies():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(words, 60))
    out = [None, "", " \t ", "one two", "ONE Two", "one two three", "a b c d e", "É b c d e", "é b c d e", "x " * 3000]
    for n in (8, 30, 120):
        for _ in range(6):
            base = rng.choice(words, n)
            for edits in (0, 0, 1, 1, 2, 3, n // 10):
                t = base.copy()
                t[rng.integers(0, n, edits)] = rng.choice(words, edits)
                out.append(" ".join(t))
    hot = rng.choice(words, 100)
    for _ in range(60):  # one group of near copies
        t = hot.copy()
        t[rng.integers(0, 100, 2)] = rng.choice(words, 2)
        out.append(" ".join(t))
    out += [f"{passage} {' '.join(rng.choice(words, 20))}" for _ in range(40)]  # a shared passage, not near enough
    out += [out[20]] * 30
    return out


def test_jaccard_components(spark):
    texts = texts_with_copies()
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, node long").repartition(3)
    sizes, least = brute_words(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.jaccard_components(table).collect()}
    assert got == {i: (sizes[i], least[i]) for i in range(len(texts))}


@pytest.mark.parametrize("settings", [{"HEAD_ROUNDS": (1,), "SENT_KEYS": -1}, {"HEAD_ROUNDS": (2,), "LONG_LISTS": 40, "PART": 2}])
def test_settings_change_nothing(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(shingle_join, name, value)
    texts = texts_with_copies()[:140]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, least = brute_words(texts)
    assert {r["doc_id"]: r["component_id"] for r in shingle_join.jaccard_components(table).collect()} == least


def test_short_names_of_sets_are_told_apart(spark):
    """With 6 bits nearly all sets share their name with others."""
    texts = texts_with_copies()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, least = brute_words(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.jaccard_components(table, name_bits=6).collect()}
    assert got == {i: (sizes[i], least[i]) for i in range(len(texts))}


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


def test_words_with_equal_polynomials_are_not_one(spark):
    """Thue-Morse words and their complements have equal polynomials modulo 2**64 for any base."""
    texts = [thue_morse(n, *ab) for n in (1024, 2048, 8192) for ab in ("ab", "ba", "xy", "yx")]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["n_shingles"], r["component_id"] == r["doc_id"]) for r in shingle_join.jaccard_components(table).collect()} == {(1, True)}


def test_lists_are_divided_by_cost():
    for n in range(1, 3000, 7):
        need = shingle_join.need_of(n, (3, 4))
        assert 0 <= shingle_join.long_lists(n, (3, 4), 10**6) <= shingle_join.long_lists(n, (3, 4), 2) <= need - 1
    assert shingle_join.long_lists(4000, (3, 4), 10**6) < 2900


def test_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, a + " z"), (None, b), (5, b + " z"), (7, c), (7, c), (8, c + " z"), (9, "one"), (9, "two"), (9, "three"), (9, "three")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in shingle_join.jaccard_components(table).collect()), key=repr)
    assert got == sorted([(None, None)] * 2 + [(None, 5), (5, 5), (7, 7), (7, 7), (8, 7)] + [(9, 9)] * 4, key=repr)
    kept = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, table, "").collect()]
    assert sorted(x for x in kept if x[0] is not None) == [(5, b + " z"), (7, c), (9, "one"), (9, "three"), (9, "two")]
    assert len(kept) == 6 and {x[1] for x in kept if x[0] is None} <= {a, a + " z"}


def test_no_documents(spark):
    assert shingle_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5), (None, 3)], "a long, b long")
    got = components(edges).collect()
    assert len(got) == 201 and {r["component"] for r in got} == {0}


def vectors():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(260, 12))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    n = len(rows)
    for i in range(120):  # near copies, many of one
        base = x[7 if i < 60 else rng.integers(0, 260)]
        noise = rng.normal(size=12) * np.linalg.norm(base) * 0.1
        rows.append((n + i, (base + noise).tolist(), 7 % 3 if i < 60 else int(rng.integers(0, 3))))
    n = len(rows)
    rows += [(n + i, x[3].tolist(), 0) for i in range(10)]
    rows += [(n + 10, None, 0), (n + 11, [0.0] * 12, 0), (n + 12, [float("nan")] * 12, 0), (n + 13, [None] * 12, 0), (n + 14, x[3].tolist(), None), (n + 15, [], 0), (n + 16, x[3].tolist()[:4], 0), (n + 17, (x[3] * 1e200).tolist(), 0)]
    return rows


@pytest.mark.parametrize("cell, block, split", [(2048, 1024, 256), (40, 16, 256), (12, 8, 3)])
def test_cosine_components(spark, monkeypatch, cell, block, split):
    """The small settings make many cells, visits and blocks, and divide cells again."""
    monkeypatch.setattr(cosine_dedup, "SPLIT", split)
    monkeypatch.setattr(cosine_dedup, "CHUNK", 50 * split)
    monkeypatch.setattr(cosine_dedup, "CELL", cell)
    monkeypatch.setattr(cosine_dedup, "BLOCK", block)
    rows = vectors()
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, node int")
    unit = {}
    for i, v, lab in rows:
        a = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(12)
        a = np.pad(a, (0, 12 - len(a)))
        if lab is not None and np.isfinite(a).all() and a.any():
            a = a / np.abs(a).max()
            unit[i] = (a / np.linalg.norm(a), lab)
    links = [(i, j) for i in unit for j in unit if i < j and unit[i][1] == unit[j][1] and unit[i][0] @ unit[j][0] >= 0.93]
    n = dict.fromkeys(range(len(rows)), 0)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    least = least_reachable(range(len(rows)), links)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cosine_dedup.cosine_components(table).collect()}
    assert got == {i: (n[i], least[i], least[i] == i) for i in range(len(rows))}


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert cosine_dedup.cosine_components(empty).count() == 0
    assert topk_search.top_products(empty, empty.vec_id % 20 == 0, k=20).count() == 0


@pytest.mark.parametrize("group, queries", [(8192, 2048), (60, 4)])
def test_top_products(spark, monkeypatch, group, queries):
    monkeypatch.setattr(topk_search, "GROUP", group)
    monkeypatch.setattr(topk_search, "QUERIES", queries)
    rows = [*vectors(), (20, [1.5] * 12, 0), (3, [0.25] * 12, 0), (3, [0.25] * 12, 0), (500, [1e30] * 12, 0), (501, [-1e30, 1e30, 3e18], 0), (520, [1e308] * 12, 0), (None, [1.0] * 12, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    whole = [(i, [int(np.floor(64 * c)) for c in v]) for i, v, _ in rows if i is not None and v is not None and all(c is not None and np.isfinite(64 * c) for c in v)]
    top = 2**63 - 1
    dot = lambda a, b: max(-top, min(top, sum(x * y for x, y in zip(a, b))))
    want = []
    for q, (i, v) in enumerate(whole):
        if i % 20 == 0:
            best = sorted((-dot(v, w), j) for c, (j, w) in enumerate(whole) if c != q)[:20]
            want += [(i, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    got = topk_search.top_products(table, table.vec_id % 20 == 0, k=20)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == sorted(want)


def test_large_components_are_exact():
    big = np.array([[2.0**40, 1.0], [2.0**40, 3.0], [2.0**40, 2.0]])
    (at, score), *_ = topk_search.best_products(big[:1], big, 2, np.array([0]), np.array([-np.inf]), np.array([0, 1, 2]))
    assert at.tolist() == [1, 2] and score.tolist() == [2**63 - 1] * 2
    rng = np.random.default_rng(3)
    for size in (20, 26, 30, 34):  # on both sides of what float64 and a long hold
        q, x = (np.floor(rng.normal(size=(n, 21)) * 2.0**size) for n in (4, 300))
        x[100:] = x[:200] + rng.integers(-1, 2, (200, 21))
        found = topk_search.best_products(q, x, 7, np.arange(4), np.full(4, -np.inf), np.arange(300))
        for i, (at, score) in enumerate(found):
            exact = [max(1 - 2**63, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(q[i], c)))) for c in x]
            best = sorted((j for j in range(300) if j != i), key=lambda j: (-exact[j], j))[:7]
            assert at.tolist() == best and score.tolist() == [exact[j] for j in best]
