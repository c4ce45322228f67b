"""Words in many names at once, and names nearest by edits."""

import random

import numpy as np
import pytest

from weftline.operators import automaton, retrieve


def plain_words_in(words, names):
    return {(i, j) for i, n in enumerate(names) for j, w in enumerate(words) if w in n}


def utf8(names):
    raw = [n.encode() for n in names]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("seed", range(30))
def test_the_automaton_finds_what_a_scan_finds(seed):
    rng = random.Random(seed)
    text = lambda a, b: "".join(rng.choice("abé") for _ in range(rng.randint(a, b)))
    words, names = list({text(1, 5) for _ in range(rng.randint(0, 25))}), [text(0, 12) for _ in range(rng.randint(0, 15))]
    found = automaton.build(words).words_in(*utf8(names))
    assert set(zip(*(x.tolist() for x in found))) == plain_words_in(words, names) and len(found[0]) == len(plain_words_in(words, names))


def test_words_inside_words():
    words = ["a", "aa", "aaa", "aaaa", "baaa", "c"]
    names = ["aaaa", "baaab", "", "ccc", "b"]
    assert set(zip(*(x.tolist() for x in automaton.build(words).words_in(*utf8(names))))) == plain_words_in(words, names)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def seeds_of(spark, questions, nodes, k=None):
    q = spark.createDataFrame(questions, "question_id int, question string, token string")
    n = spark.createDataFrame(nodes, "label string, name string, confidence double, n_tokens int")
    return retrieve.lexical_seeds(q, n, k)


@pytest.mark.parametrize("block, pairs", [(100_000, 1 << 20), (1, 1), (2, 3)])
def test_seeds_nulls_ties_repeats_and_blocks(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(retrieve, "BLOCK_WORDS", block)
    monkeypatch.setattr(retrieve, "BLOCK_PAIRS", pairs)
    questions = [(1, "orders ORDERS order", "x"), (2, None, "x"), (None, "orders", "x"), (3, "the of", "x"), (4, "order straße", "x"), (1, "again: straße", "x"), (5, "", "x")]
    nodes = [("t", "Orders", 0.5, 0), ("t", "Orders", 0.5, 0), ("t", "Orders", 0.6, 0), ("c", "reorder_STRASSE", None, 0), ("c", "Hauptstraße", 0.1, 0), ("c", None, 0.1, 0), ("c", "", 0.1, 0)]
    got = seeds_of(spark, questions, nodes)
    assert rows(got.select("question_id", "label", "name", "confidence", "n_tokens")) == sorted([
        (1, "t", "Orders", 0.5, 2), (1, "t", "Orders", 0.6, 2), (1, "c", "reorder_STRASSE", None, 1), (1, "c", "Hauptstraße", 0.1, 1),
        (4, "t", "Orders", 0.5, 1), (4, "t", "Orders", 0.6, 1), (4, "c", "reorder_STRASSE", None, 1), (4, "c", "Hauptstraße", 0.1, 1),
    ], key=repr)
    assert rows(seeds_of(spark, questions, nodes, k=1).select("question_id", "name", "n_tokens")) == [(1, "Orders", 2), (4, "Hauptstraße", 1)]


def test_seeds_of_nothing(spark):
    assert seeds_of(spark, [], [("t", "orders", 0.5, 0)]).count() == 0
    assert seeds_of(spark, [(1, "orders", "x")], []).count() == 0
    assert seeds_of(spark, [], []).columns == ["question_id", "label", "name", "confidence", "n_tokens", "score", "match"]


def test_fifty_thousand_words(spark):
    words = [f"w{i:05d}x" for i in range(50_000)]
    q = [(i, " ".join(words[i * 500 : i * 500 + 500]), "x") for i in range(100)]
    nodes = [("n", f"a {words[i]} b {words[(i * 7 + 1) % 50_000]}", 0.5, i) for i in range(0, 50_000, 10)]
    got = {(r["question_id"], r["name"]): r["n_tokens"] for r in seeds_of(spark, q, nodes).collect()}
    want = {}
    for _, name, _, i in nodes:
        for j in (i, (i * 7 + 1) % 50_000):
            want[j // 500, name] = want.get((j // 500, name), 0) + 1
    assert got == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_nearest(wrong, known, k):
    out = []
    for w in set(wrong) - {None}:
        best = sorted((distance(w.lower(), n.lower()), n) for n in set(known) - {None})[:k]
        out += [(w, n, d, i + 1) for i, (d, n) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("indexed", [{1: 2000, 2: 62, 3: 23}, {1: 6, 2: 5}, {}])
def test_nearest_names(spark, monkeypatch, indexed):
    monkeypatch.setattr(retrieve, "INDEXED", indexed)
    monkeypatch.setattr(retrieve, "SLICE", 7)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abC") for _ in range(n))
    known = [text(rng.randrange(0, 9)) for _ in range(60)] + ["", None, "aaaa", "aaaa", "z" * 70, "AAAA"]
    wrong = [text(rng.randrange(0, 9)) for _ in range(25)] + ["", None, "aaaa", "aaaa", "z" * 69 + "y", "q" * 30]
    table = spark.createDataFrame([(n, "x") for n in known], "known string, key string")
    got = retrieve.suggestions(spark.createDataFrame([(w, 1) for w in wrong], "wrong string, distance int"), table, k=3)
    assert rows(got) == plain_nearest(wrong, known, 3)


def test_keys_of_names_are_made_by_many_tasks_and_no_further_for_few_words(spark, monkeypatch):
    """One small file of names is dealt out before it is taken apart, keys are never sent whole, and few words make no index by more deletions."""
    monkeypatch.setattr(retrieve, "TASK_NAMES", 50)
    made = {}
    cut = retrieve.Steps.cut
    monkeypatch.setattr(retrieve.Steps, "cut", lambda self, df, name: made.setdefault(name, df._jdf.queryExecution().executedPlan().toString()) and cut(self, df, name))
    known = spark.createDataFrame([(f"name {i:04d}",) for i in range(300)], "known string").coalesce(1)
    wrong = ["name 0000x", "nothing like it"]
    got = rows(retrieve.suggestions(wrong, known))
    assert "RoundRobinPartitioning(6)" in made["within_1"] and "Broadcast" not in made["within_1"] and "within_2" not in made
    monkeypatch.setattr(retrieve, "FEW_WORDS", 0)
    monkeypatch.setattr(retrieve, "SENT_WORDS", 0)
    assert rows(retrieve.suggestions(wrong, known)) == got == plain_nearest(wrong, [r["known"] for r in known.collect()], 3)
    assert "within_3" in made


def test_nearest_names_of_nothing_and_of_few(spark):
    none = spark.createDataFrame([], "known string")
    assert retrieve.suggestions(["a"], none).count() == 0
    few = spark.createDataFrame([("b",), ("abc",)], "known string")
    assert rows(retrieve.suggestions(["a"], few)) == [("a", "abc", 2, 2), ("a", "b", 1, 1)]
    assert retrieve.suggestions(few.where("false").withColumnRenamed("known", "wrong"), few).count() == 0


def test_near_names_meet_by_equality(spark):
    """No plan pairs all words with all names: words that have their names after a round of deletions go no further."""
    known = spark.createDataFrame([(f"name {i:05d}",) for i in range(3000)], "known string")
    got = retrieve.suggestions(["nome 00001", "name 0000"], known)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "Join Cross" not in plan and "Join Inner\n" not in plan
    assert [r["known"] for r in got.where("wrong = 'name 0000'").orderBy("n").collect()] == ["name 00000", "name 00001", "name 00002"]
