"""Matching, lifecycles, plug-ins and interpretation on small tables."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.operators import connect, identity, interpret, lifecycle, match
from weftline.plans import build, plugins
from weftline.sources import staging


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("small", [0, 100_000])
def test_closure(spark, monkeypatch, small):
    """In rounds, and by one task."""
    monkeypatch.setattr(connect, "SMALL", small)
    links = spark.createDataFrame([(3, 2), (2, 1), (1, 2), (7, 8), (9, 9), (20, 10), *((i, i + 1) for i in range(20, 60))], "a int, b int")
    got = dict(rows(match.closure(links)))
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, **{i: 10 for i in [10, *range(20, 61)]}}
    assert match.closure(links.where("false")).count() == 0


@pytest.mark.parametrize("small", [0, 100_000])
def test_closure_of_a_shuffled_chain(spark, monkeypatch, small):
    monkeypatch.setattr(connect, "SMALL", small)
    ids = random.Random(3).sample(range(10_000), 400)
    links = spark.createDataFrame([*zip(ids, ids[1:]), (20_000, 20_001), (20_001, 20_002), (20_002, 20_000)], "a int, b int")
    assert dict(rows(match.closure(links))) == {**dict.fromkeys(ids, min(ids)), **dict.fromkeys(range(20_000, 20_003), 20_000)}
    named = spark.createDataFrame([("c", "b"), ("d", "c"), ("a", "d"), (None, "a"), ("x", "x")], "a string, b string")
    assert dict(rows(match.closure(named))) == dict.fromkeys("abcd", "a")


def test_blocks_skip_nulls_and_link_equal_texts_once(spark):
    t = spark.createDataFrame([(1, "b", "Anna"), (2, "b", "anna"), (3, "b", "anne"), (4, None, "anna"), (5, "b", None), (6, "c", "anna")], "id int, k string, name string")
    assert rows(match.by_score(t, "id", F.col("k"), "name", 0.7)) == [(1, 2, 1.0), (1, 3, 0.75)]


def test_fuzzy_pairs_are_those_of_brute_force(spark):
    rng = random.Random(5)
    texts = ["", "a", "b", "ab", "abc", "aaaa", "aaaaa", "ünï", *("".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(120))]
    t = spark.createDataFrame([(i, i % 2, x) for i, x in enumerate(texts)], "id int, k int, name string")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for least in (0.5, 0.7, 0.85):
        first = {}
        for i, x in enumerate(texts):
            first.setdefault((i % 2, x), i)
        want = {(first[i % 2, x], i) for i, x in enumerate(texts) if first[i % 2, x] != i}
        heads = [(k, x, i) for (k, x), i in first.items()]
        want |= {(min(i, j), max(i, j)) for k, x, i in heads for m, y, j in heads if k == m and i < j and 1 - edits(x, y) / max(len(x), len(y), 1) >= least - 1e-12 and max(len(x), len(y))}
        assert {(r["a"], r["b"]) for r in match.by_score(t, "id", F.col("k"), "name", least).collect()} == want


def test_digests_ignore_order(spark):
    a = spark.createDataFrame([("k", 1, None), ("k", 2, "x")], "k string, n int, v string")
    one = lifecycle.snapshot_digest(a, ["k"], ["n", "v"]).first()["digest"]
    assert lifecycle.snapshot_digest(a.orderBy(F.desc("n")), ["k"], ["v", "n"]).first()["digest"] == one
    assert lifecycle.snapshot_digest(a.where("n = 1"), ["k"], ["n", "v"]).first()["digest"] != one
    cards = spark.createDataFrame([("e", "1", "m"), ("f", "2", "m"), ("g", "7", "n")], "entity string, version string, model string")
    got = dict(rows(lifecycle.card_version(cards, ["model"])))
    assert got["n"] == "7" and len(got["m"]) == 64


def test_scopes_and_fields(spark):
    claims = spark.createDataFrame([("t", "s"), ("t", "s"), ("u", "a"), ("u", "b"), ("v", None)], "table string, source_schema string")
    assert rows(lifecycle.scope_of_table(claims)) == [("t", "s", 1), ("u", "a", 2), ("v", None, 0)]
    ob = spark.createDataFrame([("e", ["id", "name"])], "entity string, required array<string>")
    assert rows(lifecycle.missing_fields(ob, spark.createDataFrame([("e", "id")], "entity string, field string"))) == [("e", "name")]
    edges = spark.createDataFrame([(1, 2)], "`from` int, `to` int")
    assert rows(lifecycle.flipped(edges)) == [(2, 1)]


def test_report_of_nothing(spark):
    none = spark.createDataFrame([], "status string, partial boolean, failed_stage string, skip_reason string, n_entities int, n_properties int, n_terms int")
    assert tuple(interpret.run_report(none).first()) == (0,) * 9 + (None,)
    assert interpret.telemetry(spark.createDataFrame([], "outcome string, coverage double, latency_ms int, retries int, tokens_in int, tokens_out int")).first()["avg_coverage"] == 0.0


def test_nested_documents_and_texts(spark):
    c = spark.createDataFrame([("t", 1, "b", "int", None), ("t", 0, "a", "int", "x")], "table string, position int, column string, type string, comment string")
    assert [x["column"] for x in interpret.table_documents(c).first()["columns"]] == ["a", "b"]
    n = spark.createDataFrame([("entity", "E", "told", None), ("entity", "E", " ", None), ("term", None, "d", "C1"), ("alias", "al", "d", None)], "label string, name string, description string, code string")
    assert [r[0] for r in n.select(interpret.embedding_text(*(F.col(x) for x in n.columns))).collect()] == ["E - told", "E", "C1", "al"]


def test_plugins(spark):
    nodes = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(10)], "id int, text string")
    sizes = []

    def embed(texts):
        sizes.append(len(texts))
        assert len(texts) <= 4
        return plugins.hashed_embedder(8)(texts)

    got = {r["id"]: r["embedding"] for r in plugins.embed_nodes(nodes.coalesce(1), embed, batch=4).collect()}
    assert got[3] is None and len(got[1]) == 8 and abs(sum(x * x for x in got[1]) - 1) < 1e-5
    ties = spark.createDataFrame([("a", "10"), ("a", "9"), ("b", "1")], "code string, concept_id string")
    assert rows(plugins.break_ties(ties, ["code"])) == [("a", "9"), ("b", "1")]
    last = lambda pdf: pdf.sort_values("concept_id").head(1)
    assert rows(plugins.break_ties(ties, ["code"], last)) == [("a", "10"), ("b", "1")]
    registry = plugins.Registry()
    registry.register("x")(lambda: 5)
    assert registry.make("x") == 5
    with pytest.raises(ValueError, match="already"):
        registry.register("x")(lambda: 6)
    with pytest.raises(KeyError, match="known"):
        registry.make("y")
    assert plugins.Runtime(spark).execute("select 1 as x").first()["x"] == 1


def test_build_a_graph(spark):
    cols = spark.createDataFrame([("s", "orders", "id", "bigint", 0, None), ("s", "orders", "customer_id", "bigint", 1, None), ("s", "customer", "id", "bigint", 0, "the id")], "schema string, table string, column string, type string, position int, comment string")
    evidence = spark.createDataFrame([("orders", "customer_id", "customer", "id", 10, 9, 10, 10)], "child_table string, child_column string, parent_table string, parent_column string, n_child long, n_met long, n_parent long, n_parent_rows long")
    joins = build.join_claims(cols, evidence)
    assert joins.select("tier", "confidence").first() == (1, 0.95)
    g = build.materialise(cols, joins)
    assert (g.tables.count(), g.columns.count(), g.has_column.count(), g.joins.count()) == (2, 3, 3, 1) and build.orphans(g).count() == 0


def test_closure_of_a_large_star(spark, monkeypatch):
    """Dealt out in parts, a star's centre is many keys; the result is the same."""
    monkeypatch.setattr(connect, "ARCS", 40)
    monkeypatch.setattr(connect, "SMALL", 0)
    links = spark.createDataFrame([*((0, i) for i in range(1, 300)), *((i, i + 1) for i in range(1000, 1040)), (299, 1040), (5000, 5001)], "a int, b int")
    want = dict.fromkeys([*range(300), *range(1000, 1041)], 0) | {5000: 5000, 5001: 5000}
    assert dict(rows(match.closure(links))) == want


def test_closure_that_does_not_settle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(connect, "MOST_ROUNDS", 1)
    monkeypatch.setattr(connect, "SMALL", 0)
    with pytest.raises(RuntimeError, match="not settled"):
        match.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5)], "a int, b int"))


def test_ids_do_not_depend_on_what_spark_reuses(spark):
    keys = spark.range(200_000).select(F.lit("ns").alias("source_namespace"), F.sha2(F.col("id").cast("string"), 256).alias("source_key"))
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            got = identity.register(None, keys, "r")
            assert tuple(got.agg(F.min("entity_id"), F.max("entity_id"), F.countDistinct("entity_id"), F.count("*")).first()) == (1, 200_000, 200_000, 200_000)
            assert got.orderBy("source_key").where("entity_id = 1").first()["source_key"] == got.agg(F.min("source_key")).first()[0]
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")


def test_steps_leave_only_what_the_result_reads(spark):
    steps = staging.Steps(spark)
    kept, other = (steps.cut(spark.range(3).toDF("x"), n) for n in ("kept", "other"))
    path = other.inputFiles()[0].removeprefix("file://")
    steps.finish(kept)
    assert kept.count() == 3 and not Path(path).parent.exists()
