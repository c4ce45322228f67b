"""Empty tables, null keys, ties and repeated runs of the generic operators."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import keys, refs, text, values
from weftline.operators import assertions, filters, graph, identity, profile, quality, ranked, reshape, resolve, retrieve
from weftline.operators.reshape import Field
from weftline.plans import build, fit, plugins
from weftline.sources import catalog, files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pick_ties_nulls_and_empty(spark):
    t = spark.createDataFrame([(1, 5.0, "b"), (1, 5.0, "a"), (None, None, "n"), (None, 2.0, "m")], "k int, c double, name string")
    assert rows(ranked.pick(t, ["k"], [-F.coalesce("c", F.lit(-1.0)), F.col("name")])) == [(1, 5.0, "a"), (None, 2.0, "m")]
    assert ranked.pick(t.where("false"), ["k"], [F.col("name")]).count() == 0


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "x", 0), (None, "n", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "y", 1), (1, "z", 2), (3, "w", 1)], "k int, v string, at int")
    once = ranked.upsert(old, new, ["k"], [-F.col("at")])
    assert rows(once) == [(1, "z", 2), (3, "w", 1), (None, "n", 0)]
    assert rows(ranked.upsert(once, new, ["k"], [-F.col("at")])) == rows(once)
    assert rows(ranked.insert_missing(old, new, ["k"], [-F.col("at")])) == [(1, "x", 0), (3, "w", 1), (None, "n", 0)]


def test_replace_scope_with_nothing_empties_it(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "s string, v int")
    assert rows(ranked.replace_scope(t, t.where("false"), {"s": "a"})) == [("b", 2), (None, 3)]
    assert rows(ranked.replace_scope(t, t.where("false"), {"s": None})) == [("a", 1), ("b", 2)]


def test_merge_confident_keeps_stored_on_ties(spark):
    old = spark.createDataFrame([("k", 0.5, "old"), ("m", None, "old")], "k string, confidence double, v string")
    new = spark.createDataFrame([("k", 0.5, "new"), ("m", 0.0, "new"), ("n", None, "new")], "k string, confidence double, v string")
    assert rows(ranked.merge_confident(old, new, ["k"])) == [("k", 0.5, "old"), ("m", 0.0, "new"), ("n", None, "new")]


def test_strip_takes_tabs(spark):
    t = spark.createDataFrame([("\t a b \n",), (None,), (" \t",)], "x string")
    assert rows(t.select(keys.strip(F.col("x")), keys.is_blank(F.col("x")))) == [("", True), ("a b", False), (None, True)]


def test_surrogate_id_is_the_first_60_bits_of_md5(spark):
    import hashlib

    want = int(hashlib.md5("s\x1ft\x1f7".encode()).hexdigest()[:15], 16)
    assert spark.range(7, 8).select(keys.surrogate_id(F.lit("s"), F.lit("t"), F.col("id"))).first()[0] == want


def test_typed_values(spark):
    t = spark.createDataFrame([("4.7",), (" 12 ",), ("NA",), ("x",), ("YES",), (None,)], "v string")
    got = rows(t.select("v", values.typed(F.col("v"), "bigint"), values.typed(F.col("v"), "double"), values.typed(F.col("v"), "boolean")))
    assert got == sorted([("4.7", 4, 4.7, False), (" 12 ", 12, 12.0, False), ("NA", None, None, None), ("x", None, None, False), ("YES", None, None, True), (None, None, None, None)], key=repr)


def test_table_key_joins_any_form(spark):
    t = spark.createDataFrame([("databricks://w/c/s/t/col",), ("unity://c.s.t",), ("databricks://w/c/s/t.col",), ("?",)], "r string")
    assert [r[0] for r in t.select(refs.table_key(F.col("r"))).collect()] == ["c.s.t", "c.s.t", "c.s.t", None]


def test_register_is_dense_and_stable(spark):
    first = spark.createDataFrame([("n", "b"), ("n", "a"), ("n", "a"), ("n", None)], "source_namespace string, source_key string")
    reg = identity.register(None, first, "r1")
    assert rows(reg.select("source_key", "entity_id")) == [("a", 1), ("b", 2)]
    more = identity.register(reg, first.unionAll(spark.createDataFrame([("n", "A"), ("m", "a")], first.schema)), "r2")
    assert rows(more.select("source_namespace", "source_key", "entity_id")) == [("m", "a", 3), ("n", "A", 4), ("n", "a", 1), ("n", "b", 2)]
    assert identity.register(None, first.where("false"), "r").count() == 0


def test_collapse_twice(spark):
    reg = spark.createDataFrame([("x", "k", 1), ("y", "k", 2), ("z", "k", 3), ("y", "o", 4)], "source_namespace string, source_key string, entity_id bigint")
    groups = spark.createDataFrame([("x", "g"), ("y", "g")], "source_namespace string, identity_namespace string")
    once = identity.remap(reg, identity.collapse_plan(reg, groups))
    assert rows(once) == [("x", "k", 1), ("y", "k", 1), ("y", "o", 4), ("z", "k", 3)]
    assert identity.collapse_plan(once, groups).count() == 0


def test_fk_closed_shape(spark):
    from weftline.plans import fit

    src = spark.createDataFrame([("S1", " P1", "A"), ("S2", "P2", "B"), ("S3", "P1\t", "Z"), ("S4", " ", "A"), ("S5", None, "A")], "row string, person string, code string")
    dec = spark.createDataFrame([("A", 10), ("B", 20), ("Z", None)], "code string, target_id bigint")
    made = fit.shape(src, None, dec, namespace="n", key="person", code="code", row_ref="row", schema="s", table="t", run_id="r")
    assert rows(made.child.select("source_row_ref", "concept_id", "source_key")) == [("S1", 10, "P1"), ("S2", 20, "P2"), ("S3", 0, "P1")]
    assert fit.closed(made) and made.parent.count() == 2 and made.missing.count() == 2


def test_orphans_count_null_keys(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "p int")
    assert quality.orphans(child, spark.createDataFrame([(1,)], "id int"), "p", "id").count() == 2


def test_resolve_reports_why(spark):
    concepts = spark.createDataFrame([("1", "V", "a", "D", "S", None), ("2", "V", "b", "D", None, None), ("3", "W", "t", "E", "S", None)], "concept_id string, vocabulary string, code string, domain string, standard string, invalid_reason string")
    rel = spark.createDataFrame([("2", "Maps to", "3")], "from_id string, relation string, to_id string")
    codes = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "code string")
    got = {r["code"]: (r["resolution"], r["target_id"], r["reason"]) for r in resolve.resolve(codes, concepts, rel, resolve.Policy("V", domain="D")).collect()}
    assert got["a"] == ("RESOLVED", 1, None) and got["b"][2].startswith("all standard targets") and "no such code" in got["c"][2] and len(got) == 3


def test_winners_prefer_status(spark):
    at = dt.datetime(2024, 1, 1)
    t = spark.createDataFrame([("k", 1, "human", 1.0, "auto", at), ("k", 2, "dbt", 0.1, "accepted", at), ("k", 3, "dbt", 0.9, "rejected", at), ("j", 4, "?", 0.1, "superseded", at)], "k string, id int, source string, confidence double, status string, at timestamp_ntz")
    assert [r["id"] for r in assertions.winner_by_standing(t, ["k"], "id").collect()] == [2]
    assert [r["id"] for r in assertions.winner_by_score(t, ["k"], "at", "id").collect()] == [2]


def test_ancestors_end_in_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    assert rows(graph.ancestors(e, 3)) == [("a", "a", 2), ("a", "b", 1), ("b", "a", 1), ("b", "b", 2)]


def test_projection_errors():
    with pytest.raises(ValueError, match="needs fields"):
        reshape.project(None, [])
    with pytest.raises(ValueError, match="neither"):
        Field("x").column()


def test_key_tiers(spark):
    child, parent = spark.createDataFrame([(1,), (2,), (None,)], "c int"), spark.createDataFrame([(1,), (2,), (2,)], "p int")
    r = profile.key_tier(profile.key_evidence(child, "c", parent, "p")).first()
    assert (r["n_child"], r["n_met"], r["n_parent"], r["n_parent_rows"], r["tier"]) == (2, 2, 2, 3, 1)
    r = profile.key_tier(profile.key_evidence(child.where("false"), "c", parent, "p")).first()
    assert (r["coverage"], r["tier"]) == (0.0, 3)


def test_nearest_skips_other_lengths(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0])], "id int, vector array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, query array<float>")
    assert rows(retrieve.nearest(q, v, 5)) == [(9, 1, 1.0, 1)]


def test_nearest_in_blocks(spark, monkeypatch):
    """Small blocks, ties by id, nulls; held against plain arithmetic."""
    monkeypatch.setattr(retrieve, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    x = [*rng.normal(size=(30, 3)).round(1).tolist(), [1.0, 2.0, 2.0], [2.0, 4.0, 4.0], None, [1.0]]
    v = spark.createDataFrame(list(enumerate(x)), "id int, vector array<double>")
    q = spark.createDataFrame([(f"q{i}", x[i]) for i in (0, 5, 30, 31, 32)], "query_id string, query array<double>")
    cos = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    want = []
    for i in (0, 5, 30, 31):
        best = sorted((-np.sign(c) * np.floor(abs(c) * 1e4 + 0.5) / 1e4, j) for j, w in enumerate(x) if w and len(w) == 3 for c in [cos(x[i], w)])[:4]
        want += [(f"q{i}", j, n + 1) for n, (_, j) in enumerate(best)]
    assert sorted((r["query_id"], r["id"], r["rank"]) for r in retrieve.nearest(q, v, 4).collect()) == sorted(want)


def test_profile_of_nothing_and_nulls(spark):
    t = spark.createDataFrame([(1, None), (1, "x"), (None, "x")], "`a b` int, s string")
    assert rows(profile.profile(t, "t")) == [("t", "a b", 3, 1, 1), ("t", "s", 3, 1, 1)]
    assert rows(profile.profile(t.where("false"), "t")) == [("t", "a b", 0, 0, 0), ("t", "s", 0, 0, 0)]
    assert "Expand" not in profile.profile(t, "t")._jdf.queryExecution().toString()


def test_declined_ties_go_to_review(spark):
    t = spark.createDataFrame([("a", "10"), ("a", "9"), ("b", "1"), ("c", "2"), ("c", "3")], "code string, concept_id string")
    choose = lambda pdf: pdf[pdf["concept_id"] == "10"]  # noqa: E731  declines c
    picked = plugins.break_ties(t, ["code"], choose)
    assert rows(picked) == [("a", "10"), ("b", "1")]
    assert rows(plugins.declined_ties(t, picked, ["code"])) == [("c", 2)]


def test_studies_of_one_shape():
    fit.require_uniform({})
    fit.require_uniform({"a": ("p", 1), "b": ("p", 1)})
    with pytest.raises(ValueError, match="than a: c"):
        fit.require_uniform({"a": ("p", 1), "b": ("p", 1), "c": ("p", 2)})


def test_described_and_stored_nodes(spark, tmp_path):
    t = spark.createDataFrame([], T.StructType([T.StructField("x", T.IntegerType(), True, {"comment": "an x", "tags": ["pii", "a"]}), T.StructField("y", T.StringType())]))
    assert rows(catalog.described(t)) == [("x", "int", "an x", ["a", "pii"]), ("y", "string", None, [])]
    nodes = spark.createDataFrame([("Term", "t"), ("Alias", "a")], "label string, name string")
    assert rows(catalog.of_label(nodes, "Term")) == [("Term", "t")]
    columns = spark.createDataFrame([("s", "b", "c", 1), ("s", "b", "d", 0), ("z", "b", "c", 0)], "schema string, table string, column string, position int")
    assert [r["column"] for r in catalog.of_schema(columns, "s").collect()] == ["d", "c"]
    p = tmp_path / "data_clinical_p.txt"
    p.write_text("#Id\tAge\n#the id\t \n#STRING\tNUMBER\nID\tAGE\n1\t2\n")
    assert rows(files.study_comments(spark, {"patient": str(p)})) == [("patient", "ID", "the id")]


def test_claims_without_a_scope_make_no_graph(spark):
    schema = "id int, subject string, predicate string, payload string, object string, source string, confidence double, status string"
    c = lambda *refs_: spark.createDataFrame([(i, r, "has_entity_name", '{"value": "E"}', None, "human", 1.0, "auto") for i, r in enumerate(refs_)], schema)
    with pytest.raises(ValueError, match="of several"):
        build.unified(c("databricks://w/c/s/t", "databricks://w/c/z/t"))
    with pytest.raises(ValueError, match="no schema"):
        build.unified(c("nothing"))
    made = build.unified(c("databricks://w/c/s/t", "nothing"))
    assert rows(made.entity_on_table) == [("E", "databricks://w/c/s/t", "s")] and made.aliases.count() == 0 and made.join_paths.count() == 0
    with pytest.raises(ValueError, match="one clause"):
        filters.row_predicate("AND", [])


def test_composed_names(spark):
    t = spark.createDataFrame([("  Café  bar ",), (None,), ("plain",)], "s string")
    assert [r[0] for r in t.select(text.canonical_name(F.col("s"))).collect()] == ["Café bar", None, "plain"]
