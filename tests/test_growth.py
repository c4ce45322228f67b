"""Profiles by merged sketches, writes that account for themselves, and a stored graph."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import profile, sketches
from weftline.sources import accounts
from weftline.sources.graphs import StoredGraph
from weftline.sources.scoped import ScopedTable


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def name(spark, request):
    name = "g_" + "".join(c if c.isalnum() else "_" for c in request.node.name.lower())
    drop = lambda: [spark.sql(f"DROP TABLE IF EXISTS {name}{end}") for end in ("", "_nodes", "_edges")]
    drop()
    yield name
    drop()


def lines(spark, n=20_000):
    i = F.col("id")
    return spark.range(n).select(i.alias("key"), (i % 977).alias("some"), F.when(i % 3 > 0, i % 5).alias("holes"), F.lit(None).cast("string").alias("empty"), F.concat(F.lit("v"), (F.floor(F.sqrt("id"))).cast("string")).alias("column"))


def test_arrivals_are_one_profile(spark, name, tmp_path):
    t = lines(spark)
    kept = sketches.Profiles(t, name, str(tmp_path / "p"))
    for part in (0, 1, 2, 3, 2):  # one arrives twice
        kept.arrive(t.where(F.col("key") % 4 == part), "lines", f"part {part}")
    once = sketches.merged(sketches.sketch(t, "lines", "all"))
    facts = ["table", "column", "n_rows", "n_nulls", "n_distinct"]
    assert rows(kept.profile().select(facts)) == rows(once.select(facts))
    exact = {r["column"]: r["n_distinct"] for r in profile.profile(t, "lines").collect()}
    for r in kept.profile().collect():
        assert abs(r["n_distinct"] - exact[r["column"]]) <= max(1, exact[r["column"]] * sketches.distinct_error()), r
    kept.arrive(t.where("false"), "lines", "part 2")
    assert {r["n_rows"] for r in kept.profile().collect()} == {15_000}


@pytest.mark.parametrize("column, k", [("some", 5), ("holes", 2), ("holes", 9), ("empty", 3), ("column", 4), ("key", 3)])
def test_top_values_are_exact(spark, column, k):
    t = lines(spark)
    made = sketches.sketch(t.where("key % 2 = 0"), "lines", "a").unionByName(sketches.sketch(t.where("key % 2 = 1"), "lines", "b"))
    want = profile.top_values(t.where(F.col(column).isNotNull()), column, k)
    assert rows(sketches.top_values(t, made, "lines", column, k)) == rows(want)
    assert rows(sketches.top_values(t, made.where("false"), "lines", column, k)) == rows(want)  # no sketches yet


def orders(spark):
    made = [("1", "a", "RESOLVED", 1), (" ", "a", "RESOLVED", 2), (None, "a", "NO_MAP", 3), ("4", "a", "NO_MAP", None), ("5", "b", "RESOLVED", None), ("6", "b", "NO_MAP", 6), ("1", "a", "RESOLVED", 1)]
    return spark.createDataFrame(made, "k string, scope string, resolution string, target_id int")


def staged(df):
    return df.where("trim(coalesce(k, '')) <> ''")


def test_a_write_accounts_for_itself_in_one_pass(spark, name, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    source = orders(spark).coalesce(1)
    source = source.mapInArrow(counted, source.schema)
    t = ScopedTable.create(orders(spark), name, ["scope"], path=str(tmp_path / "t"))
    got = accounts.staged_swap(t, source, staged, [("a",), ("b",)], key="k")
    assert read.value == 7  # the source was read once
    assert got == accounts.Account(7, 2, 5, 2, 2, 1, 1)
    assert not got.passed and t.read().count() == 5


def test_good_and_short_writes(spark, name, tmp_path):
    t = ScopedTable.create(orders(spark), name, ["scope"], path=str(tmp_path / "t"))
    good = orders(spark).where("k in ('1', '4') or k is null or k = ' '")
    got = accounts.staged_swap(t, good, staged, [("a",), ("b",)], key="k")
    assert got == accounts.Account(5, 2, 3, 1, 1, 0, 0) and got.passed and not got.recounted
    short = accounts.staged_swap(t, good, lambda df: staged(df).where("k <> '4'"), [("a",)], key="k")
    assert not short.passed and short.recounted and short.written_rows == 2
    outside = accounts.staged_swap(t, good, staged, [("b",)], key="k")
    assert not outside.passed and outside.written_rows == 0
    nothing = accounts.staged_swap(t, good.where("false"), staged, [("a",)], key="k")
    assert nothing.passed and nothing.source_rows == 0 and t.read().count() == 0
    assert accounts.as_row(nothing, good).columns[-1] == "passed"


NODES = [("Entity", "e1"), ("Entity", "e2"), ("Entity", "lonely"), ("Property", "p"), ("Alias", "a1"), ("Alias", "a2"), ("Alias", "stray"), ("Table", "s1.t"), ("Table", "s2.t"), ("Table", "s2.u"), ("Column", "s1.t.c"), ("Column", "s2.t.c"), ("Term", "x"), ("Term", "y")]
EDGES = [
    ("entity_on_table", "Entity", "e1", "Table", "s1.t", "s1"), ("entity_on_table", "Entity", "e1", "Table", "s2.t", "s2"), ("entity_on_table", "Entity", "e2", "Table", "s1.t", "s1"), ("property_on_column", "Property", "p", "Column", "s2.t.c", "s2"),
    ("refers_to", "Alias", "a1", "Entity", "e1", "s2"), ("refers_to", "Alias", "a2", "Entity", "e2", "s1"), ("provenance", "Assertion", "1@s1.t.c", "Column", "s1.t.c", "s1"), ("provenance", "Assertion", "2@s2.t", "Table", "s2.t", "s2"),
    ("provenance", "Assertion", "3@s2.u", "Table", "s2.u", "s2"), ("parent_of", "Term", "x", "Term", "y", None), ("parent_of", "Term", "x", "Term", "y", None),
]


def graph(spark, name, path):
    owned = [("Assertion", "1@s1.t.c", "s1", 0.5), ("Assertion", "2@s2.t", "s2", 0.5), ("Assertion", "3@s2.u", "s2", 0.5), ("JoinPath", "j", "s1", 0.5)]
    nodes = spark.createDataFrame([(label, k, None, 0.5) for label, k in NODES] + owned, "label string, key string, source_schema string, confidence double")
    edges = spark.createDataFrame(EDGES, "kind string, from_label string, from string, to_label string, to string, source_schema string")
    g = StoredGraph(spark, name, path=str(path), parts=3, buckets=2)
    g.add(nodes, edges)
    g.add(nodes, edges)  # again: the same
    return g


def keys(g):
    return {(r["label"], r["key"]) for r in g.nodes.read().collect()}


def test_a_study_is_deleted(spark, name, tmp_path):
    g = graph(spark, name, tmp_path / "g")
    assert g.read_edges().count() == len(set(EDGES)) and len(keys(g)) == len(NODES) + 4
    others = set(g.edges.read().where("scope <> 'of s1'").inputFiles())
    g.delete_schema("s1")
    assert {r[0] for r in g.read_edges().select("source_schema").distinct().collect()} == {"s2", None}
    assert set(g.edges.read().inputFiles()) == others  # no other study's edges are written
    gone = {("Entity", "e2"), ("Entity", "lonely"), ("Alias", "a2"), ("Alias", "stray"), ("Assertion", "1@s1.t.c"), ("JoinPath", "j")}
    left = keys(g)
    assert left == ({*NODES} | {("Assertion", "2@s2.t"), ("Assertion", "3@s2.u")}) - gone
    g.sweep()
    g.delete_schema("no such study")
    assert keys(g) == left


def test_a_table_is_deleted(spark, name, tmp_path):
    g = graph(spark, name, tmp_path / "g")
    g.delete_table("s2", "t")
    left = keys(g)
    assert not {("Table", "s2.t"), ("Column", "s2.t.c"), ("Assertion", "2@s2.t"), ("Property", "p")} & left
    assert {("Table", "s2.u"), ("Assertion", "3@s2.u"), ("Entity", "e1"), ("Alias", "a1"), ("Table", "s1.t")} <= left
    assert {(r["from"], r["to"]) for r in g.read_edges().where("source_schema = 's2'").collect()} == {("a1", "e1"), ("3@s2.u", "s2.u")}


def test_claims_are_kept_on_demand(spark, name, tmp_path):
    g = graph(spark, name, tmp_path / "g")
    g.delete_schema("s1", keep_claims=True)
    g.delete_table("s2", "t", keep_claims=True)
    assert {k for k in keys(g) if k[0] == "Assertion"} == {("Assertion", "1@s1.t.c"), ("Assertion", "2@s2.t"), ("Assertion", "3@s2.u")}
