"""Plan objects in versions, digests of signatures, ends of edges and guarded stages."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import keys
from weftline.operators import filters, targets
from weftline.sources import objects


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def name(spark, request):
    name = "o_" + "".join(c if c.isalnum() else "_" for c in request.node.name.lower())
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def of(spark, *r):
    return spark.createDataFrame(list(r), "kind string, id string, json string")


def plain(kind, text):
    def canon(v):
        return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)

    v = json.loads(text)
    if not isinstance(v, dict):
        return canon(v)
    parts = []
    for k in sorted(v):
        free = isinstance(v[k], list) and k in objects.SETS.get(kind, [])
        parts.append(canon(k) + ":" + ("[" + ",".join(sorted(map(canon, v[k]))) + "]" if free else canon(v[k])))
    return "{" + ",".join(parts) + "}"


TEXTS = ['{"b":1,"a":{"z":[2,1],"y":null}}', '{"risks":["b","a",{"n":1,"m":2}],"steps":[3,10,2],"x":[3,10,2]}', "{}", "[2,1]", '"text"', "null", '{"a \\"q\\"":"it\'s","é":"ü"}', '{"steps":"none","risks":[]}']


def test_canonical_texts(spark):
    made = of(spark, *((k, str(i), t) for i, t in enumerate(TEXTS) for k in ("plan", "pin")))
    got = made.withColumn("c", objects.canonical(F.col("kind"), F.parse_json("json"))).collect()
    assert [r["c"] for r in got] == [plain(r["kind"], r["json"]) for r in got]


def test_texts_are_parsed_once_each_and_away_from_the_files_they_come_in(spark, name, tmp_path, monkeypatch):
    """A source of one file does not make one task parse all, and a repeated text is parsed once."""
    parse, counted = F.try_parse_json, spark.sparkContext.accumulator(0)
    once = F.udf(lambda t: counted.add(1) or t).asNondeterministic()
    monkeypatch.setattr(objects.F, "try_parse_json", lambda c: parse(once(c)))
    objects.persist(spark, name, of(spark, *(("pin", str(i), '{"n":1}') for i in range(50) for _ in range(4))).coalesce(1), str(tmp_path / "t"))
    assert objects.read(spark, name).count() == 50 and counted.value == 50


def test_versions_of_all_kinds(spark, name, tmp_path):
    rng = random.Random(1)
    first = [(k, f"{i}", json.dumps({"n": i, "list": [2, 1], "deep": {"a": 1, "b": [i]}})) for k in objects.KINDS for i in range(5)]

    def shuffled(t):
        items = list(json.loads(t).items())
        rng.shuffle(items)
        return json.dumps(dict(items), indent=1)

    objects.persist(spark, name, of(spark, *first, ("pin", None, "{}"), ("unknown", "1", "{}"), ("pin", "bad", "{no"), ("pin", "none", None)), str(tmp_path / "t"))
    objects.persist(spark, name, of(spark, *((k, i, shuffled(t)) for k, i, t in first)))
    assert objects.read(spark, name).count() == 35
    objects.persist(spark, name, of(spark, ("pin", "3", '{"n":30}'), ("pin", "3", '{"n":30}'), ("plan", "new", '{"steps":[2,1]}')))
    objects.persist(spark, name, of(spark, ("pin", "3", '{"n":30}'), ("plan", "new", '{"steps":[1,2]}')))
    objects.persist(spark, name, of(spark))
    assert objects.read(spark, name).count() == 37
    last = objects.current(objects.read(spark, name))
    assert last.count() == 36 and rows(last.where("kind = 'pin' and id = '3'").select("version")) == [(2,)]
    assert rows(objects.typed(last, "pin", "n int, deep string").where("id in ('3', '4')").select("id", "version", "n")) == [("3", 2, 30), ("4", 1, 4)]
    assert rows(last.where(F.try_variant_get("payload", "$.n", "int") == 30).select("kind")) == [("pin",)]
    for r in last.where("kind = 'risk'").select("digest", F.to_json("payload").alias("t")).collect():
        assert r["digest"] == hashlib.sha256(plain("risk", r["t"]).encode()).hexdigest()


def test_signatures_and_cache_keys(spark):
    t = spark.createDataFrame([('{"b":[1,{"d":1,"c":2}],"a":"x"}', '{"a":"x","b":[1,{"c":2,"d":1}]}'), ("{no", None)], "x string, y string")
    a, b = t.select(keys.profile_hash(F.col("x")), keys.profile_hash(F.col("y"))).collect()
    assert a[0] == a[1] == hashlib.sha256(b'{"a":"x","b":[1,{"c":2,"d":1}]}').hexdigest() and tuple(b) == (None, None)
    prefix = hashlib.sha256(b"p").hexdigest()
    got = spark.range(1).select(keys.cache_key(F.lit("p"), F.lit("v"), F.lit(None), F.lit(3)), keys.leaks(F.lit("p of r"), F.lit("r")), keys.leaks(F.lit("p"), F.lit("r")), keys.leaks(F.lit("p"), F.lit("")), keys.leaks(F.lit("p"), F.lit(None).cast("string"))).first()
    assert tuple(got) == (hashlib.sha256(f"{prefix}|v||3".encode()).hexdigest(), True, False, True, True)


def test_a_parameter_that_is_not_set_filters_nothing(spark):
    t = spark.createDataFrame([(1, "x"), (2, None), (1, "y")], "a int, b string")
    assert filters.optional(t, {"a": None, "b": None}).count() == 3 and filters.optional(t, {}).count() == 3
    assert rows(filters.optional(t, {"a": 1, "b": None})) == [(1, "x"), (1, "y")] and rows(filters.optional(t, {"a": 1, "b": "y"})) == [(1, "y")]
    assert "isnotnull" not in filters.optional(t, {"a": None})._jdf.queryExecution().optimizedPlan().toString()


def test_ends_of_edges_are_properties(spark):
    declared = spark.createDataFrame([("e", "b", "int", True), ("e", "b", "int", True), ("e", "subject", "string", False), ("f", "a", None, None)], "entity string, name string, type string, nullable boolean")
    ends = spark.createDataFrame([("e", "subject", "x", "one", False), ("e", "object", "y", "many", True), ("g", None, "y", "one", True)], "entity string, role string, target string, cardinality string, nullable boolean")
    assert rows(targets.properties(declared, ends).select("entity", "place", "name", "kind", "target")) == [
        ("e", 1, "b", "DECLARED", None), ("e", 2, "object", "ENDPOINT", "y"), ("e", 3, "subject", "ENDPOINT", "x"), ("e", 4, "subject", "DECLARED", None), ("f", 1, "a", "DECLARED", None),
    ]
    assert rows(targets.properties(declared.where("false"), ends.where("false"))) == []


def stages(spark, *r):
    return spark.createDataFrame(list(r), "stage string, own string")


def needs(spark, *r):
    return spark.createDataFrame(list(r), "stage string, needed string")


def test_a_change_runs_what_comes_after_it(spark):
    own = [("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5"), ("e", "5"), (None, "6")]
    order = needs(spark, ("b", "a"), ("c", "b"), ("c", "b"), ("d", "b"), ("d", "e"), (None, "a"), ("a", None))
    before = targets.chained(stages(spark, *own), order)
    assert before.count() == 5
    state = lambda now: dict(map(tuple, targets.stages_to_run(now, before).collect()))
    assert set(state(before).values()) == {"skip"}
    changed = targets.chained(stages(spark, *(("b", "changed") if s == "b" else (s, o) for s, o in own), ("new", "7")), order)
    assert state(changed) == {"a": "skip", "b": "run", "c": "run", "d": "run", "e": "skip", "new": "run"}
    fewer = targets.chained(stages(spark, ("a", "1"), ("e", "5")), needs(spark))
    assert state(fewer) == {"a": "skip", "e": "skip", "b": "drop", "c": "drop", "d": "drop"}
    assert targets.chained(stages(spark), needs(spark)).count() == 0
    for bad in ([("a", "a")], [("a", "b"), ("b", "a")], [("a", "nowhere")]):
        with pytest.raises(ValueError, match="circle"):
            targets.chained(stages(spark, *own), needs(spark, *bad))


def test_digests_of_contents(spark):
    r = [("s", 1, None), ("s", 2, "x"), ("s", 2, "x"), ("t", 1, None), (None, 1, "x")]
    table = lambda some, n=1: spark.createDataFrame(some, "stage string, a int, b string").repartition(n)
    one = dict(map(tuple, targets.content_digests(table(r), "stage").collect()))
    assert one == dict(map(tuple, targets.content_digests(table(r[::-1], 3), "stage").collect())) and len(set(one.values())) == 3
    assert one["s"] != targets.content_digests(table(r[:2]), "stage").first()["own"]
