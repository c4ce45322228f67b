import datetime

import pytest
from pyspark.sql import functions as F

from weftline.sources import scoped, sinks
from weftline.sources.scoped import KeyedTable, ScopedTable, part_of
from weftline.streaming import events


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def of(spark, *r):
    return spark.createDataFrame(list(r), "s string, v int")


@pytest.fixture
def name(spark, request):
    name = "t_" + "".join(c if c.isalnum() else "_" for c in request.node.name.lower())
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_swap_leaves_all_other_scopes(spark, name):
    t = ScopedTable.create(of(spark), name, ["s"])
    for s in "abcd":
        t.swap(of(spark, (s, 1), (s, 2)), [(s,)])
    before = set(t.read().where("s <> 'b'").inputFiles())
    assert t.swap(of(spark, ("b", 7)), [("b",)]).n_written == 1
    assert set(t.read().where("s <> 'b'").inputFiles()) == before
    assert t.swap(of(spark), [("d",)]).n_written == 0
    assert rows(t.read().select("s", "v")) == [("a", 1), ("a", 2), ("b", 7), ("c", 1), ("c", 2)]
    assert t.vacuum() == 3 and t.vacuum() == 0  # the old b and d, and the empty one
    assert t.read().count() == 5


def test_write_scope_keeps_the_others(spark, name):
    for s in "abc":
        assert sinks.write_scope(spark, name, of(spark, (s, 1), (s, 2)), {"s": s}) == 2
    assert sinks.write_scope(spark, name, of(spark, ("b", 9), ("c", 4)), {"s": "b"}) == 1
    assert rows(spark.read.table(name).select("s", "v")) == [("a", 1), ("a", 2), ("b", 9), ("c", 1), ("c", 2)]


@pytest.mark.parametrize("steps", [0, 1, 2])
def test_a_swap_that_breaks_off_leaves_every_scope_whole(spark, name, steps):
    """0: the rows are written; 1: the first scope is pointed at them; 2: both are."""
    t = ScopedTable.create(of(spark), name, ["s"])
    t.swap(of(spark, ("a", 1), ("a", 2), ("b", 3)), [("a",), ("b",)])
    folder, _ = t.write(of(spark, ("a", 10), ("b", 30), ("b", 31)), [("a",), ("b",)])
    for i, s in list(enumerate("ab"))[:steps]:
        t.point(f"s = '{s}'", f"{folder}/_scope={i}")
    a = [("a", 10)] if steps else [("a", 1), ("a", 2)]
    b = [("b", 30), ("b", 31)] if steps == 2 else [("b", 3)]
    assert rows(t.read().select("s", "v")) == a + b
    t.swap(of(spark, ("a", 10), ("b", 30), ("b", 31)), [("a",), ("b",)])
    assert rows(t.read().select("s", "v")) == [("a", 10), ("b", 30), ("b", 31)]


def test_scopes_of_all_kinds(spark, name):
    like = spark.createDataFrame([], "v int, s string, n long, d date")
    t = ScopedTable.create(like, name, ["s", "n", "d"])
    day = datetime.date(2024, 2, 29)
    odd = [("it's \"so\"", 1, day), ("a/b=c%20 \\ü", -2, day), ("NULL", 3, day)]
    for i, s in enumerate(odd):
        t.swap(spark.createDataFrame([(i, *s), (i, *s)], like.schema), [s])
    t.swap(spark.createDataFrame([(9, *odd[1])], like.schema), [odd[1]])
    assert rows(t.read().select("v", "s", "n", "d")) == sorted([(0, *odd[0])] * 2 + [(9, *odd[1])] + [(2, *odd[2])] * 2, key=repr)
    assert t.rows_of(odd[:1]).count() == 2
    for bad in ("", None, 1.5):
        with pytest.raises(ValueError, match="a scope is"):
            t.swap(like, [(bad, 1, day)])


def test_rows_outside_are_counted_and_a_table_can_be_its_own_source(spark, name):
    t = ScopedTable.create(of(spark), name, ["s"])
    done = t.swap(of(spark, ("a", 1), (None, 2), ("b", 3), ("a", None)), [("a",)])
    assert (done.n_read, done.n_written, done.n_outside, done.scopes) == (4, 2, 2, 1)
    done = t.swap(t.read().withColumn("v", F.col("v") + 1), [("a",)])
    assert done.n_written == 2 and rows(t.read().select("v")) == [(2,), (None,)]
    assert t.swap(of(spark, ("a", 1)), []).n_written == 0 and t.read().count() == 2


def keyed(spark, name, n=400):
    start = spark.range(n).select("id", (F.col("id") % 7).cast("double").alias("confidence"), F.lit("old").alias("part"))
    t = KeyedTable(start, name, ["id"], parts=16, buckets=4)
    t.merge(start, [F.col("part")])
    return t


def test_a_merge_reads_and_writes_the_parts_of_its_keys_only(spark, name):
    t = keyed(spark, name)
    new = t.read().where(part_of(["id"], 16) == 3).limit(4).union(spark.createDataFrame([(None, 1.0, "lost")], t.read().schema)).withColumn("part", F.lit("new"))
    files = lambda: {f for f in t.table.read().inputFiles()}
    before = files()
    done = t.merge(new, [F.col("part")])
    assert done.scopes == 1 and len(before - files()) <= 4 and before & files()
    assert t.read().count() == 400 and t.read().where("part = 'new'").count() == 4
    again = rows(t.read())
    t.merge(new, [F.col("part")])
    t.merge(new.where("false"), [F.col("part")])
    assert rows(t.read()) == again


def test_the_stored_side_of_a_merge_is_not_shuffled(spark, name):
    t = keyed(spark, name)
    new = spark.range(5).select("id", F.lit(1.0).alias("confidence"), F.lit("x").alias("part"))
    plan = t.merged(new, F.lit(True), [0, 1])._jdf.queryExecution().executedPlan().toString()
    left, right = plan.split("SortMergeJoin")[1].split("FileScan")[0], plan.split("SortMergeJoin")[1]
    assert "Exchange" not in left and right.count("Exchange hashpartitioning") == 1, plan
    assert "PartitionFilters: [_part" in plan and "SelectedBucketsCount" in plan


def test_a_large_merge_is_dealt_into_as_many_tasks_as_its_rows_need(spark, name, monkeypatch):
    """No task joins or writes a whole bucket; each file still has rows of its bucket only, so small merges join them as they lie."""
    rows_a_file = lambda t: [r["count"] for r in t.table.read().groupBy(F.input_file_name()).count().collect()]
    first = spark.range(4000).select("id", F.lit(0.0).alias("confidence"), F.lit("old").alias("part"))
    monkeypatch.setattr(scoped, "TASK_ROWS", 100)
    t = KeyedTable(first, name, ["id"], parts=2, buckets=2)
    t.merge(first, [F.col("part")])
    assert t.read().count() == 4000 and max(rows_a_file(t)) < 100
    t.merge(first.where("id % 2 = 0").withColumn("part", F.lit("new")), [F.col("part")])
    t.delete(first.where("id % 4 = 0"))
    assert max(rows_a_file(t)) < 100
    monkeypatch.undo()
    t.merge(spark.createDataFrame([(1, 1.0, "last"), (4, 1.0, "last")], first.schema), [F.col("part")])
    assert t.touched(first)[1] == 2 and "Exchange hashpartitioning" not in t.read().groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert rows(t.read().groupBy("part").count()) == [("last", 2), ("new", 1000), ("old", 1999)]
    assert rows(t.read().where("id in (1, 4)").select("id", "part")) == [(1, "last"), (4, "last")]


def test_confident_merges_ties_repeats_and_nulls(spark, name):
    like = spark.createDataFrame([], "k string, old_k string, confidence double, part string")
    t = KeyedTable(like.drop("old_k"), name, ["k"], parts=4, buckets=2)
    row = lambda *r: spark.createDataFrame(list(r), "k string, confidence double, part string")
    t.merge_confident(row(("a", 0.5, "1"), ("b", None, "1"), ("c", 0.9, "1"), ("c", 0.9, "0"), (None, 1.0, "1")))
    t.merge_confident(row(("a", 0.5, "2"), ("b", 0.0, "2"), ("c", None, "2"), ("d", None, "2"), ("a", 0.4, "3")))
    assert rows(t.read().select("k", "confidence", "part")) == [("a", 0.5, "1"), ("b", 0.0, "2"), ("c", 0.9, "0"), ("d", None, "2")]
    t.delete(row(("a", 0.0, ""), ("nobody", 0.0, ""), (None, 0.0, "")))
    assert rows(t.read().select("k")) == [("b",), ("c",), ("d",)]


def test_one_late_event_replaces_one_part_of_a_full_table(spark, name, tmp_path):
    schema = "id int, status string, seq int"
    batches = [[(i, "auto", 1) for i in range(40)], [(7, "pinned", 2), (None, "lost", 9)], [(7, "late", 0), (41, "auto", 1)]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        events.follow_status(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), name, str(tmp_path / "cp"), buckets=8).awaitTermination()
        spark.catalog.refreshTable(name)
        assert spark.read.table(name).count() == (40, 40, 41)[n]
    assert rows(spark.read.table(name).where("id in (7, 41)").select("id", "status", "seq")) == [(41, "auto", 1), (7, "pinned", 2)]
