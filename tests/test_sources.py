import pytest
from pyspark.sql import functions as F

from weftline.sources import catalog, files, sinks
from weftline.streaming import events


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def test_tsv_leaves_ragged_rows_out(spark, tmp_path):
    p = write(tmp_path, "data_x.txt", '# note\nA\tB\n1\t"x\n\n2\n3\ty\tz\n4\t\r\n')
    assert rows(files.read_tsv(spark, p)) == [("1", '"x'), ("4", "")]
    assert files.malformed(spark, p).first()[0] == 2


def test_clinical_header(spark, tmp_path):
    p = write(tmp_path, "data_clinical_p.txt", "#Id\tAge\tAlive\n#the id\tyears\t\n#STRING\tNUMBER\tBOOLEAN\n#1\t1\t1\nID\tAGE\tALIVE\np1\t4.5\tyes\np2\tNA\tno\n")
    df = files.read_clinical(spark, p)
    assert df.dtypes == [("ID", "string"), ("AGE", "double"), ("ALIVE", "boolean")]
    assert df.schema["AGE"].metadata == {"comment": "years"} and df.schema["ALIVE"].metadata == {}
    assert rows(df) == [("p1", 4.5, True), ("p2", None, False)]


def test_mutations_rename_repeated_names(spark, tmp_path):
    p = write(tmp_path, "data_mutations.txt", "Start_Position\tComments\tcomments\n5.0\ta\tb\nx\tc\td\n")
    df = files.read_mutations(spark, p)
    assert df.columns == ["Start_Position", "Comments", "comments_2"] and rows(df) == [(5, "a", "b"), (None, "c", "d")]


def test_variants_and_segments(spark, tmp_path):
    p = write(tmp_path, "data_sv.txt", "Site1_Position\tName\n7\tn\n")
    assert rows(files.read_variants(spark, p)) == [(7, "n")]
    p = write(tmp_path, "a.seg", "ID\tchrom\tloc.start\tloc.end\tnum.mark\tseg.mean\ns\t1\t2\t3\t4\t-0.5\n")
    df = files.read_segments(spark, p)
    assert df.columns[0] == "sample_id" and rows(df) == [("s", "1", 2, 3, 4, -0.5)]


def test_matrices(spark, tmp_path):
    p = write(tmp_path, "data_cna.txt", "Hugo_Symbol\tEntrez_Gene_Id\tS-1\tS.2\nG\t1\t-2\t\n")
    assert rows(files.read_copy_numbers(spark, p)) == [("S-1", "G", "1", "-2"), ("S.2", "G", "1", None)]
    p = write(tmp_path, "data_gene_panel_matrix.txt", "SAMPLE_ID\tmutations\tcna\ns1\tP1\t \ns2\tP1\tP2\n")
    assert rows(files.read_gene_panels(spark, p)) == [("s1", "P1", "mutations"), ("s2", "P1", "mutations"), ("s2", "P2", "cna")]
    bad = write(tmp_path, "data_cna2.txt", "x\ty\n1\t2\n")
    with pytest.raises(ValueError, match="Hugo_Symbol"):
        files.read_copy_numbers(spark, bad)


def test_timelines_vocabulary_and_pointer(spark, tmp_path):
    p = write(tmp_path, "data_timeline_lab.txt", "TEST\tVALUE\tUNITS\na\t1.5\tu\n")
    assert dict(files.read_timeline(spark, p).dtypes)["VALUE"] == "double"
    p = write(tmp_path, "CONCEPT.csv", 'id\tname\n1\t"quoted\n')
    assert rows(files.read_vocabulary(spark, p)) == [("1", '"quoted')]
    p = write(tmp_path, "data_x.txt", "version https://git-lfs.github.com/spec/v1\noid sha256:0\n")
    with pytest.raises(ValueError, match="pointer"):
        files.read_tsv(spark, p)


def test_jsonl_ddl_and_names(spark, tmp_path):
    p = write(tmp_path, "gold.jsonl", '# c\n\n{"code": "A", "n": 3}\n')
    assert rows(files.read_jsonl(spark, p, "code string, n int")) == [("A", 3)]
    t = files.declared_tables("CREATE TABLE @x.person (person_id integer NOT NULL, born date, price numeric(10,2), note varchar(50), at timestamp with time zone, CONSTRAINT p PRIMARY KEY (person_id));")
    assert t["person"].simpleString() == "struct<person_id:int,born:date,price:double,note:string,at:timestamp>"
    assert files.wanted("data_clinical_patient.txt") and not files.wanted("data_expression_x.txt") and not files.wanted("readme.md")
    assert files.wanted("data_linear_cna_hg19.seg") and not files.wanted("Data_Clinical_patient.txt") and not files.wanted("data_rppa_x.txt")
    p = write(tmp_path, "long.txt", "".join(f"#note {i}\n\n" for i in range(200)) + "A\tB\n1\t2\n")
    assert rows(files.read_tsv(spark, p)) == [("1", "2")]
    with pytest.raises(ValueError, match="no line of names"):
        files.read_tsv(spark, write(tmp_path, "none.txt", "#a\n#b\n"))


def test_scoped_and_keyed_writes(spark):
    spark.sql("DROP TABLE IF EXISTS staged")
    t = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "s string, v int")
    assert sinks.write_scope(spark, "staged", t.where("s = 'a'"), {"s": "a"}) == 2
    assert sinks.write_scope(spark, "staged", t.where("s = 'b'"), {"s": "b"}) == 1
    assert sinks.write_scope(spark, "staged", t.where("false"), {"s": "a"}) == 0
    assert rows(spark.read.table("staged").select("s", "v")) == [("b", 3)]
    spark.sql("DROP TABLE IF EXISTS kept")
    for _ in range(2):
        sinks.write_once(spark, "kept", t, ["s"], [F.col("v")])
        sinks.write_upsert(spark, "upserted", t, ["s"], [-F.col("v")])
    assert rows(spark.read.table("kept")) == [("a", 1), ("b", 3)] and rows(spark.read.table("upserted")) == [("a", 2), ("b", 3)]
    sinks.write_table(spark, "noted", t, {"v": "a value"})
    assert "a value" in [c.description for c in spark.catalog.listColumns("noted")]
    assert catalog.tables(spark, "default", "note*") == ["noted"]


def test_status_log_as_a_stream(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS statuses")
    schema = "id int, status string, seq int"
    for n, batch in enumerate([[(1, "auto", 1), (2, "pinned", 5)], [(1, "accepted", 3), (1, "rejected", 2), (2, "auto", 4)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        events.follow_status(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), "statuses", str(tmp_path / "cp")).awaitTermination()
        spark.catalog.refreshTable("statuses")
        assert n or rows(spark.read.table("statuses").select("id", "status", "seq")) == [(1, "auto", 1), (2, "pinned", 5)]
    assert rows(spark.read.table("statuses").select("id", "status", "seq")) == [(1, "accepted", 3), (2, "pinned", 5)]


def test_a_batch_replaces_only_the_parts_of_its_ids(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS parted")
    schema = "id int, status string, seq int"
    files_of = lambda: set(spark.read.table("parted").inputFiles())
    seen = []
    for batch in ([(i, "auto", 1) for i in range(40)], [(7, "pinned", 2)], [(7, "late", 0), (41, "auto", 1)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        events.follow_status(spark.readStream.schema(schema).parquet(str(tmp_path / "log")), "parted", str(tmp_path / "cp"), buckets=8).awaitTermination()
        spark.catalog.refreshTable("parted")
        seen.append(files_of())
    assert len({f.rpartition("bucket=")[2].split("/")[0] for f in seen[0] - seen[1]}) == 1 and spark.read.table("parted").count() == 41
    assert rows(spark.read.table("parted").where("id = 7").select("status", "seq")) == [("pinned", 2)]


def test_a_broken_swap_keeps_the_table(spark):
    t = spark.createDataFrame([(1,)], "v int")
    for broken in range(4):
        for n in ("sw", "sw__next", "sw__before"):
            spark.sql(f"DROP TABLE IF EXISTS {n}")
        sinks.swap(spark, "sw", t)
        t.union(t).write.saveAsTable("sw__next")  # what a break leaves: a new table, then the old one put aside, then a new one in place
        if broken:
            spark.sql("ALTER TABLE sw RENAME TO sw__before")
        if broken == 2:
            spark.sql("ALTER TABLE sw__next RENAME TO sw")
        if broken == 3:
            spark.sql("DROP TABLE sw__next")
        assert sinks.stored(spark, "sw", t).count() == (2 if broken in (1, 2) else 1)
        assert catalog.tables(spark, "default", "sw*") == ["sw"]


def test_windowed_counts(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = events.windowed_counts(stream, late="1 hour").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = events.windowed_counts(source.drop("event_id")).select("start", "event_type", "n")
    assert rows(spark.table("counts").select("start", "event_type", "n")) == rows(want)


def test_windows_close_once_and_late_events_are_dropped(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    at = lambda day, hour: f"2024-01-{day:02d} {hour:02d}:00:00"
    log, out, cp = (str(tmp_path / x) for x in ("log", "out", "cp"))
    seen = []
    batches = [
        [(at(1, 5), "a", 1.0), (at(1, 6), "a", 2.0), (at(2, 12), "a", 4.0), (None, "a", 9.0)],  # the mark is at day 2, 11 h: day 1 closes
        [(at(1, 7), "a", 100.0), (at(2, 1), "b", 8.0)],  # day 1 is too late, day 2 is open
        [(at(4, 0), "c", 16.0)],  # closes day 2
        [(at(2, 2), "a", 100.0), (at(4, 1), None, 32.0)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, "ts string, event_type string, value double").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").parquet(log)
        counts = events.windowed_counts(spark.readStream.schema(schema).parquet(log), "1 day", "1 hour")
        q = events.follow_windows(counts, out, cp)
        q.awaitTermination()
        rows_in_state = [s["numRowsTotal"] for s in q.lastProgress["stateOperators"]] if q.lastProgress else []
        found = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(out)
        seen.append(sorted((r["start"].day, r["event_type"], r["n"], r["total"]) for r in found.collect()))
    assert seen[0] == [(1, "a", 2, 3.0)] and seen[1] == seen[0]
    assert seen[2] == [(1, "a", 2, 3.0), (2, "a", 1, 4.0), (2, "b", 1, 8.0)] and seen[3] == seen[2]
    assert rows_in_state == [2]  # only the open day is held: its two kinds of events


def test_changes_are_kept_by_spark_and_not_by_a_call_of_python_for_each_id(spark, tmp_path):
    schema = "id long, status string, seq long"
    log, out, cp = (str(tmp_path / x) for x in ("log", "out", "cp"))
    for shift in (0, 1000):
        spark.range(2000).selectExpr("id + %d as id" % shift, "'s' || id % 3 as status", "id as seq").write.mode("append").parquet(log)
        q = events.follow_changes(spark.readStream.schema(schema).parquet(log), out, cp)
        q.awaitTermination()
        operators = [s.operatorName for s in q.lastProgress.stateOperators]
        assert operators == ["stateStoreSave"], operators
    written = spark.read.schema(schema).parquet(out)
    assert written.count() == 3000 and events.newest(written).where("id >= 1000").agg({"seq": "sum"}).first()[0] == sum(range(1000, 2000)) + sum(range(1000, 2000))


def test_changes_by_state_are_those_of_the_batch(spark, tmp_path):
    schema = "id string, status string, seq long"
    batches = [[("a", "auto", 1), ("b", "pinned", 5), ("b", "other", 5), (None, "lost", 1), ("c", "x", None)], [("a", "accepted", 3), ("a", "rejected", 2), ("b", "auto", 4), ("a", None, 9)], [("a", "accepted", 3), ("b", "pinned", 5), ("d", "auto", 0)], [("d", "auto", 0)]]
    log, out, cp = (str(tmp_path / x) for x in ("log", "out", "cp"))
    written = []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(log)
        events.follow_changes(spark.readStream.schema(schema).parquet(log), out, cp).awaitTermination()
        written.append(spark.read.schema(schema).parquet(out).count())
    assert rows(events.newest(spark.read.schema(schema).parquet(out))) == [("a", None, 9), ("b", "other", 5), ("d", "auto", 0)]
    assert written == [2, 3, 4, 4]  # late and repeated events write nothing
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
