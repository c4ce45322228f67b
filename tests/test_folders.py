"""Whole study folders in one scan."""

import pytest

from weftline.queries import studies
from weftline.sources import files, folders


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(root, name, text):
    p = root / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(text.encode())
    return p


CLINICAL = {
    "a/data_clinical_patient.txt": "#Id\tAge\n#the id\tyears\n#STRING\tNUMBER\n#1\t1\nID\tAGE\np1\t4.5\np2\tNA\n\np3\n",
    "b/data_clinical_patient.txt": "#Age\tId\tAlive\r\n#years lived\t\tstill\r\n#NUMBER\tSTRING\tBOOLEAN\r\nAGE\tID\tALIVE\r\n7\tp9\tyes\r\n# a late note\r\n8\tp8\tno\tmore\r\n",
    "c/data_clinical_patient.txt": "ID\tAGE\nx\told\n",
    "d/data_clinical_patient.txt": "version https://git-lfs.github.com/spec/v1\noid sha256:0\n",
    "e/data_clinical_patient.txt": "#only\n#comments\n",
    "f/data_clinical_patient.txt": "",
}


def name_of(file):
    return file.rsplit("/", 2)[-2]


def test_each_file_by_its_own_header(spark, tmp_path):
    for name, text in CLINICAL.items():
        write(tmp_path, name, text)
    two = folders.read_files(spark, [str(tmp_path / x) for x in "abdef"], "clinical")
    assert [f for f in two.dtypes if f[0] != "source_file"] == [("ID", "string"), ("AGE", "double"), ("ALIVE", "boolean")]
    assert two.schema["AGE"].metadata == {"comment": "years"} and two.schema["ALIVE"].metadata == {"comment": "still"}
    assert sorted((*tuple(r)[:3], name_of(r[3])) for r in two.collect()) == [("p1", 4.5, None, "a"), ("p2", None, None, "a"), ("p9", 7.0, True, "b")]
    all_ = folders.read_files(spark, [str(tmp_path)], "clinical")
    assert dict(all_.dtypes)["AGE"] == "string"  # one file does not say that it is a number
    assert rows(all_.where("ID = 'x'").select("AGE", "ALIVE")) == [("old", None)]
    found = {name_of(r[0]): (r[1], r[2]) for r in folders.malformed(spark, [str(tmp_path)]).collect()}
    assert found == {"a": (2, 1), "b": (1, 1), "c": (1, 0)}
    told = sorted((name_of(r[0]), r[1], r[2]) for r in folders.comments(spark, [str(tmp_path)]).collect())
    assert told == [("a", "AGE", "years"), ("a", "ID", "the id"), ("b", "AGE", "years lived"), ("b", "ALIVE", "still")]
    assert [name_of(r["file"]) for r in folders.heads(spark, [str(tmp_path)]).where("pointer").collect()] == ["d"]


def test_one_scan_of_all_files(spark, tmp_path):
    for i in range(12):
        write(tmp_path, f"s{i}/data_mutations.txt", ("Gene\tStart_Position\n" if i % 2 else "Start_Position\tgene\tGene\n") + (f"g{i}\t{i}.0\n" if i % 2 else f"x\tlow\tg{i}\n"))
    found = folders.read_files(spark, [str(tmp_path)], "mutations")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1
    assert found.dtypes == [("Start_Position", "bigint"), ("gene", "string"), ("Gene_2", "string"), ("source_file", "string")]  # one column for names that differ in case only
    assert sorted(tuple(r)[:3] for r in found.where("Start_Position is not null").collect()) == [(i, f"g{i}", None) for i in range(1, 12, 2)]
    assert {tuple(r)[:3] for r in found.where("Start_Position is null").collect()} == {(None, "low", f"g{i}") for i in range(0, 12, 2)}


@pytest.mark.parametrize("kind, text, want", [
    ("segments", "ID\tchrom\tloc.start\tloc.end\tnum.mark\tseg.mean\ns\t1\t2\t3\t4\t-0.5\n", ("s", "1", 2, 3, 4, -0.5)),
    ("variants", "Site1_Position\tName\n7\tn\n", (7, "n")),
    ("timeline", "TEST\tVALUE\tUNITS\na\t1.5\tu\n", ("a", 1.5, "u")),
    ("resource", "A\tB\nx\t\n", ("x", "")),
    (None, "A\tB\n1\t2\n", ("1", "2")),
])
def test_kinds(spark, tmp_path, kind, text, want):
    write(tmp_path, "s/x.txt", text)
    write(tmp_path, "t/x.txt", text)
    assert [tuple(r)[:-1] for r in folders.read_files(spark, [str(tmp_path)], kind).collect()] == [want, want]


def test_nothing_to_read(spark, tmp_path):
    write(tmp_path, "s/data_sv.txt", "")
    assert folders.read_files(spark, [str(tmp_path)]).count() == 0 and folders.malformed(spark, [str(tmp_path)]).count() == 0 and folders.comments(spark, [str(tmp_path)]).count() == 0
    write(tmp_path, "t/data_sv.txt", "A\tB\n")
    assert folders.read_files(spark, [str(tmp_path)]).columns == ["A", "B", "source_file"] and folders.read_files(spark, [str(tmp_path)]).count() == 0


def test_which_files_are_taken(spark, tmp_path):
    for name in ["data_clinical_sample.txt", "data_expression_x.txt", "readme.md", "data_linear_cna_hg19.seg", "data_mutations.txt", "data_mutations_other.txt", "data_timeline_lab.txt", "data_sv.txt"]:
        write(tmp_path, f"study/{name}", "A\n")
    found = {(r["name"], r["kind"], r["study"], r["length"]) for r in folders.study_files(spark, str(tmp_path)).collect()}
    assert found == {(n, k, "study", 2) for n, k in {"data_clinical_sample.txt": "clinical", "data_linear_cna_hg19.seg": "segments", "data_mutations.txt": "mutations", "data_timeline_lab.txt": "timeline", "data_sv.txt": "variants"}.items()}


def test_a_table_is_written_as_more_files_when_it_has_more_lines(spark, monkeypatch):
    """Each task sorts the lines of one file; every file begins with the head."""
    monkeypatch.setattr(studies, "LINES", 100)
    head = ["# a note", "id\tname"]
    path = studies._file(spark, "many.txt", head, spark.range(4000).selectExpr("id", "'n' || id % 7"))
    found = spark.read.text(path, wholetext=True).select("value").collect()
    texts = [r["value"].splitlines() for r in found]
    assert len(texts) == 40 and all(t[:2] == head and 20 < len(t) < 200 for t in texts)
    assert rows(files.read_tsv(spark, path)) == sorted(((str(i), f"n{i % 7}") for i in range(4000)), key=repr)
