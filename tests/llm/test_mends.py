"""Lengths, gzip members, columns of the same names, ties and repeated ids."""

import gzip
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import fixity, mixing, packing, quality

RECORDS = "file long, offset long, length long, payload binary"


def test_a_record_with_another_length_is_changed(spark):
    one = spark.createDataFrame([(0, 0, 5, b"abc"), (0, 5, 6, b"def")], RECORDS)
    two = spark.createDataFrame([(0, 0, 6, b"abc"), (0, 5, 6, b"def")], RECORDS)
    assert [tuple(r) for r in fixity.audit(one, two).collect()] == [(0, 0, 5, "changed")]
    moved = spark.createDataFrame([(0, 0, 5, b"abc"), (0, 7, 6, b"def")], RECORDS)
    assert sorted(tuple(r) for r in fixity.audit(one, moved).collect()) == [(0, 5, 6, "missing"), (0, 7, 6, "extra")]


def test_gzip_members_are_records(spark):
    parts = [f"WARC/1.0\r\nContent-Length: {n}\r\n\r\n{'é' * (n // 2)}\r\n\r\n".encode() for n in (0, 10, 200_000)]
    members = [gzip.compress(p) for p in parts]
    torn = gzip.compress(b"torn away")[:-9]
    files = spark.createDataFrame([("a.warc.gz", b"".join([*members, torn])), ("b", b"")], "path string, content binary")
    got = sorted((r["offset"], r["length"], bytes(r["payload"])) for r in fixity.read_warc(files).collect())
    begins = np.cumsum([0, *map(len, members)]).tolist()
    assert got == [*zip(begins, map(len, members), parts), (begins[-1], len(torn), torn)]


def test_packing_keeps_columns_of_its_own_names(spark):
    rows = [(i, i % 9 + 1, f"i{i}", f"s{i}", f"o{i}", i) for i in range(40)]
    items = spark.createDataFrame(rows, "id long, length long, Item string, sequence_id string, OFFSET string, _item long")
    got = packing.pack(items, capacity=10)
    assert got.columns == [*items.columns, "_sequence_id", "_offset"]
    assert sorted(tuple(r)[:6] for r in got.collect()) == sorted(rows)
    for s in {r["_sequence_id"] for r in got.collect()}:
        inside = sorted((r["_offset"], r["length"]) for r in got.where(F.col("_sequence_id") == s).collect())
        assert [o for o, _ in inside] == np.cumsum([0, *(n for _, n in inside)])[:-1].tolist() and sum(n for _, n in inside) <= 10


def test_rows_of_one_key_are_mixed_in_one_order(spark):
    rows = [(1, " ".join(["w"] * n) + f" {n}", "en", "s") for n in range(1, 30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = {tuple(sorted(r["text"] for r in mixing.mix_sources(table.repartition(p), {"lang": F.col("lang")}, [F.lit(1)], share=0.4, seed=3).collect())) for p in (1, 3, 7)}
    assert len(taken) == 1 and 0 < len(taken.pop()) < 29


def test_the_vocabulary_is_filled_among_equals(spark, monkeypatch):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 100 : i * 100 + 100] * quality.LEAST)) for i in range(30)] + [(99, "often " * 50)], "doc_id long, text string")
    monkeypatch.setattr(quality, "VOCABULARY", 2000)
    some = quality.vocabulary(docs)
    assert len(some) == 2000 == len(np.unique(some)) and (quality.vocabulary(docs.repartition(5)) == some).all()
    data = np.frombuffer(b"often", np.uint8)
    assert quality.words(data, np.array([0, 5]))[0][0] in some
    monkeypatch.setattr(quality, "VOCABULARY", 1 << 15)
    assert len(quality.vocabulary(docs)) == 3001


def test_an_id_with_many_documents_is_learnt_from_once(spark):
    docs = spark.createDataFrame([(1, f"good {i}") for i in range(50)] + [(2, "bad"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 0)], "doc_id long, quality int")
    seen = []
    monkey = pytest.MonkeyPatch()
    monkey.setattr(quality, "fit", lambda x, y: seen.append((x.shape, y.tolist())) or quality.Network(*[None] * 6))
    quality.train(docs, labels, quality.word_vectors(docs))
    monkey.undo()
    assert seen[0][0][0] == 3 and sorted(seen[0][1]) == [0, 0, 1]


def test_kept_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "q") for i in range(5)], "doc_id long, text string, _Quality_Score string")
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, quality int")
    assert zlib.crc32(b"0") % 4 != 2
    assert quality.keep_quality(docs, labels).columns == docs.columns and quality.keep_quality(docs, labels).count() == 5
