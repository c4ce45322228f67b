import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import packing, pieces, queries, token_counts
from weftline.llm.pieces import PieceEncoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", None, " ", "a", "it's we'll 'twas don''t 's", "  two  spaces \n\n\t tabs\r\n", "über Größe 1234 ½ x²", "日本語 text", "<|endoftext|> in a text", "emoji 😀 and ​ zero",
    "a" * 5000, "!!! ??? *** $$$", "\x1c\x1d odd", "trailing space ", "́ combining é", "'S 'T upper", " 's", "x y z", "…— “q”",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_librarys(library):
    enc = PieceEncoder(PATH)
    texts = [t or "" for t in TEXTS]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode(texts)] == want
    assert enc.counts(texts).tolist() == [len(w) for w in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tabstmdrevl.,!-019éñ"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=5))
def test_any_text(texts):
    lib, enc = Tokenizer.from_file(PATH), _encoder()
    assert [x.tolist() for x in enc.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


_held: list[PieceEncoder] = []


def _encoder() -> PieceEncoder:
    if not _held:
        _held.append(PieceEncoder(PATH, most=64))  # its memory starts anew again and again
    return _held[0]


def test_very_long_text(library):
    text = ("word and another one, " * 60_000)[: 1_200_000]
    assert PieceEncoder(PATH).counts([text])[0] == len(library.encode(text, add_special_tokens=False).ids)


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


#: Long words that a polynomial modulo 2**64 can't tell apart, and very long texts without gaps.
ALIKE = [x for n in (256, 512, 1024, 2048, 8192) for ab in ("ab", "ba", "xy", "yx", "01", "10") for x in (thue_morse(n, *ab), "a " + thue_morse(n, *ab))] + ["z" * 300_000, "-=" * 100_000, "q" * 513]


def test_words_with_equal_polynomials(library):
    want = [library.encode(t, add_special_tokens=False).ids for t in ALIKE]
    assert [x.tolist() for x in PieceEncoder(PATH).encode(ALIKE)] == want
    assert PieceEncoder(PATH).counts(ALIKE[::-1]).tolist() == [len(w) for w in want[::-1]]


def test_pieces_that_share_a_hash(library, monkeypatch):
    """With few hashes nearly all pieces collide; their characters tell them apart."""
    full = pieces.span_hashes
    monkeypatch.setattr(pieces, "span_hashes", lambda *a: full(*a) & np.uint64(3))
    texts = [t or "" for t in TEXTS] + ["some more words, and then some more", "others are here 1 22 333"]
    assert [x.tolist() for x in PieceEncoder(PATH).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def docs(spark, texts, extra=True):
    rows = [(i, t, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens long") if extra else spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")


def test_counts_and_cache(spark, library, tmp_path):
    table = docs(spark, [*TEXTS, "a", "a"])  # repeated texts, a column named like a result
    got = {r["doc_id"]: r for r in token_counts.count_tokens(table, PATH, cache_path=None, limit=3).collect()}
    for i, t in enumerate([*TEXTS, "a", "a"]):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 3)
    assert token_counts.count_tokens(table.where("false"), PATH).count() == 0


def test_a_digest_that_is_stored_twice_counts_once(spark, library, tmp_path):
    path = str(tmp_path / "cache")
    table = docs(spark, ["a b", "c"])
    spark.createDataFrame([], token_counts.TokenCountCache.schema).write.parquet(path)
    token_counts.count_tokens(table, PATH, cache_path=path)
    spark.read.parquet(path).coalesce(1).write.mode("append").parquet(path)  # another writer's
    assert sorted(r["n_tokens"] for r in token_counts.count_tokens(table, PATH, cache_path=path).collect()) == [1, 2]


def test_the_query_counts_like_the_library(spark, sf, library):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op6_token_counts(spark, sf).collect()}
    want = {r["doc_id"]: (r["text"] or "", len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in rows}
    assert len(got) == len(rows) and got == {k: (len(t.encode()), n, n > 512) for k, (t, n) in want.items()}


def test_emitting_the_fuller_bins_costs_no_sequence(spark, monkeypatch):
    """Long-tailed lengths in many groups, carried all or a few."""
    monkeypatch.setattr(packing, "GROUP", 60)
    rng = np.random.default_rng(4)
    table = spark.createDataFrame([(int(min(2047, x)),) for x in rng.pareto(0.9, 1500) * 150 + 1], "length long")
    n = []
    for carry in (10_000, 8):
        monkeypatch.setattr(packing, "CARRY", carry)
        n.append(packing.pack(table).select("sequence_id").distinct().count())
    assert n[0] == n[1]


def test_the_query_packs_the_librarys_ids(spark, sf, library):
    ids = {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op5_best_fit_packing(spark, sf).toPandas()
    for doc, rows in got.sort_values("piece").groupby("doc_id"):
        assert rows["piece"].tolist() == list(range(len(rows))) and rows["start"].tolist() == [0, *rows["length"].cumsum().tolist()][:-1] and rows["length"].sum() == len(ids[doc])
        for s, n, crc in zip(rows["start"], rows["length"], rows["ids_crc32"]):
            assert zlib.crc32(np.array(ids[doc][s : s + n], "<u4").tobytes()) == crc
        assert (rows["length"].iloc[1:] == 2048).all() and len(rows) == -(-len(ids[doc]) // 2048)
    assert set(got["doc_id"]) == set(ids)
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == [0, *rows["length"].cumsum().tolist()][:-1] and rows["length"].sum() <= 2048


def test_cache_encodes_only_misses(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.createDataFrame([], token_counts.TokenCountCache.schema).write.parquet(path)
    cache = token_counts.TokenCountCache(spark, PATH, path)
    cache.fill(docs(spark, ["a", "b", "b", None]))
    assert cache.table().count() == 3 and cache.misses(docs(spark, ["a", "c", ""])).count() == 1
    # what is stored is used: a wrong count shows
    wrong = spark.createDataFrame([(hashlib.sha256(b"zz").hexdigest(), cache.version, 99)], cache.schema)
    wrong.write.mode("append").parquet(path)
    cache.fill(docs(spark, ["zz"]))
    assert cache.counts(docs(spark, ["zz"])).first()["n_tokens"] == 99


def test_packing_round_trip(spark, library):
    rng = np.random.default_rng(3)
    texts = [*TEXTS, *(" ".join(rng.choice(["alpha", "be", "gamma ray", "12"], rng.integers(1, 400))) for _ in range(150)), "long text here " * 3000]
    table = docs(spark, texts)
    got = packing.pack(packing.token_pieces(table, PATH, capacity=256), capacity=256).toPandas()
    whole = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    for i, ids in whole.items():
        own = got[got.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids)
        assert len(own) == -(-len(ids) // 256) and (own.length[1:] == 256).all()
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 256
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 256) * 1.02 + 1


def test_packing_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    monkeypatch.setattr(packing, "CARRY", 5)
    lengths = np.random.default_rng(1).integers(1, 101, 700)
    items = spark.createDataFrame([(int(n), i % 3) for i, n in enumerate(lengths)], "length long, sequence_id long").drop("sequence_id")
    got = packing.pack(items, capacity=100).toPandas()
    assert sorted(got.length) == sorted(lengths.tolist())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 100
    assert got.sequence_id.nunique() <= lengths.sum() / 100 * 1.1
    assert packing.pack(items.where("false"), capacity=100).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fill = packing.best_fit(np.array([6, 5, 4, 3]), 10)
    assert bins.tolist() == [0, 1, 0, 1] and offsets.tolist() == [0, 0, 6, 5] and fill.tolist() == [10, 8]
