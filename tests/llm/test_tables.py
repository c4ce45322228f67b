"""Mixing, fixity, shards, the classifier and the pipeline."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import fixity, kd_shards, mixing, quality
from weftline.llm.queries import op7_quality_classifier, op8_kd_shards


def fill(children: dict, budget: int) -> dict:
    """children: name -> (weight, supply). Plain water-filling, the shares rounded down at the end."""
    left, live, out = Fraction(budget), {n for n, (w, _) in children.items() if w > 0}, dict.fromkeys(children, 0)
    while live:
        total = sum(children[n][0] for n in live)
        full = {n for n in live if children[n][1] * total <= left * children[n][0]}
        if not full:
            return out | {n: int(left * children[n][0] / total) for n in live}
        low = min(full, key=lambda n: (Fraction(children[n][1], children[n][0]), n))
        out[low] = children[low][1]
        left -= children[low][1]
        live.remove(low)
    return out


@pytest.mark.parametrize("share, epochs", [(0.5, 1), (1.0, 3), (9.0, 2), (0.0, 1)])
def test_mixing(spark, monkeypatch, share, epochs):
    monkeypatch.setattr(mixing, "RANGES", 4)
    monkeypatch.setattr(mixing, "_SHIFT", 58)
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))) if i % 17 else None, "abc"[i % 3] if i % 19 else None, f"s{i % 7 if i % 2 else 0}") for i in range(400)]
    rows.append(rows[5])
    table = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, tokens int")
    path = {"lang": F.col("lang"), "source": F.col("source")}
    weights = [F.expr("case lang when 'a' then 5 when 'b' then 1 when 'c' then 0 else 2 end"), F.expr("case source when 's0' then 1 else 3 end")]
    got = mixing.mix_sources(table, path, weights, share=share, epochs=epochs, seed=9).collect()

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    supply: dict = {}
    for i, t, lang, s in rows:
        supply.setdefault(lang, {}).setdefault(s, []).append((i, size(t)))
    total = sum(n for ls in supply.values() for ds in ls.values() for _, n in ds)
    w1 = {"a": 5, "b": 1, "c": 0, None: 2}
    tokens = lambda ds: sum(n for _, n in ds)
    by_lang = fill({lang: (w1[lang], epochs * sum(map(tokens, ls.values()))) for lang, ls in supply.items()}, int(total * share))
    want = []
    for lang, ls in supply.items():
        for s, b in fill({s: (1 if s == "s0" else 3, epochs * tokens(ds)) for s, ds in ls.items()}, by_lang[lang]).items():
            ds = ls[s]
            if w1[lang] == 0:
                continue
            whole, rest = divmod(b, tokens(ds)) if tokens(ds) else (0, b)
            for e in range(whole):
                want += [(i, e) for i, _ in ds]
            upto = 0
            for i, n in sorted(ds, key=lambda d: (int(hashlib.md5(f"9:{whole}:{d[0]}".encode()).hexdigest()[:15], 16), d[0])):
                upto += n
                if upto > rest:
                    break
                want.append((i, whole))
    assert sorted((r["doc_id"], r["_epoch"]) for r in got) == sorted(want)
    clashing = {c: F.lit("x") for c in ("_tokens", "_Epoch", "_lang", "_key", "key", "row", "l0", "own_l0", "range", "end", "digest", "rest", "full", "running")}
    wide = mixing.mix_sources(table.withColumns(clashing), path, weights, share=share, epochs=epochs, seed=9)
    assert wide.columns == [*table.columns, *clashing, "__lang", "_source", "__tokens", "__epoch"]
    assert sorted((r["doc_id"], r["__epoch"], r["_key"]) for r in wide.collect()) == sorted((*w, "x") for w in want)
    assert sum(size(r["text"]) for r in got) <= total * share
    assert mixing.mix_sources(table.where("false"), path, weights).count() == 0


def test_fixity(spark, monkeypatch):
    monkeypatch.setattr(fixity, "LEAF", 512)
    monkeypatch.setattr(fixity, "FAN", 4)
    pages = spark.createDataFrame([(i, f"http://x/{i}", None if i == 3 else "é" * (i % 90), 0) for i in range(300)] + [(7, "again", "x", 0)], "page_id long, url string, html string, offset int")
    ours = fixity.archive(pages, per_file=120)
    for f in ours.groupBy("file").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect():
        assert f["n"] == f["end"]
    record = ours.where("key = 4").first()["payload"]
    head, body = bytes(record).split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.0\r\n") and f"Content-Length: {len(body) - 4}".encode() in head
    assert fixity.audit(ours, ours).count() == 0
    theirs = ours.where("key <> 50").withColumn("payload", F.when(F.col("key").isin(9, 260), F.lit(b"?")).otherwise(F.col("payload")))
    more = theirs.unionByName(ours.where("key = 1").withColumns({"offset": F.lit(10**6).cast("long"), "length": F.lit(1).cast("long")}))
    at = {r["key"]: (r["file"], r["offset"]) for r in ours.collect()}
    got = {(r["file"], r["offset"]): r["state"] for r in fixity.audit(ours, more).collect()}
    assert got == {at[50]: "missing", at[9]: "changed", at[260]: "changed", (0, 10**6): "extra"}
    none = ours.where("false")
    assert fixity.audit(none, none).count() == 0
    assert {r["state"] for r in fixity.audit(ours, none).collect()} == {"missing"} and fixity.audit(ours, none).count() == 301


def test_warc_files(spark, tmp_path):
    """Written, read again and audited against a replica with a broken record, a lost one and a torn head."""
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>é\r\n\r\n" * (i % 5) + "WARC/1.0\r\n" * (i % 2)) for i in range(40)] + [(7, "http://x/7", None)] * 3 + [(8, "u", "y" * 600_000)], "page_id long, url string, html string")
    ours = fixity.archive(pages, per_file=25).cache()
    assert [r["n"] for r in ours.groupBy("file").agg((F.sum("length") - F.max(F.col("offset") + F.col("length"))).alias("n")).collect()] == [0, 0]
    fixity.write_warc(ours, str(tmp_path / "a"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(str(tmp_path / "a"))
    number = F.regexp_extract("file", "file=([0-9]+)", 1).cast("long")
    read = fixity.read_warc(files).withColumn("file", number)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, ours.select("file", "offset", "length", "payload").collect()))
    raw = bytearray(files.where("path like '%file=0/%'").first()["content"])
    places = sorted((r["offset"], r["length"]) for r in ours.where("file = 0").collect())
    raw[places[3][0] + places[3][1] - 6] ^= 1
    raw[places[4][0]] ^= 1
    broken = spark.createDataFrame([("file=0", bytes(raw))], "path string, content binary")
    found = fixity.audit(ours.where("file = 0"), fixity.read_warc(broken).withColumn("file", number))
    assert sorted((r["offset"], r["state"]) for r in found.collect()) == [(places[3][0], "changed"), (places[4][0], "changed")]
    assert fixity.read_warc(files.where("false")).count() == 0


def test_shards(spark):
    rng = np.random.default_rng(1)
    rows = [(i, None if i % 50 == 0 else "x" * int(rng.integers(0, 200)), "hot" if i % 3 else f"s{i % 9}", "en", 1) for i in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size int")
    got = kd_shards.kd_shards(table, [F.length("text"), F.pmod(F.xxhash64("source"), F.lit(1 << 20)), F.lit(None)], shards=7).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert sorted(sizes.index) == list(range(7)) and sizes.max() - sizes.min() < 600 and len(got) == 2000
    text = {i: t or "" for i, t, *_ in rows}
    for r in got.itertuples():
        assert r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert kd_shards.kd_shards(table.where("false"), [F.lit(1)], shards=7).count() == 0
    assert kd_shards.kd_shards(table, [F.lit(1)], shards=1).select("shard").distinct().count() == 1


def test_shards_are_those_of_a_plain_tree(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i == 7 else i // 2 if i < 40 else i, None if i % 50 == 0 else "x" * int(rng.integers(0, 90)), f"s{i % 5}") for i in range(700)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    dimensions = [F.length("text"), F.pmod(F.xxhash64("source"), F.lit(1 << 20))]
    content = F.coalesce("text", F.lit(""))
    codes = table.select("doc_id", content.alias("t"), *(F.coalesce(d.cast("long"), F.lit(0)) for d in dimensions), F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(11), content), 34)).collect()
    points = [(r[0], len(r[1]) + 8, r[2:4], r[4]) for r in codes]

    def spread(ps, d):
        w = np.array([p[1] for p in ps], float)
        x = np.array([p[2][d] for p in ps], float)
        return max(0.0, (w * x * x).sum() / w.sum() - ((w * x).sum() / w.sum()) ** 2) ** 0.5

    whole = [spread(points, d) for d in (0, 1)]

    def leaves(ps, k):
        if k == 1:
            return [ps]
        relative = [spread(ps, d) / whole[d] if whole[d] else 0.0 for d in (0, 1)]
        d = relative.index(max(relative))
        code = lambda p: p[2][d] << 30 | p[3]
        goal, before = sum(p[1] for p in ps) * (k // 2) / k, 0
        for c in sorted({code(p) for p in ps}):
            have = before + sum(p[1] for p in ps if code(p) == c)
            if have > goal:
                at = c if goal - before <= have - goal else c + 1
                break
            before = have
        return leaves([p for p in ps if code(p) < at], k // 2) + leaves([p for p in ps if code(p) >= at], k - k // 2)

    got = kd_shards.kd_shards(table, dimensions, shards=6).collect()
    shards = [sorted(repr((r["doc_id"], r["size"])) for r in got if r["shard"] == s) for s in range(6)]
    assert sorted(shards) == sorted(sorted(repr((p[0], p[1])) for p in leaf) for leaf in leaves(points, 6))


def test_shards_cut_equal_rows(spark):
    table = spark.createDataFrame([(i, "same") for i in range(1000)], "doc_id long, text string")
    got = kd_shards.kd_shards(table, [F.lit(3)], shards=5).groupBy("shard").count().toPandas()
    assert got["count"].min() >= 195 and got["count"].max() <= 205


def test_shards_stay_in_the_jvm(spark, sf):
    plan = op8_kd_shards(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_words_and_pooling():
    raw = "Ab ab!! 12x\tAb é".encode()
    data = np.frombuffer(raw + b"" + "zz zz".encode(), np.uint8)
    hashes, shape, row = quality.words(data, np.array([0, len(raw), len(raw), len(raw) + 5]))
    assert row.tolist() == [0] * 7 + [2] * 2 and hashes[0] == hashes[5] != hashes[1] and hashes[7] == hashes[8]
    assert shape.tolist() == [1, 1, 33, 17, 0, 1, 1, 1, 1]
    known = np.unique(hashes[:3])
    assert quality.slots(known, hashes, shape).tolist() == [*np.searchsorted(known, hashes[:3]), 20, 3, np.searchsorted(known, hashes[5]), 4, 4, 4]
    x = quality.pooled(data, np.array([0, len(raw), len(raw), len(raw) + 5]), quality.WordVectors(known, np.ones((len(known) + quality.SHAPES, quality.WIDTH), np.float32)))
    assert np.isfinite(x).all() and (x[1, : 2 * quality.WIDTH] == 0).all() and x[1, -1] == 1


def plain_words(text):
    return re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\x00-\x20\x7fA-Za-z0-9\x80-\xff]+", (text or "").encode())


def test_classifier_is_the_plain_one(spark, monkeypatch):
    """Word vectors, features and scores against loops over words, with more words than the vocabulary takes."""
    monkeypatch.setattr(quality, "VOCABULARY", 12)
    rng = np.random.default_rng(8)
    names = [f"{c}{c}" for c in "abcdefghijk"] + ["12", "!!", "Größe", "x" * 700, "é", "77777", "zq"]
    texts = [None, "", "one word", *(" ".join(rng.choice(names, int(rng.integers(1, 25)), p=np.arange(18, 0, -1) / 171)) for _ in range(80))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int("aa" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, quality int")

    hash_of = lambda w: int(quality.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0])
    all_words = [plain_words(t) for t in texts]
    count = {}
    for ws in all_words:
        for w in ws:
            count[w] = count.get(w, 0) + 1
    least = next(n for n in range(quality.LEAST, 10_000) if sum(c >= n for c in count.values()) <= 12)
    own = {w for w, c in count.items() if c >= least}
    kind = lambda w: 0 if w[:1].isalpha() or w[0] > 127 else 1 if w.isdigit() else 2
    name = lambda w: w if w in own else (kind(w), min(len(w), quality.LENGTHS))
    index = quality.index_vectors()
    sums, n = {}, {}
    for ws in all_words:
        for i, w in enumerate(ws):
            around = [index[(hash_of(v) >> 40) % quality.INDEXES].astype(int) for j, v in enumerate(ws) if 0 < abs(i - j) <= quality.WINDOW]
            sums[name(w)] = sums.get(name(w), 0) + sum(around, np.zeros(quality.WIDTH, int))
            n[name(w)] = n.get(name(w), 0) + 1
    middle = sum(sums.values()) / sum(n.values())
    vector = {w: sums[w] / n[w] - middle for w in sums}
    vector = {w: v / np.linalg.norm(v) for w, v in vector.items()}

    table, network = quality.classifier(docs, labels)
    assert table.vocabulary.tolist() == sorted(hash_of(w) for w in own) and 0 < len(own) < len(count)
    for w, v in vector.items():
        at = table.vocabulary.tolist().index(hash_of(w)) if isinstance(w, bytes) else len(own) + w[0] * quality.LENGTHS + w[1] - 1
        assert np.allclose(table.vectors[at], v, atol=1e-6)
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, labels).collect()}
    for i, ws in enumerate(all_words):
        x = np.zeros(quality.FEATURES)
        if ws:
            v = np.array([vector[name(w)] for w in ws])
            x[: quality.WIDTH], x[quality.WIDTH : 2 * quality.WIDTH] = v.mean(0), v.std(0)
            x[-4:-1] = np.log1p(len(ws)), sum(a == b for a, b in zip(ws, ws[1:])) / len(ws), np.log1p(len(texts[i].encode())) - np.log1p(len(ws))
        x[-1] = not texts[i]
        h = np.maximum(0, ((x - network.middle) / network.scale) @ network.w1 + network.b1)
        assert abs(got[i] - 1 / (1 + np.exp(-(h @ network.w2 + network.b2) / network.temperature))) < 1e-3


def test_network_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8000, quality.FEATURES)).astype(np.float32)
    y = (rng.random(8000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    net = quality.fit(x[:4000], y[:4000])
    s = net.scores(x[4000:])
    high = s > 0.7
    assert abs(y[4000:][high].mean() - s[high].mean()) < 0.1
    assert quality.fit(x[:5], np.ones(5)).scores(x[:2]).tolist() == [1.0, 1.0] and quality.fit(x[:0], y[:0]).scores(x[:1])[0] == 0.5


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = op7_quality_classifier(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got.count() == docs.count()
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2).all()
    assert ((both.score >= 0.7) == (both.predicted == 1)).all() and (both.predicted == both.quality).mean() > 0.93


def test_classifier_edge_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 1), (5, None, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(i, ("good words here. " if i % 2 else "BAD!! ## ") * 5, "en", 1.0) for i in range(60)] + [(100, None, None, 1.0), (101, "", "en", 1.0), (102, "x" * 100_000, "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality_score double")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == 63 and all(0 <= r["score"] <= 1 for r in got.values()) and got[100]["score"] == got[101]["score"]
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect() if r["doc_id"] < 60} == set(range(1, 60, 2))
    assert quality.quality_scores(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(docs, labels.where("false")).collect()} == {0.5}


def test_stages_on_odd_rows(spark, sf):
    """Nulls in any column, repeated rows, empty texts and tables, columns with the operators' own names."""
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "en", "s1", 5), (2, words, "en", "s1", 5), (2, words, "en", "s1", 5), (None, words, None, None, None), (3, None, "de", "s2", 0), (4, "", None, "s2", 0), (5, words + " password=abcdefgh", "en", "s1", None), (6, "x" * 50_000, "en", "s3", 1)]
    docs = spark.createDataFrame(rows, schema).withColumns({"score": F.lit(1), "_key": F.lit(2), "node": F.lit(3), "spans": F.lit(4)})
    own = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and stage(spark, docs.where("false"), sf).count() == 0, name
    single = own["n-gram Jaccard join"](spark, docs, sf)
    assert sorted((r["doc_id"] or 0, r["lang"] or "") for r in single.collect()) == [(1, "en"), (3, "de"), (4, ""), (6, "en")]
    clean = {(r["doc_id"], r["text"], r["n_chars"]) for r in own["secret scans"](spark, docs, sf).collect()}
    assert (3, None, 0) in clean and (5, words + " [REDACTED]", len(words) + 11) in clean and len(clean) == 7
    packed = own["best-fit packing"](spark, docs, sf).toPandas()
    assert len(packed) >= len(rows) and packed[packed.doc_id == 3]["length"].tolist() == [1] and own["best-fit packing"](spark, docs.where("false"), sf).count() == 0


def test_pipeline(spark, sf):
    """Each stage against its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "best-fit packing"]
    from test_groups import brute_words
    from test_secrets import brute

    columns = docs.columns
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(corpus_pipeline.cut(stage(spark, tables[-1], sf), name.replace(" ", "_")))
    start, good, single, clean, mixed, packed = ([r.asDict() for r in t.collect()] for t in tables)
    assert all(t.columns == columns for t in tables[:-1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in good}
    wanted = [r["doc_id"] for r in start if labels.get(r["doc_id"]) == 1]
    assert len(kept & set(wanted)) >= 0.95 * len(wanted) and len(kept) < len(start)
    _, least = brute_words([r["text"] for r in sorted(good, key=lambda r: r["doc_id"])])
    ids = sorted(kept)
    assert {r["doc_id"] for r in single} == {ids[i] for i, low in least.items() if low == i}
    by_id = {r["doc_id"]: r for r in single}
    for r in clean:
        before = by_id[r["doc_id"]]
        if brute(before["text"] or ""):
            assert not brute(r["text"]) and r["n_chars"] == len(r["text"])
        else:
            assert r == before
    assert len(clean) == len(single)
    n_words = lambda rs: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rs)
    assert 0.6 * n_words(clean) < n_words(mixed) <= corpus_pipeline.MIX_SHARE * n_words(clean)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed} and max(r["offset"] + r["length"] for r in packed) <= 2048
    assert corpus_pipeline.run(spark, sf).count() == len(packed)
