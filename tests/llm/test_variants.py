"""Exact dedup, resampling towards a target and spelling variants against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, queries, resampling, spelling

DOCS = "doc_id long, text string, digest string, points int, Body string, n int"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], DOCS)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_groups(rows):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(body(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for b, members in groups.items():
        members.sort(key=lambda m: m[:3])
        sha = hashlib.sha256(b.encode()).hexdigest()
        out += [(m[3], members[0][3], len(members), k == 0, sha) for k, m in enumerate(members)]
    return sorted(out, key=repr)


COPIES = [
    (3, "one two"), (2, "onetwo"), (1, "one\ttwo\r\n"), (9, "one two"), (9, "one two"), (4, None), (5, ""), (6, " \x0b\x0c "), (None, "  \n"), (None, None), (7, "ünïcode 𝄞"), (8, "ünï code𝄞"),
    (10, "x" * 200_000), (11, "x" * 200_000), (12, "x" * 199_999 + "y"), (13, "one two"), (14, "One two"), (15, "alone"), (15, "a lone"), (15, "alone"), (None, "nobody"), (None, "nobody"),
]


@pytest.mark.parametrize("digest", [exact_dedup.digest128, lambda t: F.length(t) % 3, lambda t: F.lit(1)], ids=["md5", "three values", "one value"])
def test_exact_groups(spark, digest):
    got = exact_dedup.exact_groups(table(spark, COPIES), digest=digest)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert found(got) == plain_groups(COPIES)


def test_exact_groups_of_nothing_and_of_one_hot_group(spark, monkeypatch):
    assert found(exact_dedup.exact_groups(table(spark, []))) == []
    monkeypatch.setattr(exact_dedup, "HOT_PART", 3)  # hot: more than a third
    rows = [(i, "copy " * (i % 3) if i % 2 else f"text {i}") for i in range(60)]
    assert found(exact_dedup.exact_groups(table(spark, rows))) == plain_groups(rows)


def test_rounds_of_copies_keep_one_of_each(spark):
    got = exact_dedup.exact_groups(table(spark, COPIES)).where("kept")
    assert got.count() == got.select("text_sha256").distinct().count() == len({r[4] for r in plain_groups(COPIES)})


def plain_resample(docs, target, n, buckets, share, least, seed):
    def runs(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        return len(w), [crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for x in side for b in runs(x)[1]) for side in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for i, text in docs:
        words, own = runs(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    can = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[1], r[3]))
    for k, r in enumerate(can[: share[0] * len(can) // share[1]]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def prose(rng, n):
    return " ".join(rng.choice(["Alpha", "beta", "gämma", "δέλτα", "x9", "e-f", "it's", "𝄞"]) for _ in range(n))


@pytest.mark.parametrize("n, least, share", [(1, 20, (10, 100)), (2, 0, (1, 3)), (3, 2, (1, 1)), (4, 500, (1, 2))])
def test_resample(spark, n, least, share):
    rng = random.Random(n)
    docs = [(i, prose(rng, rng.randrange(0, 60))) for i in range(80)] + [(80, None), (81, ""), (82, " .,- "), (None, prose(rng, 30)), (5, prose(rng, 40)), (83, prose(rng, 30_000))]
    docs += [docs[7], docs[7]]
    target = [prose(rng, 50), "alpha beta " * 30, None, ""]
    got = resampling.resample(table(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=97, share=share, least_words=least, seed=7)
    assert found(got) == plain_resample(docs, target, n, 97, share, least, 7)


def test_resample_without_documents_or_target(spark):
    nothing = spark.createDataFrame([], "text string")
    assert found(resampling.resample(table(spark, []), nothing)) == []
    docs = [(i, f"word {i % 3} again") for i in range(10)]
    assert found(resampling.resample(table(spark, docs), nothing, n=2, buckets=5, share=(1, 2), least_words=1, seed=1)) == plain_resample(docs, [], 2, 5, (1, 2), 1, 1)
    with pytest.raises(ValueError, match="buckets"):
        resampling.resample(table(spark, docs), nothing, buckets=0)


def test_run_states_are_those_of_the_joined_words():
    text = b"a bc d\xc3\xa9 -- a9  bc"
    words = re.findall(rb"[0-9a-z\x80-\xff]+", text)
    for n in (1, 2, 3, 9):
        assert sorted(resampling.run_states(text, n)) == sorted(crc32(b" ".join(words[i : i + k])) for k in range(1, n + 1) for i in range(len(words) - k + 1))
        assert resampling._runs(text, n)[1] == len(words)


def edits(word, alphabet):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in alphabet if c != b[0]} | {a + c + b for a, b in cuts for c in alphabet}


def plain_forms(words, ratio):
    alphabet, out = set("".join(words)), {}
    for w, n in words.items():
        near = [(-words[x], x) for x in edits(w, alphabet) if x in words]
        form = min(near)[1] if near and -min(near)[0] >= ratio * n else None
        out[w] = (n, len(near), form, words[form] if form else None)
    rows = []
    for w, (n, near, form, form_n) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.append((w, n, near, form, form_n, root))
    return sorted(rows, key=repr)


def vocabulary(rng, n):
    """Words of few letters, so that neighbourhoods are dense, with counts that make chains."""
    words = {"".join(rng.choice("aabé") for _ in range(rng.randrange(1, 7))): rng.choice([1, 2, 20, 200, 2000, 20_000]) for _ in range(n)}
    return words | {"ab" * 300: 5, "ab" * 300 + "a": 900, "𝄞ab": 3, "ab𝄞": 40, "zz": 7, "": 3}


@pytest.mark.parametrize("bits", [1 << 27, 1 << 6], ids=["filter", "filter that knows all"])
def test_spelling_forms(spark, monkeypatch, bits):
    monkeypatch.setattr(spelling, "FILTER_BITS", bits)
    words = vocabulary(random.Random(3), 120)
    rows = [*words.items(), ("ab" * 300, 1), (None, 4), ("lost", None)]  # of repeated words the largest n
    got = spelling.spelling_forms(spark.createDataFrame([(*r, "x", 1) for r in rows], "word string, n int, text string, root int"), ratio=10)
    assert found(got) == plain_forms(words, 10)


def test_spelling_forms_of_nothing(spark):
    assert found(spelling.spelling_forms(spark.createDataFrame([], "word string, n long"))) == []
    assert found(spelling.spelling_forms(spark.createDataFrame([("a", 1)], "word string, n long"))) == [("a", 1, 0, None, None, "a")]
    with pytest.raises(ValueError):
        spelling.spelling_forms(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


@pytest.mark.parametrize("most", [1, 40, 1 << 18])
def test_whole_neighbourhoods_each_text_once(monkeypatch, most):
    monkeypatch.setattr(spelling, "MOST_TEXTS", most)
    alphabet = np.array(sorted(map(ord, "abé")), np.uint32)
    everything = np.full(1, ~np.uint64(0))
    for words in (["aab", "bbb", "éab"], ["a"], [""], ["abababab"]):
        pairs = [p for block in spelling.neighbourhoods(words, alphabet, everything, 6) for p in zip(*block)]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {(w, x) for w in words for x in edits(w, "abé")}


def test_noisy_words(spark):
    docs = [(i, "Straßenbahn étrangère ABCDEFG short ﬁ " + "z" * (i % 9)) for i in range(120)] + [(1, None), (2, ""), (None, "wordsofnobody")]
    want = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    got = spelling.count_words(queries.noisy_words(table(spark, docs)), 7, 2)
    assert {r["word"]: r["n"] for r in got.collect()} == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
