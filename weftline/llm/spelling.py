"""Spelling variants: words one insertion, deletion or replacement apart, found by writing out whole neighbourhoods.

Each word emits all texts that one edit makes of it: every deletion, and every replacement and insertion of a character of the observed alphabet, each text once. A text
that is in the vocabulary is a near word as it stands, so the join needs no check of distances, and its keys are as many as the texts: no key is hot.
Most texts are no words. Tasks leave out those that a filter of the vocabulary does not know before anything is shuffled. The filter has ``FILTER_BITS``
bits at most; a vocabulary that is too large for it lets more texts through to the join, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.staging import Steps

from .common import mix

#: The most bits of the filter that is sent to tasks (16 MB), and how many it has for each word while it can.
FILTER_BITS = 1 << 27
BITS_A_WORD = 16
PROBES = 4

#: Texts whose hashes a task holds at once.
MOST_TEXTS = 1 << 18

#: Rounds after which forms must be settled: a form has ``ratio`` times as many occurrences, so chains are short, and each round doubles their reach.
MOST_ROUNDS = 64

NO_LETTER = np.uint32(0xFFFFFFFF)

_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_SPREAD = [np.uint64(mix(np.array([i], np.uint64))[0] | 1) for i in range(PROBES)]


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, _BASE, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def _codes(points: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit code for each character."""
    return mix(points.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def _letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), len(words[0]))


def _probe(hashes: np.ndarray, i: int, bits: int) -> np.ndarray:
    return (mix(hashes) * _SPREAD[i]) >> np.uint64(64 - bits)


def _by_length(batch: pa.RecordBatch) -> Iterator[list[str]]:
    lengths: dict[int, list[str]] = {}
    for w in batch.column(0).to_pylist():
        lengths.setdefault(len(w), []).append(w)
    return iter(lengths.values())


def word_filter(words: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of the column ``word`` as 64-bit words, and the logarithm of its bits. The driver gets ``FILTER_BITS`` bits at most."""
    bits = min(FILTER_BITS, max(1 << 10, BITS_A_WORD * n)).bit_length() - 1
    bits += BITS_A_WORD * n > 1 << bits and 1 << bits < FILTER_BITS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same in _by_length(batch):
                letters = _letters(same)
                hashes = (_codes(letters) * _powers(letters.shape[1])).sum(axis=1, dtype=np.uint64)
                at = np.concatenate([_probe(hashes, i, bits) for i in range(PROBES)])
                mask = np.left_shift(np.int64(1), (at & np.uint64(63)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(mask)], ["place", "mask"])

    made = words.select("word").mapInArrow(places, "place long, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[made["place"].to_numpy()] = made["mask"].to_numpy()
    return out.view(np.uint64), bits


def neighbourhoods(words: list[str], alphabet: np.ndarray, known: np.ndarray, bits: int) -> Iterator[tuple[list[str], list[str]]]:
    """(words, texts): all texts one edit from each of ``words`` (of one length) that the filter may know, each once for its word.

    Texts are hashed as sums of codes times powers, so an edit changes what comes before it and after it by known factors, and only texts that the filter knows are built. A letter
    removed from a run of equal ones, or put into one, gives one text: the first place of the run stands for it.
    """
    letters = _letters(words)
    length = letters.shape[1]
    powers = _powers(length + 1)
    prefix = np.zeros((len(words), length + 1), np.uint64)
    np.cumsum(_codes(letters) * powers[:length], axis=1, out=prefix[:, 1:])
    whole, codes = prefix[:, -1:], _codes(alphabet)
    signs = [chr(c) for c in alphabet.tolist()]

    def known_ones(hashes: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places in ``hashes`` that are new texts and pass all probes."""
        at = np.flatnonzero(new)
        hashes = hashes.ravel()[at]
        for i in range(PROBES):
            p = _probe(hashes, i, bits)
            ok = (known[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) != 0
            at, hashes = at[ok], hashes[ok]
        return np.unravel_index(at, new.shape)

    step = max(1, MOST_TEXTS // (len(words) * max(1, len(alphabet))))
    for lo in range(0, length + 1, step):
        hi = min(lo + step, length + 1)
        here, last = slice(lo, hi), min(hi, length)
        old = letters[:, lo:last]
        before = np.concatenate([letters[:, lo - 1 : lo] if lo else np.full((len(words), 1), NO_LETTER), letters[:, lo : hi - 1]], axis=1)
        start, rest = prefix[:, lo:last], whole - prefix[:, lo + 1 : last + 1]
        found = []
        w, p = known_ones(start + rest * _INVERSE, old != before[:, : last - lo])
        found += [(words[i], words[i][: lo + k] + words[i][lo + k + 1 :]) for i, k in zip(w.tolist(), p.tolist())]
        w, p, a = known_ones((start + rest)[:, :, None] + (powers[lo:last, None] * codes)[None], old[:, :, None] != alphabet)
        found += [(words[i], words[i][: lo + k] + signs[c] + words[i][lo + k + 1 :]) for i, k, c in zip(w.tolist(), p.tolist(), a.tolist())]
        moved = prefix[:, here] + (whole - prefix[:, here]) * np.uint64(_BASE)
        w, p, a = known_ones(moved[:, :, None] + (powers[here, None] * codes)[None], before[:, :, None] != alphabet)
        found += [(words[i], words[i][: lo + k] + signs[c] + words[i][lo + k :]) for i, k, c in zip(w.tolist(), p.tolist(), a.tolist())]
        if found:
            yield tuple(zip(*found))


def near_texts(words: DataFrame, n: int) -> DataFrame:
    """(word, text): for each of the ``n`` words, the texts one edit away that may be words."""
    alphabet = np.array(sorted(ord(r[0]) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()), np.uint32)  # characters, not words
    known, bits = word_filter(words, n)
    sent = words.sparkSession.sparkContext.broadcast(known)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same in _by_length(batch):
                for lo in range(0, len(same), 256):
                    for pair in neighbourhoods(same[lo : lo + 256], alphabet, sent.value, bits):
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in pair], ["word", "text"])

    return words.select("word").mapInArrow(emit, "word string, text string")


def count_words(words: DataFrame, least: int, often: int) -> DataFrame:
    """(word, n): how often each text of the column ``word`` occurs, for those with ``least`` characters and ``often`` occurrences or more. Nulls count for nothing."""
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def spelling_forms(words: DataFrame, *, ratio: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each row of ``words`` (word, n).

    Near words differ by one inserted, deleted or replaced character. The form of a word is its near word with the largest n (ties to the smallest in code-point order), if that is
    at least ``ratio`` times its own n, else null; its root is where its forms lead, itself if it has none. A word that is null or has no n is left out; of rows with the
    same word the largest n counts; an empty table gives an empty result. Other columns take no part.
    """
    if ratio < 2:
        raise ValueError("a form has to be more frequent, or chains of forms need not end")
    steps = Steps(words.sparkSession)
    words = steps.cut(words.where("word is not null and n is not null").groupBy("word").agg(F.max("n").cast("long").alias("n")), "words")
    texts = near_texts(words, words.count())
    met = texts.join(words.select(F.col("word").alias("text"), F.col("n").alias("text_n")), "text")
    best = met.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("text_n")).alias("less"), F.col("text").alias("text"))).alias("best"))
    out = words.join(best, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    has = -F.col("best.less") >= ratio * F.col("n")
    out = steps.cut(out.select("word", "n", "n_near", F.when(has, F.col("best.text")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(out.where("form is not null").select("word", F.col("form").alias("root")), steps)
    return out.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(links: DataFrame, steps: Steps) -> DataFrame:
    """(word, root): each word's link followed to the end. Every round doubles what a link reaches."""
    for _ in range(MOST_ROUNDS):
        further = links.join(links.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        links = steps.cut(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")
    raise RuntimeError(f"the forms are not settled after {MOST_ROUNDS} rounds")
