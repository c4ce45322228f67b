"""Quality classifier: random-indexing word vectors, pooled for each document, and a small calibrated network.

Words are runs of letters, runs of digits and runs of other visible characters, as they are written. Every word has a sparse
random index vector, made by rule from its hash; a word's context vector is the sum of the index vectors of the words
around it, over all documents. The most frequent words, at most ``VOCABULARY``, have a context vector each; rarer ones share
that of their shape (kind and length), so the table of vectors is bounded for any corpus and no rare word gets a frequent one's.
A document's features are the mean and the spread of its words' vectors, and a few lengths.

One pass counts the words, a second one adds up the context vectors in each task and sums the tables; scoring is a third. The network (two layers,
numpy) is fitted on at most ``MOST_LABELLED`` labelled documents, taken by a hash of their ids, and its probabilities
are calibrated by one temperature on a part of them that it was not fitted on.

Defined cases: null and empty texts have zero features and get a score like any others; documents without labels are
scored alike; labels that are null or without a document are ignored; with one kind of label only, or none, all scores are
that share of ones (0.5 for none); equal texts get equal scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, Steps, lean, own_name, span_hashes, text_chunks

VOCABULARY = 1 << 15  # words with a vector of their own: what is held and sent to tasks, 200 bytes each
LEAST = 3  # occurrences of such a word
INDEXES = 1 << 16  # index vectors that are told apart
WIDTH = 48  # of a word vector
SIGNS = 4  # entries of an index vector
WINDOW = 2  # words on each side
MOST_LABELLED = 20_000
HIDDEN = 32
FEATURES = 2 * WIDTH + 4

_LETTER, _DIGIT, _MARK, _BLANK = 1, 2, 3, 0
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E), *range(0x00, 0x09), *range(0x0E, 0x20), 0x7F]] = _BLANK
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
LENGTHS = 16  # bytes from which on words have one shape
SHAPES = 3 * LENGTHS


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its shape, its row)."""
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    turn = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | edge[1:-1]))) if len(data) else np.zeros(0, np.int64)
    ends = np.append(turn[1:], len(data))
    solid = kind[turn] != _BLANK if len(turn) else np.zeros(0, bool)
    starts, ends = turn[solid], ends[solid] if len(turn) else turn
    hashes = span_hashes(BYTE_CODES[data], starts, ends)
    shape = (kind[starts].astype(np.int64) - 1) * LENGTHS + np.minimum(ends - starts, LENGTHS) - 1
    return hashes, shape, np.searchsorted(offsets, starts, side="right") - 1


def slots(vocabulary: np.ndarray, hashes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Where the vector of each word is: that of the word in the sorted ``vocabulary``, or after these the one of its shape."""
    if not len(vocabulary):
        return shape
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, len(vocabulary) + shape)


def index_vectors() -> np.ndarray:
    """The sparse random vectors that words have by their hash, by rule; the last one is zero."""
    rng = np.random.default_rng(20_231)
    out = np.zeros((INDEXES + 1, WIDTH), np.int8)
    for _ in range(SIGNS):
        np.add.at(out, (np.arange(INDEXES), rng.integers(0, WIDTH, INDEXES)), rng.choice(np.array([-1, 1], np.int8), INDEXES))
    return out


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): the words of a task and how often they occur, in stretches of a bounded number of words."""
    value, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], ["word", "n"])

    for batch in batches:
        for _, data, offsets in text_chunks(batch, 0):
            some, n = np.unique(words(data, offsets)[0], return_counts=True)
            both = np.concatenate((value, some))
            value, inverse = np.unique(both, return_inverse=True)
            count = np.bincount(inverse, np.concatenate((count, n)), len(value)).astype(np.int64)
            if len(value) > 1 << 19:
                yield rows()
                value, count = value[:0], count[:0]
    yield rows()


def vocabulary(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """The sorted hashes of the most frequent words, ``VOCABULARY`` at most, that occur ``LEAST`` times.

    The frequency from which on words fit is found from counts of frequencies; of the words that are as frequent as the first one that does not fit, those with the lowest hashes fill the rest.
    """
    steps = Steps(docs.sparkSession)
    counted = steps.cut(docs.select(text).mapInArrow(lean(_occurrences), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST), "words")
    # whole up to 4,096, then 64 steps for each doubling
    level = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor((F.log2("n") - 12) * 64)).cast("long")
    least, total = 0, 0
    for row in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):  # some 7,000 rows at most
        if total + row["count"] > VOCABULARY:
            least = row["level"] + 1
            break
        total += row["count"]
    chosen = counted.where(level >= least).select("word")
    chosen = chosen.union(counted.where(level == least - 1).select("word").orderBy(F.xxhash64("word"), "word").limit(VOCABULARY - total)).toPandas()["word"]
    steps.finish()
    return np.sort(chosen.to_numpy(np.int64).view(np.uint64))


def _count(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(slot, sums): for each slot that a task met, the sum of the index vectors around it, and how often it occurred."""
        index = index_vectors()
        sums = np.zeros((len(known) + SHAPES, WIDTH + 1), np.int32)  # of one task
        for batch in batches:
            for _, data, offsets in text_chunks(batch, 0):
                hashes, shape, row = words(data, offsets)
                n = len(row)
                if not n:
                    continue
                slot, of = slots(known, hashes, shape), (hashes >> np.uint64(40)).astype(np.int64) % INDEXES
                around = np.zeros((n, WIDTH), np.int8)
                for step in range(1, min(WINDOW, n - 1) + 1):
                    same = row[step:] == row[:-step]
                    around[:-step] += index[np.where(same, of[step:], INDEXES)]
                    around[step:] += index[np.where(same, of[:-step], INDEXES)]
                order = np.argsort(slot, kind="stable")
                first = np.flatnonzero(np.diff(slot[order], prepend=-1))
                met = slot[order][first]
                sums[met, :WIDTH] += np.add.reduceat(around[order], first, axis=0, dtype=np.int32)
                sums[met, WIDTH] += np.diff(np.append(first, n))
        met = np.flatnonzero(sums[:, WIDTH])
        for lo in range(0, max(1, len(met)), 4096):
            some = met[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(sums[some, i].astype(np.int64)) for i in range(WIDTH + 1))], ["slot", *_SUMS])

    return run


_SUMS = [f"s{i}" for i in range(WIDTH + 1)]


@dataclass
class WordVectors:
    """``vectors``: a row for each word of the sorted ``vocabulary`` (hashes), then one for each shape."""

    vocabulary: np.ndarray
    vectors: np.ndarray


def word_vectors(docs: DataFrame, *, text: str = "text") -> WordVectors:
    """Context vectors of length 1 or zero, counted over all of ``docs``; at most ``VOCABULARY`` and ``SHAPES`` rows, whatever the corpus."""
    known = vocabulary(docs, text=text)
    counted = docs.select(text).mapInArrow(lean(_count(known)), "slot long, " + ", ".join(f"{c} long" for c in _SUMS))
    total = counted.groupBy("slot").agg(*(F.sum(c).alias(c) for c in _SUMS)).toPandas()  # a row for each vector
    out = np.zeros((len(known) + SHAPES, WIDTH + 1))
    out[total["slot"].to_numpy(np.int64)] = total[_SUMS].to_numpy(np.float64)
    # common directions say little: take out the mean over the occurrences, then scale
    total_n = max(1.0, out[:, WIDTH].sum())
    vectors = out[:, :WIDTH] / np.maximum(out[:, WIDTH:], 1)
    vectors -= (vectors * out[:, WIDTH:]).sum(0) / total_n
    vectors[out[:, WIDTH] == 0] = 0
    size = np.sqrt((vectors**2).sum(1))
    return WordVectors(known, (vectors / np.where(size > 0, size, 1)[:, None]).astype(np.float32))


def pooled(data: np.ndarray, offsets: np.ndarray, table: WordVectors) -> np.ndarray:
    """Features of each row: mean and spread of its word vectors, then logarithms of lengths."""
    hashes, shape, row = words(data, offsets)
    rows = len(offsets) - 1
    out = np.zeros((rows, FEATURES), np.float32)
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        at, n = row[first], np.diff(np.append(first, len(row)))
        v = table.vectors[slots(table.vocabulary, hashes, shape)]
        mean = np.add.reduceat(v, first, axis=0) / n[:, None]
        square = np.add.reduceat(v * v, first, axis=0) / n[:, None]
        out[at, :WIDTH] = mean
        out[at, WIDTH : 2 * WIDTH] = np.sqrt(np.maximum(0, square - mean**2))
        out[at, 2 * WIDTH] = np.log1p(n)
        # a word that follows itself
        again = np.zeros(len(row), np.float32)
        again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        out[at, 2 * WIDTH + 1] = np.add.reduceat(again, first) / n
        out[at, 2 * WIDTH + 2] = np.log1p(np.diff(offsets)[at]) - np.log1p(n)
    out[:, 2 * WIDTH + 3] = np.diff(offsets) == 0
    return out


@dataclass
class Network:
    """Two layers over standardised features; ``temperature`` divides the logits."""

    middle: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(0, ((x - self.middle) / self.scale) @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, epochs: int = 60, seed: int = 7) -> Network:
    """Adam on the logistic loss with weight decay. Every fifth row is left out: by these the best epoch and the temperature are chosen. The rows' order counts."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    share = y.mean() if len(y) else 0.5
    if len(np.unique(y)) < 2:
        edge = 40.0 if share == 1 else -40.0 if share == 0 else 0.0
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), edge)
    left = np.arange(len(y)) % 5 == 4
    tx, ty, vx, vy = x[~left], y[~left], x[left], y[left]
    spread = tx.std(0)
    rng = np.random.default_rng(seed)
    net = Network(tx.mean(0), np.where(spread > 1e-9, spread, 1), rng.normal(0, (2 / FEATURES) ** 0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    tx = (tx - net.middle) / net.scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, size = 0, 128
    best = np.inf
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs)
        order = rng.permutation(len(ty))
        for lo in range(0, len(ty), size):
            at = order[lo : lo + size]
            a = tx[at] @ params[0] + params[1]
            h = np.maximum(0, a)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            g = (p - ty[at]) / len(at)
            gh = np.outer(g, params[2]) * (a > 0)
            grads = [tx[at].T @ gh, gh.sum(0), h.T @ g, np.array([g.sum()])]
            step += 1
            for q, d, (m, v) in zip(params, grads, moments):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                q -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + 1e-3 * q)
        now = Network(net.middle, net.scale, *(q.copy() for q in params[:3]), float(params[3][0]))
        loss = np.logaddexp(0, np.where(vy > 0, -1, 1) * now.logits(vx)).mean() if len(vy) else -epoch
        if loss < best:
            best, chosen = loss, now
    net = chosen
    if len(vy):
        z = net.logits(vx)
        loss = [np.logaddexp(0, np.where(vy > 0, -z, z) / t).mean() for t in _TEMPERATURES]
        net.temperature = float(_TEMPERATURES[int(np.argmin(loss))])
    return net


_TEMPERATURES = np.exp(np.linspace(np.log(0.25), np.log(8), 61))


def _features(vectors: WordVectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_chunks(batch, 3):
                x = pooled(data, offsets, vectors)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], ["id", "label", "ord", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, vectors: WordVectors, *, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_LABELLED) -> Network:
    """``labels`` (key, label): the rows to learn from. At most ``most`` of them are, those whose ids hash lowest; of documents that share an id, one."""
    chosen = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    order = F.xxhash64(F.col("id"), F.lit(29))
    chosen = chosen.groupBy("id").agg(F.max("label").alias("label")).withColumn("ord", order).orderBy("ord", "id").limit(most)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "ord", "text")
    kind = docs.schema[key].dataType.simpleString()
    each = rows.mapInArrow(lean(_features(vectors)), f"id {kind}, label int, ord long, x binary")
    got = each.groupBy("id").agg(F.min(F.struct("ord", "label", "x")).alias("row")).select("id", "row.*").orderBy("ord", "id").toPandas()  # a row for each id, at most ``most``
    x = np.frombuffer(b"".join(got["x"]), "<f4").reshape(-1, FEATURES)
    return fit(x, got["label"].to_numpy())


def score(docs: DataFrame, network: Network, vectors: WordVectors, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` (all columns) and ``name``, the probability of label 1."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in text_chunks(batch, at):
                s = network.scores(pooled(data, offsets, vectors))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], [*part.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lean(run), f"{fields}, {name} double")


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a row is kept from learning: by the crc32 of its key as text."""
    return F.coalesce(F.crc32(key.cast("string")) % parts == part, F.lit(False))


def classifier(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[WordVectors, Network]:
    """Word vectors of ``docs`` and a network for them, from the labels that are not held out."""
    vectors = word_vectors(docs, text=text)
    return vectors, train(docs, labels.where(~held_out(F.col(key))), vectors, key=key, text=text, label=label)


def quality_scores(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``."""
    vectors, network = classifier(docs, labels, key=key, text=text, label=label)
    scored = score(docs.select(key, text), network, vectors, text=text)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``."""
    vectors, network = classifier(docs, labels, key=key, text=text, label=label)
    name = own_name("quality_score", docs.columns)
    return score(docs, network, vectors, text=text, name=name).where(F.col(name) >= threshold).drop(name)
