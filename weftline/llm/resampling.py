"""Importance resampling towards a target: documents are drawn by how much likelier their word runs are in the target than in the corpus.

A run's bucket is the CRC-32 of its words joined by spaces. One scan of a document keeps a ring of the zlib states of the runs that began at the last n
words; each new word extends every state by a space and itself, so no run is ever built as a text.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.staging import Steps

from .common import text_chunks

#: Buckets that a result may have: what is sent to tasks is a long for each.
MOST_BUCKETS = 1 << 17

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def run_states(text: bytes, n: int) -> Iterator[int]:
    """CRC-32 of all runs of 1 to ``n`` words, in the order in which they end; ``text`` is lower-cased UTF-8."""
    ring: deque[int] = deque()
    for found in _WORD.finditer(text):
        word = found[0]
        if len(ring) == n:
            ring.popleft()
        for i, state in enumerate(ring):
            ring[i] = crc32(word, crc32(b" ", state))
        ring.append(crc32(word))
        yield from ring


def _runs(raw: bytes, n: int) -> tuple[np.ndarray, int]:
    """States of the runs of a text, and how many words it has."""
    states = np.fromiter(run_states(raw.lower(), n), np.uint32)  # bytes.lower() leaves all but A-Z
    words = len(states)
    if n > 1:  # 1, 2, ..., n, n, n, ...: runs that end at each word
        ramp = n * (n + 1) // 2
        words = (words - ramp) // n + n if words >= ramp else int((np.sqrt(8 * words + 1) - 1) // 2)
    return states, words


def bucket_counts(docs: DataFrame, *, text: str = "text", n: int, buckets: int) -> DataFrame:
    """(bucket, n): how often each bucket occurs over all texts. Tasks send a row for each of their buckets at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in text_chunks(batch, 0):
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    total += np.bincount(_runs(data[a:b].tobytes(), n)[0] % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    return docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """For each bucket floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), from the counts of both sides (``bucket_counts``)."""
    sides = source.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1)))
    counts = np.zeros((2, buckets), np.int64)
    for side, bucket, n in sides.select("side", "bucket", "n").collect():  # two rows a bucket at most
        counts[side, bucket] = n
    (s, t), (all_s, all_t) = counts.astype(float), counts.sum(axis=1).tolist()
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def _weighed(docs: DataFrame, gains: np.ndarray, *, id_: str, text: str, n: int) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    kind = docs.schema[id_].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = sent.value
        for batch in batches:
            for part, data, offsets in text_chunks(batch, 1):
                out = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    states, words = _runs(data[a:b].tobytes(), n)
                    out.append((words, len(states), int(gains[states % len(gains)].sum()) // len(states) if len(states) else 0))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in zip(*out))], ["id", "n_words", "n_features", "weight"])

    return docs.select(id_, text).mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 8 hex digits of sha256('seed:id'), so a row's noise is the same wherever it is drawn."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(rows: DataFrame, most: int, steps: Steps) -> DataFrame:
    """``rows`` with the rank of the first ``most`` by score, then id. Ranges are written and counted, and only then numbered, so no task sees all rows."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_words"), F.col("weight"), F.col("nth")]
    ranged = steps.cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("range").agg(F.count("*").alias("rows"))
    before = counts.select("range", (F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).alias("before"))  # a row for each range
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.join(F.broadcast(before), "range").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))


def resample(docs: DataFrame, target: DataFrame, *, id_: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 2, buckets: int = 10_000, share: tuple[int, int] = (10, 100), least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``; rank is 1, 2, 3, ... for those drawn and null for the others.

    Drawn without replacement: score is the weight (the floored mean gain of a document's runs) with Gumbel noise, and of the documents with ``least_words``
    words the ``share`` (a fraction) with the highest scores is taken, ties to the smaller id. Null and empty texts have no runs, weight 0, and are never drawn while ``least_words`` is
    1 or more; a null id counts as an empty one for the noise and is the last among ties; repeated rows are rows of their own, with equal scores and ranks one after another. Without
    texts in the target its counts are 0; an empty table gives an empty result. Other columns take no part, whatever their names.
    """
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets are 1 to {MOST_BUCKETS}")
    steps = Steps(docs.sparkSession)
    source = steps.cut(bucket_counts(docs, text=text, n=n, buckets=buckets), "source_buckets")
    gains = bucket_gains(source, bucket_counts(target, text=target_text, n=n, buckets=buckets), buckets)
    weighed = _weighed(docs, gains, id_=id_, text=text, n=n).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    # Rows that agree in all of this differ by their number only.
    seen = steps.cut(weighed.groupBy("id", "n_words", "n_features", "weight", "score").agg(F.count("*").alias("times")), "weighed")
    rows = seen.select("*", F.posexplode(F.sequence(F.lit(1), F.col("times"))).alias("nth", "_")).drop("times", "_")
    can = F.col("n_words") >= least_words
    most = share[0] * rows.where(can).count() // share[1]
    out = _ranked(rows.where(can), most, steps).drop("range", "before").unionByName(rows.where(~can).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_), "n_words", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
