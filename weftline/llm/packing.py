"""Best-fit packing in rounds: partitions pack locally, nearly full bins are done, underfull ones go on as items.

Round 1 gives each group of at most about ``GROUP`` items to one task, which packs best-fit, longest first. Bins filled
to ``NEARLY`` of the capacity are emitted. The others are items of the next round, in groups that join ``FAN`` of the
former ones, until one group is left. In a group no two bins left could be one (best fit opens a bin only if the item fits in no other), so at most one
of them is half full or less. A later round can thus only join such a small bin of one group with a bin of another, ``FAN`` times
in a group at most, and any bin that has room for it is no emptier than the emptiest. So a round carries the ``CARRY`` emptiest bins of a
group, many more than ``FAN``, and emits the others as they are: that costs no join that carrying them all would make, and no task grows with the input.

Defined cases: a null or empty text has the closing id alone; pieces of equal documents are packed like any others; an
empty table gives an empty result; texts longer than the capacity are cut into full pieces, the first one being shorter;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, own_name, text_chunks
from .token_counts import encoder

CAPACITY = 2048
GROUP = 16_384
NEARLY = 0.98
FAN = 8
CARRY = 2_048


def token_pieces(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(key, piece, start, length, ids_crc32): the ids of each text and ``end_id``, cut into pieces of at most ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        close = np.array([end_id], "<u4")
        for batch in batches:
            for part, _, _ in text_chunks(batch, 1):
                rows, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(enc.encode([t or "" for t in part.column(1).to_pylist()])):
                    whole = np.concatenate((ids.astype("<u4"), close))
                    at, n = 0, 0
                    size = (len(whole) - 1) % capacity + 1
                    while at < len(whole):
                        rows.append(i)
                        piece.append(n)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(whole[at : at + size].tobytes()))
                        at, n, size = at + size, n + 1, capacity
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    [key, "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(lean(run), f"{key} {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: (bin of each item, its offset there, fill of each bin).

    Bins are found by what they have left: a bit set of the sizes that some open bin has.
    """
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    open_bins: dict[int, list[int]] = {}
    sizes = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = sizes >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                sizes &= ~(1 << left)
        else:
            b, left = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if left - n:
            open_bins.setdefault(left - n, []).append(b)
            sizes |= 1 << (left - n)
    return bins, offsets, np.array(fill, np.int64)


def _round(capacity: int, last: bool):
    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        """Places each item (item, length) of the group in a bin. A bin is named by its first item; ``done``: whether it is emitted."""
        rows = rows.sort_values("item", kind="stable")
        items = rows["item"].to_numpy()
        bins, offsets, fill = best_fit(rows["length"].to_numpy(), capacity)
        names = np.zeros(len(fill), np.int64)
        names[bins[offsets == 0]] = items[offsets == 0]
        done = fill >= NEARLY * capacity
        open_ = np.flatnonzero(~done)
        if last:
            done[:] = True
        elif len(open_) > CARRY:
            done[open_[np.argsort(fill[open_], kind="stable")[CARRY:]]] = True
        return pd.DataFrame({"item": items, "bin": names[bins], "offset": offsets, "fill": fill[bins], "done": done[bins], "group": np.full(len(items), key[0], np.int64)})

    return run


def pack(items: DataFrame, *, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``. Lengths are from 1 to ``capacity``; items of the full length are sequences of their own.

    Where ``items`` has such a column itself, the added one has a ``_`` in front.
    """
    have = {c.lower() for c in items.columns}
    name, sequence, offset = own_name("item", items.columns), *(n if n not in have else own_name(n, items.columns) for n in ("sequence_id", "offset"))
    numbered = cut(items.withColumn(name, F.monotonically_increasing_id()), "items")
    full = numbered.where(F.col(length) >= capacity).withColumns({sequence: F.col(name), offset: F.lit(0).cast("long")})
    loose = numbered.where(F.col(length) < capacity)
    groups = max(1, -(-loose.count() // GROUP))
    todo = loose.select(F.col(name).alias("item"), F.col(length).alias("length"), F.pmod(F.xxhash64(name), F.lit(groups)).alias("group"))
    # where each item of the first round is, followed from bin to bin
    place = None
    while True:
        last = groups == 1
        got = todo.groupBy("group").applyInPandas(_round(capacity, last), "item long, bin long, offset long, fill long, done boolean, group long")
        got = cut(got, "round")
        if place is None:
            place = got.select("item", "bin", "offset", "done")
            final = place.where("done")
        else:
            moved = place.where(~F.col("done")).select("item", F.col("bin").alias("inner"), F.col("offset").alias("within"))
            step = got.select(F.col("item").alias("inner"), "bin", "offset", "done")
            place = moved.join(step, "inner").select("item", "bin", (F.col("offset") + F.col("within")).alias("offset"), "done")
            final = final.union(place.where("done"))
        if last:
            break
        groups = -(-groups // FAN)
        todo = got.where(~F.col("done")).groupBy(F.col("bin").alias("item")).agg(F.first("fill").alias("length"), F.first("group").alias("from"))
        todo = todo.select("item", "length", F.floor(F.col("from") / FAN).cast("long").alias("group"))
    final = final.select(F.col("item").alias(name), F.col("bin").alias(sequence), F.col("offset").alias(offset))
    return full.unionByName(loose.join(final, name)).drop(name)
