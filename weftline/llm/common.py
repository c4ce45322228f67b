"""Shared helpers: Arrow text access, hashing of words."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from weftline.sources.staging import Steps, cut, new_path  # noqa: F401

#: Bytes of text that the vectorised kernels look at together. Bounds the memory of a task.
CHUNK_BYTES = 1 << 18

#: Values from which on a span is hashed on its own.
LONG_SPAN = 256


def text_chunks(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` with about ``limit`` bytes of text each (one row at least), with the UTF-8 bytes and row offsets.

    A null text counts as empty.
    """
    column = batch.column(text)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + 60_000)
        yield batch.slice(lo, hi - lo), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, giving back at its end what its allocators hold: a Python worker goes on to other tasks and lives as long as its executor."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return leaner


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 4096), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = CHUNK_BYTES) -> np.ndarray:
    """A 64-bit hash of each span ``values[start:end]`` (spans ascending and disjoint; values: uint64 codes).

    A polynomial modulo 2**64 from prefix sums, so the cost is a few vector operations per value. Spans of at most
    ``limit`` values are worked on together. Long spans can be built so that such a polynomial is the same for any base
    (from 1,024 values on), so spans of more than ``LONG_SPAN`` values have a cryptographic hash instead.
    """
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + limit, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        prefix = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[a:b] * _power_table(_BASE, b - a), out=prefix[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((prefix[e] - prefix[s]) * _power_table(_INVERSE, b - a + 1)[s] + (e - s).astype(np.uint64))
        lo = hi
    for i in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        digest = hashlib.blake2b(np.ascontiguousarray(values[starts[i] : ends[i]]).tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


#: A random-looking 64-bit code for each byte, made by rule.
BYTE_CODES = mix(np.arange(256, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without 0x20 and 0x09-0x0D) and, for each row, the number of words before it (one more at the end). Words end at row ends."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower_codes(data: np.ndarray) -> np.ndarray:
    """Codes of the bytes with A-Z lower-cased."""
    return BYTE_CODES[_LOWER[data]]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes=lower_codes) -> np.ndarray:
    """Hashes of the words, a bounded stretch of text at a time."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK_BYTES, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        out[lo:hi] = span_hashes(codes(data[a:b]), starts[lo:hi] - a, ends[lo:hi] - a)
        lo = hi
    return out


def own_name(name: str, taken: list[str]) -> str:
    """``name`` with as many ``_`` in front as it takes to be no column of ``taken``, one at least."""
    have = {c.lower() for c in taken}
    name = f"_{name}"
    while name.lower() in have:
        name = f"_{name}"
    return name
