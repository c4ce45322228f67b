"""Tables between the steps of a job, in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession

_own_dir: str | None = None
_WANTED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
_before: dict[str, str | None] = {}
_lock = threading.Lock()
_writers = 0


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session on one machine (master ``local``) may leave it unset, and has a folder of its own then."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="spark-weftline-")
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weftline/{uuid.uuid4().hex}/{name}"


class _Settings:
    """The session's settings while any table is written: shuffle files go as soon as their query has ended, and Python gets fewer rows and bytes at once.

    Tables written at the same time by several threads share them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.conf = spark.conf

    def __enter__(self) -> None:
        global _writers
        with _lock:
            if not _writers:
                for key, value in _WANTED.items():
                    _before[key] = self.conf.get(key, None)
                    self.conf.set(key, value)
            _writers += 1

    def __exit__(self, *_) -> None:
        global _writers
        with _lock:
            _writers -= 1
            if not _writers:
                for key, value in _before.items():
                    self.conf.unset(key) if value is None else self.conf.set(key, value)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``cut`` or a caller wrote, wherever it is stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage at a place that survives lost executors, gives the planner true sizes, and lets Spark drop the
    shuffle files of the finished step at once.
    """
    return _written(df, new_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    with _Settings(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of one job. ``finish`` removes all but those that its result still reads."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.made: list[tuple[str, DataFrame]] = []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        out = _written(df, path)
        self.made.append((path, out))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for path, _ in [x for x in self.made if any(x[1] is t for t in tables)]:
            remove(self.spark, path)
        self.made = [x for x in self.made if not any(x[1] is t for t in tables)]

    def finish(self, *kept: DataFrame) -> None:
        self.drop(*(t for _, t in self.made if not any(t is k for k in kept)))


def observed(counts: Observation) -> dict[str, int]:
    """What was counted while a plan ran. A plan that turns out to be empty while it runs is not carried on, and leaves no counts."""
    try:
        return counts.get
    except Py4JJavaError:
        return {}


def utf8_blocks(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` with about ``limit`` bytes of the text column ``column`` each (one row at least), with its UTF-8 bytes and row offsets. Null counts as empty."""
    texts = pc.fill_null(batch.column(column), "").cast(pa.large_string())
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo), raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
