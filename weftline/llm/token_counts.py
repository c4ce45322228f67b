"""Token counts through a digest cache.

The cache is a Parquet table (digest, tokenizer, n_tokens). Texts are joined to it by a digest of the content and one of
the tokenizer file; only distinct texts that miss are encoded, and their counts are appended.

Defined cases: a null text counts as empty (0 tokens); repeated rows and equal texts share one cache entry; an empty table
gives an empty result; extra columns of ``docs`` are ignored; a text of any length is counted whole. "Normalised" means
that null becomes the empty text and nothing else, since any other change to a text could change its count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, new_path, text_chunks
from .pieces import PieceEncoder


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    """One for each Python worker, which Spark uses again for later tasks."""
    return PieceEncoder(path)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class TokenCountCache:
    """``path``: the folder of the cache, or None for a new one in the shared folder."""

    schema = "digest string, tokenizer string, n_tokens long"

    def __init__(self, spark: SparkSession, tokenizer_path: str, path: str | None = None) -> None:
        self.spark = spark
        self.tokenizer_path = tokenizer_path
        self.version = tokenizer_digest(tokenizer_path)
        self.path = path or new_path(spark, "token_counts")
        if path is None:
            spark.createDataFrame([], self.schema).write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        """(digest, n_tokens), a row for each digest: a job that ran again, or two at the same time, may have appended one twice."""
        stored = self.spark.read.schema(self.schema).parquet(self.path).where(F.col("tokenizer") == self.version)
        return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def misses(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The distinct texts that the cache does not have: (digest, content)."""
        content = F.coalesce(F.col(text), F.lit(""))
        keyed = docs.select(F.sha2(content, 256).alias("digest"), content.alias("content"))
        return keyed.join(self.table(), "digest", "left_anti").dropDuplicates(["digest"])

    def fill(self, docs: DataFrame, text: str = "text") -> None:
        """Encode the misses and append their counts."""
        path, version = self.tokenizer_path, self.version

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc = encoder(path)
            for batch in batches:
                for part, _, _ in text_chunks(batch, 1):
                    n = enc.counts(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([version] * part.num_rows, pa.string()), pa.array(n)], ["digest", "tokenizer", "n_tokens"])

        self.misses(docs, text).mapInArrow(lean(count), self.schema).write.mode("append").parquet(self.path)

    def counts(self, docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
        """(key, n_bytes, n_tokens, over_limit) for every row of ``docs``, after ``fill``."""
        content = F.coalesce(F.col(text), F.lit(""))
        rows = docs.select(F.col(key), F.sha2(content, 256).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes"))
        return rows.join(self.table(), "digest").select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def count_tokens(docs: DataFrame, tokenizer_path: str, *, cache_path: str | None = None, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    cache = TokenCountCache(docs.sparkSession, tokenizer_path, cache_path)
    cache.fill(docs, text)
    return cache.counts(docs, key, text, limit)
