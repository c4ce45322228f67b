"""What a user plugs in: connectors, interpreters, embedders, tie breakers, and deterministic stand-ins for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.ranked import pick

Embed = Callable[[list[str]], list[list[float]]]


class Connector(Protocol):
    """Where a catalog comes from (UDF-02)."""

    def schemas(self) -> list[str]: ...

    def columns(self, schema: str, tables: list[str]) -> DataFrame: ...

    def table(self, schema: str, table: str) -> DataFrame: ...


class Runtime:
    """Runs and explains SQL over a catalog (UDF-04)."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def execute(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)

    def explain(self, sql: str) -> str:
        return self.spark.sql(f"EXPLAIN FORMATTED {sql}").first()[0]


class Registry:
    """Consumers, target adapters and policies by name (UDF-03, UDF-05, UDF-06)."""

    def __init__(self) -> None:
        self._made: dict[str, Callable] = {}

    def register(self, name: str):
        def add(f: Callable) -> Callable:
            if name in self._made:
                raise ValueError(f"{name} is registered already")
            self._made[name] = f
            return f

        return add

    def make(self, name: str, *args, **kw):
        if name not in self._made:
            raise KeyError(f"{name} is not registered; known: {sorted(self._made)}")
        return self._made[name](*args, **kw)


def hashed_embedder(width: int = 16) -> Embed:
    """A stand-in: vectors of length 1 from a digest of the text."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            x = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "little")).normal(size=width)
            out.append((x / np.linalg.norm(x)).tolist())
        return out

    return embed


def embed_nodes(nodes: DataFrame, embed: Embed, batch: int = 64) -> DataFrame:
    """``nodes`` (id, text) with ``embedding``; texts go to ``embed`` in batches of at most ``batch``; nodes without a text get none (VEC-04, UDF-08)."""
    kind = nodes.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found: list = [None] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None]
            for lo in range(0, len(known), batch):
                at = known[lo : lo + batch]
                for i, v in zip(at, embed([texts[i] for i in at])):
                    found[i] = v
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.float32()))], ["id", "embedding"])

    return nodes.select("id", "text").mapInArrow(run, f"id {kind}, embedding array<float>")


def break_ties(survivors: DataFrame, key: list[str], choose: Callable | None = None) -> DataFrame:
    """One survivor of each key: the smallest id, or what ``choose`` (a pandas frame to a frame of one row or none) says (UDF-01).

    A tie that ``choose`` declines has no survivor; ``declined_ties`` has it for review.
    """
    default = pick(survivors, key, [F.col("concept_id").cast("bigint"), F.col("concept_id")])
    if choose is None:
        return default
    ties = survivors.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    picked = survivors.join(ties, key, "left_semi").groupBy(*key).applyInPandas(choose, survivors.schema)
    return picked.unionByName(default.join(ties, key, "left_anti"))


def declined_ties(survivors: DataFrame, picked: DataFrame, key: list[str]) -> DataFrame:
    """The keys with several survivors and none in ``picked``, which people decide on."""
    return survivors.join(picked, key, "left_anti").groupBy(*key).agg(F.count("*").alias("n_survivors"))
