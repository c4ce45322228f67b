"""Tables made of scopes, each of which is replaced as a whole while the others stay as they are.

A scope is a partition of an external table. A swap writes the new rows to a folder of their own and then points the scope at it: one change of the
catalog, so readers see the old rows or the new ones, and a run that breaks off leaves every scope whole. Nothing is written over. Folders that no scope
points at any more are removed by ``vacuum``. Tables that are merged by key are bucketed by it as well: their stored side is joined as it lies, without a shuffle,
as long as a task can hold a bucket; larger merges are dealt into as many tasks as their rows need.
"""

from __future__ import annotations

import datetime
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weftline.operators import ranked
from weftline.sources.staging import new_path, observed, remove

#: Scopes that one swap may replace: the driver holds their names and points each at its folder.
MOST_SCOPES = 10_000

#: Rows that one task of a merge joins or writes, about: with more, a merge is dealt into more tasks than there are buckets.
TASK_ROWS = 500_000


@dataclass(frozen=True)
class Swapped:
    """What a swap has done, counted by the job that wrote the rows: of ``n_read`` rows, ``n_outside`` were in none of the scopes and were left out."""

    n_read: int
    n_written: int
    n_outside: int
    scopes: int


def _literal(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, str) and value:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return f"DATE '{value.isoformat()}'"
    raise ValueError(f"a scope is a whole number, a text that is not empty, a date or a truth value, not {value!r}")


class ScopedTable:
    """The table ``name``, partitioned by the columns ``scope``; see ``create``."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name
        kinds = spark.catalog.listColumns(name)
        self.scope = [c.name for c in kinds if c.isPartition]
        self.key = [c.name for c in kinds if c.isBucket]
        facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
        self.path, self.buckets = facts["Location"], int(facts.get("Num Buckets", 0))

    @classmethod
    def create(cls, like: DataFrame, name: str, scope: list[str], *, key: list[str] | None = None, buckets: int = 8, path: str | None = None) -> ScopedTable:
        """The table, made empty with the columns of ``like`` if there is none of that name; with ``key``, each scope is bucketed and sorted by it."""
        spark = like.sparkSession
        if not spark.catalog.tableExists(name):
            made = like.limit(0).write.partitionBy(*scope).option("path", path or new_path(spark, name))
            (made.bucketBy(buckets, *key).sortBy(*key) if key else made).saveAsTable(name)
        return cls(spark, name)

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.read.table(self.name)

    def rows_of(self, scopes: list[tuple]) -> DataFrame:
        """Rows of some scopes; the others are not read."""
        if len(self.scope) == 1:
            return self.read().where(F.col(self.scope[0]).isin([s[0] for s in scopes]))
        inside = F.lit(False)
        for s in scopes:
            mine = F.lit(True)
            for c, v in zip(self.scope, s):
                mine = mine & (F.col(c) == F.lit(v))
            inside = inside | mine
        return self.read().where(inside)

    def swap(self, rows: DataFrame, scopes: list[tuple], tasks: int | None = None) -> Swapped:
        """Replace the rows of each of ``scopes`` (values in the order of the scope's columns) by those of ``rows``; a scope without rows is emptied. ``tasks``: see ``write``.

        Rows in none of them, also those with a null there, are left out and counted. ``rows`` may come from the table itself: what it reads stays until ``vacuum``.
        """
        scopes = list(dict.fromkeys(tuple(s) for s in scopes))
        if len(scopes) > MOST_SCOPES:
            raise ValueError(f"a swap replaces {MOST_SCOPES} scopes at most")
        specs = [", ".join(f"`{c}` = {_literal(v)}" for c, v in zip(self.scope, s, strict=True)) for s in scopes]
        folder, seen = self.write(rows, scopes, tasks)
        filled = {r[0] for r in self.spark.read.schema("_scope int").parquet(folder).select("_scope").distinct().collect()} if scopes else set()
        for i, spec in enumerate(specs):
            if i in filled:
                self.point(spec, f"{folder}/_scope={i}")
            else:
                self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({spec})")
        self.spark.catalog.refreshTable(self.name)
        return Swapped(seen["n"], seen["inside"], seen["n"] - seen["inside"], len(scopes))

    def write(self, rows: DataFrame, scopes: list[tuple], tasks: int | None = None) -> tuple[str, dict]:
        """The first step of a swap: the folder with the new rows, and how many there were, counted while they were written.

        With a key, ``tasks``, a multiple of the buckets, write them (one for each bucket, unless given); each has rows of one bucket only.
        """
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.spark.read.table(self.name).select(*self.scope).schema)
        numbers = self.spark.createDataFrame([(*s, i) for i, s in enumerate(scopes)], f"{kinds}, _scope int")  # ``MOST_SCOPES`` at most
        body = [c for c in self.spark.read.table(self.name).columns if c not in self.scope]
        seen = Observation()
        met = rows.join(F.broadcast(numbers), self.scope, "left").observe(seen, F.count("*").alias("n"), F.count("_scope").alias("inside"))
        met = met.where("_scope is not null").select(*body, "_scope")
        folder = f"{self.path}/_swaps/{uuid.uuid4().hex}"
        if self.key:
            beside = f"{self.name}__{uuid.uuid4().hex}"
            met.repartition(tasks or self.buckets, *self.key).write.partitionBy("_scope").bucketBy(self.buckets, *self.key).sortBy(*self.key).option("path", folder).saveAsTable(beside)
            self.spark.sql(f"DROP TABLE {beside}")  # its files are outside the warehouse and stay
        else:
            met.write.partitionBy("_scope").parquet(folder)
        return folder, {"n": 0, "inside": 0} | observed(seen)

    def point(self, spec: str, folder: str) -> None:
        """The second step of a swap, for one scope: from now on readers get the rows of ``folder``."""
        if self.spark.sql(f"SHOW PARTITIONS {self.name} PARTITION ({spec})").isEmpty():
            self.spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS PARTITION ({spec}) LOCATION '{folder}'")
        else:
            self.spark.sql(f"ALTER TABLE {self.name} PARTITION ({spec}) SET LOCATION '{folder}'")

    def vacuum(self) -> int:
        """Remove the folders of swaps that no scope points at, once no reader is at work on them; returns how many."""
        used = {r["path"] for r in self.read().select(F.regexp_extract("_metadata.file_path", "/_swaps/([0-9a-f]{32})/", 1).alias("path")).distinct().collect()}
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_swaps")
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        old = [f.getPath() for f in fs.listStatus(top) if f.getPath().getName() not in used] if fs.exists(top) else []
        for p in old:
            remove(self.spark, p.toString())
        return len(old)


def part_of(key: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")


class KeyedTable:
    """Rows with a key, dealt into parts by its hash, that are merged by reading and replacing the parts of the new keys only (SNK-14, SNK-18)."""

    def __init__(self, like: DataFrame, name: str, key: list[str], *, parts: int = 64, buckets: int = 8, path: str | None = None) -> None:
        self.key, self.parts = key, parts
        self.table = ScopedTable.create(like.withColumn("_part", part_of(key, parts)), name, ["_part"], key=key, buckets=buckets, path=path)

    def read(self) -> DataFrame:
        return self.table.read().drop("_part")

    def touched(self, rows: DataFrame) -> tuple[list[int], int]:
        """The parts that the keys of ``rows`` are in, ``parts`` at most, and the tasks for their stored rows and ``rows``: one for each bucket or, with more than ``TASK_ROWS`` in a bucket, a multiple of that."""
        found = dict(map(tuple, rows.groupBy(part_of(self.key, self.parts).alias("p")).count().collect()))
        touched, buckets = sorted(found), self.table.buckets
        stored = self.table.rows_of([(p,) for p in touched]).count() if touched else 0  # from the files' footers
        return touched, buckets * max(1, -(-(stored + sum(found.values())) // (buckets * TASK_ROWS)))

    def dealt(self, rows: DataFrame, tasks: int | None) -> DataFrame:
        """``rows`` as they lie if a task for each bucket can hold them, else dealt into ``tasks`` by the key."""
        return rows.repartition(tasks, *self.key) if tasks and tasks > self.table.buckets else rows

    def merged(self, new: DataFrame, wins: Column, touched: list[int], tasks: int | None = None) -> DataFrame:
        """Stored rows of the parts in ``touched`` with those of ``new`` (a row a key): where both have a key, the new row if ``wins``, which may use ``old.`` and ``new.`` names. The stored side is joined as it lies in its buckets, unless they are too large for a task each."""
        columns = [c for c in new.columns if c not in self.key]
        side = lambda df, name: self.dealt(df.select(*self.key, F.struct(*(F.col(f"`{c}`") for c in columns)).alias(name)), tasks)
        met = side(self.table.rows_of([(p,) for p in touched]).drop("_part"), "old").join(side(new, "new"), self.key, "full_outer")
        row = F.when(F.col("old").isNull() | (F.col("new").isNotNull() & F.coalesce(wins, F.lit(False))), F.col("new")).otherwise(F.col("old")).alias("_row")
        return met.select(*self.key, row).select(*self.key, *(F.col(f"_row.`{c}`") for c in columns))

    def merge(self, rows: DataFrame, order: list[Column], wins: Column | None = None) -> Swapped:
        """Take in ``rows``, of those with one key the first by ``order``. A new row replaces a stored one if ``wins`` (always, unless given). Doing it twice changes nothing.

        Rows with a null in their key are left out.
        """
        named = rows.dropna(subset=self.key)
        new = ranked.pick(named, self.key, order).select(*self.read().columns)
        touched, tasks = self.touched(named)
        out = self.merged(new, F.lit(True) if wins is None else wins, touched, tasks)
        return self.table.swap(out.withColumn("_part", part_of(self.key, self.parts)), [(p,) for p in touched], tasks)

    def merge_confident(self, rows: DataFrame, confidence: str = "confidence") -> Swapped:
        """Of stored and new rows the most confident one of each key; none counts as -1, and stored rows win ties (AGG-20)."""
        rank = lambda c: F.coalesce(c, F.lit(-1.0))
        rest = [F.col(c) for c in rows.columns if c not in self.key]
        return self.merge(rows, [-rank(F.col(confidence)), *rest], rank(F.col(f"new.{confidence}")) > rank(F.col(f"old.{confidence}")))

    def delete(self, keys: DataFrame) -> Swapped:
        """Remove the rows of ``keys``, from the parts they are in only."""
        touched, tasks = self.touched(keys.dropna(subset=self.key))
        stored, gone = (self.dealt(x, tasks) for x in (self.table.rows_of([(p,) for p in touched]), keys.select(*self.key).distinct().withColumn("_gone", F.lit(True))))
        left = stored.join(gone, self.key, "left").where("_gone is null").drop("_gone")  # an anti join would go below the dealing, to a task for each bucket
        return self.table.swap(left, [(p,) for p in touched], tasks)
