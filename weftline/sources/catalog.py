"""Tables of a Spark catalog."""

from __future__ import annotations

import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def schemas(spark: SparkSession, pattern: str = "*") -> list[str]:
    """SRC-01, SRC-02."""
    return [d.name for d in spark.catalog.listDatabases() if fnmatch.fnmatch(d.name, pattern)]


def tables(spark: SparkSession, schema: str, pattern: str = "*") -> list[str]:
    """SRC-03: names that match a glob pattern."""
    return [t.name for t in spark.catalog.listTables(schema) if not t.isTemporary and fnmatch.fnmatch(t.name, pattern)]


def columns(spark: SparkSession, schema: str, names: list[str]) -> DataFrame:
    """(schema, table, column, type, position, comment) (SRC-04)."""
    rows = [(schema, t, c.name, c.dataType, i, c.description) for t in names for i, c in enumerate(spark.catalog.listColumns(f"{schema}.{t}"))]
    return spark.createDataFrame(rows, "schema string, table string, column string, type string, position int, comment string")


def first_schema_with(columns_: DataFrame, table: str, column: str) -> DataFrame:
    """SRC-28: the first schema, by name, whose ``table`` has ``column``."""
    return columns_.where((F.col("table") == table) & (F.col("column") == column)).select("schema").orderBy("schema").limit(1)


def sample(table: DataFrame, n: int) -> DataFrame:
    """SRC-07: a few rows as texts."""
    return table.limit(n).select(*(F.col(f"`{c}`").cast("string").alias(c) for c in table.columns))


def declared_keys(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """(child_table, child_column, parent_table, parent_column) of declared foreign keys (SRC-05)."""
    return usage.join(constraints.where("type = 'FOREIGN KEY'"), "constraint").select("child_table", "child_column", "parent_table", "parent_column")


def profiled_columns(table: DataFrame, *, skip_times: bool = True, skip_numbers: bool = False) -> list[str]:
    """FLT-02: the columns worth a profile, by type."""
    times, numbers = ("date", "timestamp", "timestamp_ntz"), ("tinyint", "smallint", "int", "bigint", "float", "double")
    return [c for c, t in table.dtypes if not (skip_times and t in times) and not (skip_numbers and (t in numbers or t.startswith("decimal")))]


def described(table: DataFrame) -> DataFrame:
    """(column, type, comment, tags): SNK-02 and SRC-06, from the schema and its metadata; tags are a sorted list."""
    rows = [(f.name, f.dataType.simpleString(), f.metadata.get("comment"), sorted(f.metadata.get("tags", []))) for f in table.schema.fields]
    return table.sparkSession.createDataFrame(rows, "column string, type string, comment string, tags array<string>")


def of_label(nodes: DataFrame, label: str) -> DataFrame:
    """SRC-29: stored nodes of one label."""
    return nodes.where(F.col("label") == label)


def of_schema(columns_: DataFrame, schema: str) -> DataFrame:
    """SRC-29: the columns of one schema, in order."""
    return columns_.where(F.col("schema") == schema).orderBy("table", "position")
