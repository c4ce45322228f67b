"""Writes that can be repeated.

A scoped write replaces its scope and touches no other (``scoped``). A keyed write of a table without parts makes the whole new table from the stored one and
swaps it in; tables that grow are ``scoped.KeyedTable``. Sessions that have read a table before refresh it to see the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import ranked
from weftline.sources.scoped import ScopedTable


def recover(spark: SparkSession, name: str) -> None:
    """End a ``swap`` that broke off between its steps: the table has its name again, with the new rows if they were whole, else with the old ones."""
    beside, before = f"{name}__next", f"{name}__before"
    if not spark.catalog.tableExists(name) and spark.catalog.tableExists(before):  # the old one only gives way to a whole new one
        spark.sql(f"ALTER TABLE {beside if spark.catalog.tableExists(beside) else before} RENAME TO {name}")
    for left in (beside, before):
        spark.sql(f"DROP TABLE IF EXISTS {left}")


def stored(spark: SparkSession, name: str, like: DataFrame) -> DataFrame:
    recover(spark, name)
    if not spark.catalog.tableExists(name):
        return spark.createDataFrame([], like.schema)
    spark.catalog.refreshTable(name)
    return spark.read.table(name)


def swap(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """Write beside the table, then take its place. The old table is dropped last, so a break at any step loses nothing; the next call mends it."""
    recover(spark, name)
    beside, before = f"{name}__next", f"{name}__before"
    rows.write.mode("overwrite").saveAsTable(beside)
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {before}")
    spark.sql(f"ALTER TABLE {beside} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {before}")
    spark.catalog.refreshTable(name)


def write_table(spark: SparkSession, name: str, rows: DataFrame, comments: dict[str, str] | None = None) -> None:
    """SNK-01, SNK-13, SNK-17: the table anew, with comments on its columns."""
    notes = comments or {}
    swap(spark, name, rows.select(*(F.col(f"`{c}`").alias(c, metadata={"comment": notes[c]}) if c in notes else F.col(f"`{c}`") for c in rows.columns)))


def write_scope(spark: SparkSession, name: str, rows: DataFrame, scope: dict[str, str]) -> int:
    """SNK-09 to SNK-11: the rows of a scope are replaced, also by none. Returns how many rows the scope has then.

    The table is made of scopes (``scoped.ScopedTable``) by the scope's columns, in their order; rows outside the scope are an error of the caller and are left out.
    """
    return ScopedTable.create(rows, name, list(scope)).swap(rows, [tuple(scope.values())]).n_written


def write_upsert(spark: SparkSession, name: str, rows: DataFrame, key: list[str], order: list[Column]) -> None:
    """SNK-14."""
    swap(spark, name, ranked.upsert(stored(spark, name, rows), rows, key, order))


def write_once(spark: SparkSession, name: str, rows: DataFrame, key: list[str], order: list[Column]) -> None:
    """SNK-03, SNK-19: keys that are stored stay as they are; the others are appended.

    Writers at the same time may both append a key: ``once`` reads one row of each.
    """
    best = ranked.pick(rows, key, order)
    old = stored(spark, name, rows)
    best.join(old, ranked.same_key(best, old, key), "left_anti").write.mode("append").saveAsTable(name)


def once(spark: SparkSession, name: str, key: list[str], order: list[Column]) -> DataFrame:
    """The table of ``write_once`` with one row of each key, the best by ``order``, also if an append was done twice."""
    spark.catalog.refreshTable(name)
    return ranked.pick(spark.read.table(name), key, order)


def reconcile(pushed: DataFrame, target: DataFrame) -> DataFrame:
    """One row: n_pushed, n_target, matches (SNK-07)."""
    sides = pushed.select(F.lit(True).alias("p")).unionByName(target.select(F.lit(False).alias("p")))
    both = sides.agg(F.count_if("p").alias("n_pushed"), F.count_if(~F.col("p")).alias("n_target"))
    return both.withColumn("matches", F.col("n_pushed") == F.col("n_target"))


def comment_plan(parsed: DataFrame, live: DataFrame) -> DataFrame:
    """(table, column, comment, state): which comments can be recovered (JOIN-24, SNK-20). live: table, column, comment."""
    t = live.select("table").distinct().withColumn("_t", F.lit(True))
    c = live.select("table", "column", F.col("comment").alias("_has"), F.lit(True).alias("_c"))
    met = parsed.join(t, "table", "left").join(c, ["table", "column"], "left")
    state = F.when(F.col("_t").isNull(), "table_not_found").when(F.col("_c").isNull(), "column_not_found").when(F.trim(F.coalesce("_has", F.lit(""))) != "", "already_commented").otherwise("apply")
    return met.select("table", "column", "comment", state.alias("state"))


def comment_statements(plan: DataFrame) -> DataFrame:
    """(statement): DDL for the comments to apply."""
    text = F.regexp_replace("comment", "'", "''")
    return plan.where("state = 'apply'").select(F.concat(F.lit("ALTER TABLE "), "table", F.lit(" ALTER COLUMN "), "column", F.lit(" COMMENT '"), text, F.lit("'")).alias("statement"))


def write_dump(claims: DataFrame, path: str) -> None:
    """SRC-24: claims as JSON lines, for ``quality.diff``."""
    claims.write.mode("overwrite").json(path)


def overrides(claims: DataFrame) -> DataFrame:
    """What people decided, to carry over (SNK-22)."""
    return claims.where(F.col("status").isin("accepted", "rejected", "pinned"))


def review_list(claims: DataFrame, threshold: float) -> DataFrame:
    """(subject, claims): unsure claims by subject, the least sure first (SNK-23, SRT-07)."""
    return claims.where(F.col("confidence") < threshold).groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("confidence", "id", "predicate"))).alias("claims"))
