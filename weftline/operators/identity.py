"""Identities that outlive a run, and child tables whose keys are closed under them.

registry: source_namespace, source_key, uid, entity_id, run_id; one row for each (namespace, key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import keys
from weftline.sources.staging import cut


def _numbered(new: DataFrame, order: list[str], first: Column) -> DataFrame:
    """Dense numbers in the order of ``order``, without gathering all rows in one task: ranges of the order are counted, then numbered on their own.

    The rows are written with the number of their range, so both steps see the same ranges, whatever Spark computes again.
    """
    ranged = cut(new.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn("entity_id", first + F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def normal_keys(rows: DataFrame, key: str) -> DataFrame:
    """Rows with their key stripped; those without a key go to review, see ``missing_keys`` (ID-01)."""
    return rows.where(~keys.is_blank(F.col(key).cast("string"))).withColumn(key, keys.strip(F.col(key).cast("string")))


def missing_keys(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(keys.is_blank(F.col(key).cast("string")))


def register(registry: DataFrame | None, found: DataFrame, run_id: str) -> DataFrame:
    """The registry with the new (source_namespace, source_key) of ``found``; ids go on from the largest, in the order of the keys (ID-02, SNK-15, WIN-01, AGG-07).

    Ids that were given never change.
    """
    names = found.select("source_namespace", "source_key").where("source_key is not null").distinct()
    new, first = names, F.lit(0).cast("bigint")
    if registry is not None:
        new = names.join(registry, ["source_namespace", "source_key"], "left_anti")
        first = F.lit(registry.agg(F.coalesce(F.max("entity_id"), F.lit(0))).first()[0]).cast("bigint")
    uid = keys.entity_uid(F.col("source_namespace"), F.col("source_key"))
    rows = _numbered(new, ["source_namespace", "source_key"], first).select("source_namespace", "source_key", uid.alias("uid"), "entity_id", F.lit(run_id).alias("run_id"))
    return rows if registry is None else registry.unionByName(rows)


def collapse_plan(registry: DataFrame, groups: DataFrame) -> DataFrame:
    """(source_namespace, source_key, retired_id, survivor_id): ids that stand for one key in namespaces of one group (ID-03, AGG-09, JOIN-08).

    groups: source_namespace, identity_namespace; namespaces that it lacks are groups of their own. The smallest id survives.
    """
    named = registry.join(groups, "source_namespace", "left").withColumn("_ns", F.coalesce("identity_namespace", "source_namespace"))
    least = named.groupBy("_ns", "source_key").agg(F.min("entity_id").alias("survivor_id"), F.max("entity_id").alias("_most")).where("survivor_id <> _most")
    rows = named.join(least, ["_ns", "source_key"]).where("entity_id <> survivor_id")
    return rows.select("source_namespace", "source_key", F.col("entity_id").alias("retired_id"), "survivor_id")


def remap(registry: DataFrame, plan: DataFrame) -> DataFrame:
    """The registry with survivors in place of retired ids; doing it twice changes nothing (SNK-16)."""
    moved = registry.join(plan.select("source_namespace", "source_key", "survivor_id"), ["source_namespace", "source_key"], "left")
    return moved.withColumn("entity_id", F.coalesce("survivor_id", "entity_id")).select(*registry.columns)


def parents(registry: DataFrame) -> DataFrame:
    """The parent table: one row for each id (SNK-12, AGG-08)."""
    return registry.select("entity_id").distinct()


def children(source: DataFrame, registry: DataFrame, decisions: DataFrame, *, namespace: str, key: str, code: str, row_ref: str, schema: str, table: str, default: int = 0) -> DataFrame:
    """Rows of ``source`` with a key, on their parent's id, with the decision on their code or ``default`` (JOIN-02, JOIN-07, PRJ-06, FKC-01).

    Rows with blank keys drop out here; ``missing_keys`` has them. The child's own id is a digest of where the row comes from.
    """
    known = registry.where(F.col("source_namespace") == namespace).select(F.col("source_key").alias("_key"), "entity_id")
    dec = decisions.select(F.col("code").alias("_code"), "target_id")
    rows = source.withColumn("_strip", keys.strip(F.col(key).cast("string")))
    rows = rows.join(known, rows["_strip"] == known["_key"]).join(dec, rows[code] == dec["_code"], "left")
    ref = F.col(row_ref).cast("string")
    return rows.select(
        keys.surrogate_id(F.lit(schema), F.lit(table), ref).alias("child_id"), F.col("entity_id").alias("parent_id"), F.coalesce("target_id", F.lit(default).cast("bigint")).alias("concept_id"),
        F.lit(None).cast("date").alias("start_date"), ref.alias("source_row_ref"), F.col("_strip").alias("source_key"), F.lit(schema).alias("source_schema"), F.lit(table).alias("source_table"),
    )


def rebuild(child: DataFrame, registry: DataFrame, namespace: str) -> tuple[DataFrame, DataFrame]:
    """(children on the ids of a collapsed registry, parents): children first, so that none is without a parent (FKC-02)."""
    known = registry.where(F.col("source_namespace") == namespace).select("source_key", F.col("entity_id").alias("_id"))
    moved = child.join(known, "source_key", "left").withColumn("parent_id", F.coalesce("_id", "parent_id")).select(*child.columns)
    return moved, parents(registry)
