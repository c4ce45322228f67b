"""From winning claims to the rows of semantic nodes: names, aliases, properties in their context, and join paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.refs import parse_ref
from weftline.operators.assertions import OUT, winner_by_standing

#: Predicates that name a thing in other words, and those that tell how tables join.
ALIAS_PREDICATES = ["has_alias", "has_synonym"]
JOIN_PREDICATES = ["joins_to", "has_join_evidence", "fk_to"]
_JOIN_PAYLOAD = (
    "join_predicates array<struct<left_table:string,left_column:string,right_table:string,right_column:string>>, hop_count int, cardinality string, sql_snippet string, from_table string, to_table string,"
    " pk_table string, pk_column string, fk_table string, fk_column string"
)


def table_ref(ref: Column) -> Column:
    """The reference without its last part."""
    return F.regexp_replace(ref, "/[^/]*$", "")


def said(claims: DataFrame, predicate: str, as_: str) -> DataFrame:
    """(subject, ``as_``): what the winning claim of ``predicate`` says about each subject."""
    best = winner_by_standing(claims.where(F.col("predicate") == predicate), ["subject", "predicate"], "id")
    return best.select("subject", F.get_json_object("payload", "$.value").alias(as_))


def aliases_by_label(claims: DataFrame) -> DataFrame:
    """(id, label, target, text, parent_name, parent_entity, is_preferred, source, confidence): live aliases and synonyms (GRF-04).

    Those of a column belong to its property, those of a table to its entity; names that no claim gives are those of the column or the table.
    Claims whose subject is no reference are left out.
    """
    rows = claims.where(F.col("predicate").isin(ALIAS_PREDICATES) & ~F.col("status").isin(OUT)).withColumn("_p", parse_ref(F.col("subject"))).where("_p is not null")
    of_column = F.col("_p.column").isNotNull()
    owner = said(claims, "has_entity_name", "_entity").withColumnRenamed("subject", "_owner")
    rows = rows.withColumn("_owner", F.when(of_column, table_ref(F.col("subject"))).otherwise(F.col("subject"))).join(owner, "_owner", "left").join(said(claims, "has_property_name", "_property"), "subject", "left")
    entity = F.coalesce("_entity", "_p.table")
    return rows.select(
        "id", F.when(of_column, "Property").otherwise("Entity").alias("label"), F.col("subject").alias("target"), F.coalesce(F.get_json_object("payload", "$.value"), F.lit("")).alias("text"),
        F.when(of_column, F.coalesce("_property", "_p.column")).otherwise(entity).alias("parent_name"), F.when(of_column, entity).alias("parent_entity"),
        F.coalesce(F.get_json_object("payload", "$.is_preferred").cast("boolean"), F.lit(False)).alias("is_preferred"), "source", "confidence",
    )


def properties(claims: DataFrame) -> DataFrame:
    """(subject, name, semantic_type, entity, column, table, schema): columns with a property's name, in their context (JOIN-25)."""
    rows = said(claims, "has_property_name", "name").withColumn("_p", parse_ref(F.col("subject"))).where("_p.column is not null").withColumn("_owner", table_ref(F.col("subject")))
    rows = rows.join(said(claims, "has_semantic_type", "_type"), "subject", "left").join(said(claims, "has_entity_name", "_entity").withColumnRenamed("subject", "_owner"), "_owner", "left")
    return rows.select("subject", "name", F.coalesce("_type", F.lit("free_text")).alias("semantic_type"), F.coalesce("_entity", "_p.table").alias("entity"), "_p.column", "_p.table", "_p.schema")


def entities(claims: DataFrame) -> DataFrame:
    """(subject, entity, table, schema): tables with an entity's name."""
    rows = said(claims, "has_entity_name", "entity").withColumn("_p", parse_ref(F.col("subject"))).where("_p is not null and _p.column is null")
    return rows.select("subject", "entity", "_p.table", "_p.schema")


def join_paths(claims: DataFrame) -> DataFrame:
    """(subject, name, predicates, hop_count, cardinality, sql_snippet, from_table, to_table, source, confidence): the winner of each subject over all predicates about joins (GRF-06).

    A foreign key (``fk_to``) is a path of one equality, from the table of the key it refers to (the claim's object) to its own.
    """
    live = claims.where(F.col("predicate").isin(JOIN_PREDICATES))
    best = winner_by_standing(live, ["subject"], "id").withColumn("p", F.from_json("payload", _JOIN_PAYLOAD))
    key = F.col("predicate") == "fk_to"
    one = F.array(F.struct(F.col("p.pk_table").alias("left_table"), F.col("p.pk_column").alias("left_column"), F.col("p.fk_table").alias("right_table"), F.col("p.fk_column").alias("right_column")))
    found = best.withColumn("predicates", F.when(key, one).otherwise(F.coalesce("p.join_predicates", F.array().cast(one_type()))))
    side = lambda x, s: F.concat_ws("/", x[f"{s}_table"], x[f"{s}_column"])
    name = F.array_join(F.transform("predicates", lambda x: F.concat(side(x, "left"), F.lit("="), side(x, "right"))), "|")
    return found.select(
        "subject", name.alias("name"), "predicates", F.when(key, 1).otherwise(F.coalesce("p.hop_count", F.lit(1))).alias("hop_count"), F.col("p.cardinality"), F.col("p.sql_snippet"),
        F.when(key, table_ref(F.coalesce("object", F.lit("")))).otherwise(F.col("p.from_table")).alias("from_table"), F.when(key, table_ref(F.col("subject"))).otherwise(F.col("p.to_table")).alias("to_table"), "source", "confidence",
    )


def one_type() -> str:
    return "array<struct<left_table:string,left_column:string,right_table:string,right_column:string>>"


def path_uses(paths: DataFrame) -> DataFrame:
    """(name, table, column): the tables (column null) and columns that each path uses, once."""
    ends = paths.select("name", F.explode("predicates").alias("p")).select("name", F.explode(F.array(*(F.struct(F.col(f"p.{s}_table").alias("table"), F.col(f"p.{s}_column").alias("column")) for s in ("left", "right")))).alias("e")).select("name", "e.*")
    ends = ends.where("`table` is not null and `table` <> ''")
    return ends.select("name", "table", F.lit(None).cast("string").alias("column")).unionByName(ends.where("`column` is not null and `column` <> ''")).distinct()


def join_shape(snippet: Column, predicates: Column) -> Column:
    """FN-32: one text for how tables join: the snippet, else the predicates as JSON."""
    return F.coalesce(snippet, F.to_json(predicates))
