"""The knowledge graph as tables: one of nodes for each label, one of edges for each type.

Node tables have natural keys. Edges are (from, to, source_schema). Patterns are joins; a pattern's optional parts are left joins on
tables that were grouped before, so that optional parts never multiply each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.refs import table_key


def entity_columns(entities: DataFrame, entity_table: DataFrame, columns: DataFrame) -> DataFrame:
    """(entity, table, columns): the tables of each entity, with their columns in a list by position (JOIN-09, RSH-06)."""
    listed = columns.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("position", "column", "type"))).alias("columns"))
    return entities.join(entity_table, "entity").join(listed, "table", "left").select("entity", "table", F.coalesce("columns", F.array().cast(listed.schema["columns"].dataType)).alias("columns"))


def paths_touching(path_tables: DataFrame, tables: DataFrame) -> DataFrame:
    """Join paths that use any of ``tables``, each once (JOIN-10)."""
    return path_tables.join(tables, "table", "left_semi").select("path").distinct()


def metric_expansion(metrics: DataFrame, entity_of: DataFrame, dimensions: DataFrame, filters: DataFrame, grains: DataFrame) -> DataFrame:
    """(metric, entity, dimensions, filters, grains): sets, each grouped on its own (JOIN-11)."""
    out = metrics.join(entity_of, "metric")
    for table, name in ((dimensions, "dimensions"), (filters, "filters"), (grains, "grains")):
        own = table.groupBy("metric").agg(F.sort_array(F.collect_set("name")).alias(name))
        out = out.join(own, "metric", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def aliases(alias_edges: DataFrame, names: DataFrame) -> DataFrame:
    """(alias, label, name): what each alias refers to (JOIN-12)."""
    return alias_edges.join(names, alias_edges["to"] == names["id"]).select("alias", "label", "name")


def provenance(claims: DataFrame, subjects: DataFrame) -> DataFrame:
    """(id, label, name, predicate, source, confidence): claims about each node, by subject (JOIN-13, JOIN-27)."""
    return claims.join(subjects, claims["subject"] == subjects["ref"]).select("id", "label", "name", "predicate", "source", "confidence")


def claims_of_table(claims: DataFrame, tables: DataFrame) -> DataFrame:
    """Claims about a table or any of its columns, by the parsed table, so that it is an equality (JOIN-30, SRC-30)."""
    return claims.withColumn("_t", table_key(F.col("subject"))).join(tables.select(table_key(F.col("ref")).alias("_t")).distinct(), "_t", "left_semi").drop("_t")


def value_set_members(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(value_set, column, code): the terms of each column's set (JOIN-14)."""
    return sets.join(members, "value_set").select("value_set", "column", "code")


def sets_of_term(members: DataFrame, sets: DataFrame, column_table: DataFrame) -> DataFrame:
    """(code, value_set, column, table): where a term is used; the table may be unknown (JOIN-15)."""
    return members.join(sets, "value_set").join(column_table, "column", "left").select("code", "value_set", "column", "table")


def shared_terms(members: DataFrame) -> DataFrame:
    """(code, schemas): terms used in more than one schema (JOIN-31)."""
    found = members.groupBy("code").agg(F.sort_array(F.collect_set("source_schema")).alias("schemas"))
    return found.where(F.size("schemas") > 1)


def ancestors(parent_of: DataFrame, depth: int = 3) -> DataFrame:
    """(node, ancestor, distance) over edges (parent, child), up to ``depth`` steps; each pair at its shortest (JOIN-18).

    The steps are joins in a plan of fixed size; cycles end with the depth.
    """
    step = parent_of.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct()
    found = level = step.withColumn("distance", F.lit(1))
    up = step.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    for n in range(2, depth + 1):
        level = level.join(up, "ancestor").select("node", F.col("next").alias("ancestor")).distinct().withColumn("distance", F.lit(n))
        found = found.unionByName(level)
    return found.groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))


def prefix_hierarchy(values: DataFrame) -> DataFrame:
    """(parent, child): a value and its next shorter prefix among the values, at most three letters, digits or dots apart (FN-21, WIN-06).

    A child's prefixes are made from it and joined by equality, the nearest one is its parent; no value is compared with all others.
    """
    plain = values.select("value").where("value is not null and value <> ''").distinct()
    cuts = plain.select(F.col("value").alias("child"), F.explode(F.expr("filter(array(1, 2, 3), k -> k < length(value))")).alias("k"))
    cuts = cuts.where(F.expr("right(child, k)").rlike("^[.A-Za-z0-9]+$")).select("child", F.expr("left(child, length(child) - k)").alias("parent"), "k")
    met = cuts.join(plain.select(F.col("value").alias("parent")), "parent")
    return met.groupBy("child").agg(F.min_by("parent", "k").alias("parent")).select("parent", "child")


def drop_schema(edges: DataFrame, schema: str) -> DataFrame:
    """Edges without those of one study; edges without a scope stay (GRF-07)."""
    return edges.where(~F.col("source_schema").eqNullSafe(F.lit(schema)))


def drop_tables(edges: DataFrame, tables: DataFrame, end: str) -> DataFrame:
    """Edges without those that end in one of ``tables`` (GRF-08)."""
    return edges.join(tables.select(F.col("table").alias(end)), end, "left_anti")


def orphan_nodes(nodes: DataFrame, edges: list[DataFrame], key: str) -> DataFrame:
    """Nodes that no edge begins or ends in (GRF-09). Ends are made distinct first: the join's other side holds each node once."""
    ends = None
    for e in edges:
        both = e.select(F.col("from").alias(key)).unionByName(e.select(F.col("to").alias(key)))
        ends = both if ends is None else ends.unionByName(both)
    return nodes.join(ends.distinct(), key, "left_anti")


def stale_vocabularies(vocabularies: DataFrame, used: DataFrame, covered: DataFrame, failed: DataFrame) -> DataFrame:
    """Vocabularies that some schema used and none does now, if all those schemas were built in full (GRF-10, JOIN-29, SET-05).

    used: vocabulary, source_schema, current (boolean).
    """
    whole = covered.join(failed, "source_schema", "left_anti")
    before = used.where(~F.col("current"))
    open_ = before.join(whole, "source_schema", "left_anti")
    out = vocabularies.join(before, "vocabulary", "left_semi").join(used.where("current"), "vocabulary", "left_anti")
    return out.join(open_, "vocabulary", "left_anti")


def join_path_entities(paths: DataFrame, entity_table: DataFrame) -> DataFrame:
    """(path, from_entity, to_entity): either may be unknown (JOIN-28)."""
    a = entity_table.select(F.col("table").alias("from_table"), F.col("entity").alias("from_entity"))
    b = entity_table.select(F.col("table").alias("to_table"), F.col("entity").alias("to_entity"))
    return paths.join(a, "from_table", "left").join(b, "to_table", "left").select("path", "from_entity", "to_entity")


def decoded_values(claims: DataFrame, vocabulary_of: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(value sets, terms, members) from claims (column, code, label, source_schema) (GRF-03, JOIN-26, JOIN-35).

    A column's vocabulary is the winner's in ``vocabulary_of`` (column, vocabulary), else one of its own.
    """
    named = claims.join(vocabulary_of, "column", "left").withColumn("vocabulary", F.coalesce("vocabulary", F.concat(F.lit("set:"), F.col("column"))))
    sets = named.select(F.concat(F.lit("set:"), F.col("column")).alias("value_set"), "column", "source_schema").distinct()
    terms = named.groupBy("vocabulary", "code").agg(F.min("label").alias("label"))
    members = named.select(F.concat(F.lit("set:"), F.col("column")).alias("value_set"), "vocabulary", "code", "source_schema").distinct()
    return sets, terms, members


def current_generation(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Both generations; rows of keys that ``new`` touches are no longer current, unless they are its own (TGT-03)."""
    touched = new.select(*key).distinct().withColumn("_touched", F.lit(True))
    old = stored.join(touched, key, "left").withColumn("is_current", F.col("is_current") & F.col("_touched").isNull()).drop("_touched")
    return old.unionByName(new.withColumn("is_current", F.lit(True)))


def dangling(refs: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """References to things that are not declared (TGT-01)."""
    return refs.join(known.select(key).distinct(), key, "left_anti")
