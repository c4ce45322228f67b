"""From questions to ranked, deduplicated and pruned context (VEC-06, VEC-11)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import graph, retrieve

HIT = ["question_id", "label", "name", "score", "confidence", "match", "status"]


def hits(questions: DataFrame, nodes: DataFrame, vectors: DataFrame | None = None, question_vectors: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Lexical hits and, with vectors (label, name, confidence, id, vector), the nearest ones; the best hit of each node, with a final score."""
    found = retrieve.lexical_seeds(questions, nodes).withColumn("status", F.lit("ACTIVE")).select(*HIT)
    if vectors is not None and question_vectors is not None:
        near = retrieve.nearest(question_vectors.select(F.col("question_id").alias("query_id"), F.col("vector").alias("query")), vectors.select("id", "vector"), k)
        named = near.join(vectors.select("id", "label", "name", "confidence"), "id")
        found = found.unionByName(named.select(F.col("query_id").alias("question_id"), "label", "name", "score", "confidence", F.lit("vector").alias("match"), F.lit("ACTIVE").alias("status")))
    return retrieve.ranked(found)


@dataclass
class Knowledge:
    """The parts of a graph that hits are followed into."""

    entity_table: DataFrame  # entity, table
    columns: DataFrame  # table, column, property, semantic_type
    path_tables: DataFrame  # path, table, confidence
    sets: DataFrame  # value_set, table, column
    members: DataFrame  # value_set, code
    metrics: DataFrame  # metric, entity
    terms: DataFrame  # code, vocabulary
    parent_of: DataFrame  # parent, child
    aliases: DataFrame  # text, label, target


@dataclass
class Expansion:
    """All tables have question_id: entities (entity, confidence), columns (table, column, property), paths (path, confidence), values (property, code),
    metrics (metric), vocabularies (code, vocabulary, ambiguous), ancestry (node, ancestor, distance)."""

    entities: DataFrame
    columns: DataFrame
    paths: DataFrame
    values: DataFrame
    metrics: DataFrame
    vocabularies: DataFrame
    ancestry: DataFrame

    def context(self) -> DataFrame:
        """VEC-11: one row for each question, pruned."""
        return retrieve.context(self.entities, self.paths, self.values)


#: Fixed value: how sure an entity is that only one of its properties was hit.
BY_PROPERTY = 0.6


def dereferenced(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """VEC-09: hits (question_id, label, name, confidence) with aliases replaced by what they refer to; an alias with a target of no known label is an entity's, one without a target goes."""
    targets = aliases.select(F.col("text").alias("name"), F.lower("label").alias("_label"), "target")
    met = found.where("label = 'alias'").join(targets, "name").where("target is not null")
    label = F.when(F.col("_label").isin("property", "term"), F.col("_label")).otherwise("entity")
    return found.where("label <> 'alias'").unionByName(met.select("question_id", label.alias("label"), F.col("target").alias("name"), "confidence"))


def expand(found: DataFrame, graph_: Knowledge, steps: int = 3) -> Expansion:
    """VEC-07 to VEC-10: from all hits of all questions to tables, join paths, values, metrics, vocabularies and ancestors, each by one join."""
    hit = dereferenced(found.select("question_id", "label", "name", "confidence"), graph_.aliases)
    own = hit.where("label = 'entity'").select("question_id", F.col("name").alias("entity"), "confidence")
    by_property = hit.where("label = 'property'").select("question_id", F.col("name").alias("property")).join(graph_.columns, "property").join(graph_.entity_table, "table")
    entities = own.unionByName(by_property.select("question_id", "entity", F.lit(BY_PROPERTY).alias("confidence"))).groupBy("question_id", "entity").agg(F.max("confidence").alias("confidence"))
    tables = entities.join(graph_.entity_table, "entity").select("question_id", "table").distinct()
    columns = tables.join(graph_.columns, "table")
    values = columns.where("semantic_type = 'categorical'").join(graph_.sets, ["table", "column"]).join(graph_.members, "value_set").select("question_id", "property", "code").distinct()
    paths = graph_.path_tables.join(tables, "table").groupBy("question_id", "path").agg(F.max("confidence").alias("confidence"))
    terms = hit.where("label = 'term'").select("question_id", "name").distinct()
    up = graph.ancestors(graph_.parent_of, steps)
    return Expansion(
        entities, columns.select("question_id", "table", "column", "property"), paths, values, entities.join(graph_.metrics, "entity").select("question_id", "metric").distinct(),
        retrieve.term_expansion(graph_.terms, terms), terms.select("question_id", F.col("name").alias("node")).join(up, "node"),
    )
