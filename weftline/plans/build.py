"""From a catalog to winning claims and graph tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.refs import parse_ref
from weftline.operators import assertions, graph, naming, profile
from weftline.operators.ranked import pick


@dataclass
class Graph:
    tables: DataFrame
    columns: DataFrame
    has_column: DataFrame
    joins: DataFrame


def claims_of_catalog(columns: DataFrame, run_id: str, workspace: str, catalog: str) -> DataFrame:
    """Claims of all columns (schema, table, column, type, comment), with ids made from what they say (PRJ-08, GRF-11)."""
    ref = F.concat_ws("/", F.lit(f"databricks://{workspace}/{catalog}"), "schema", "table", "column")
    rows = assertions.from_columns(columns.select(ref.alias("ref"), "type", "comment"))
    claims = rows.select(F.sha2(F.concat_ws("|", "subject", "predicate", "payload", F.lit(run_id)), 256).alias("id"), "*").withColumns({
        "object": F.lit(None).cast("string"), "source": F.lit("unity_catalog"), "confidence": F.lit(1.0), "status": F.lit("auto"), "run_id": F.lit(run_id),
    })
    return assertions.with_family(claims)


def join_claims(columns: DataFrame, evidence: DataFrame) -> DataFrame:
    """(child_table, child_column, parent_table, parent_column, tier, confidence): key candidates with what their values say (AGG-32, FLT-16)."""
    met = profile.key_candidates(columns).join(evidence, ["child_table", "child_column", "parent_table", "parent_column"], "left")
    return profile.key_tier(met.fillna(0, ["n_child", "n_met", "n_parent", "n_parent_rows"]))


def materialise(columns: DataFrame, joins: DataFrame, least: float = 0.80) -> Graph:
    """Node and edge tables, in the order nodes, then edges (GRF-01, GRF-06)."""
    tables = columns.select("schema", "table").distinct()
    nodes = pick(columns, ["schema", "table", "column"], [F.col("position"), F.col("type"), F.col("comment")])
    edges = nodes.select(F.concat_ws(".", "schema", "table").alias("from"), F.concat_ws(".", "schema", "table", "column").alias("to"), F.col("schema").alias("source_schema"))
    return Graph(tables, nodes, edges, joins.where(F.col("confidence") >= least))


def orphans(g: Graph) -> DataFrame:
    """Tables without columns."""
    named = g.tables.select(F.concat_ws(".", "schema", "table").alias("id"))
    return graph.orphan_nodes(named, [g.has_column], "id")


@dataclass
class Semantics:
    """What claims of one scope become, in the order of writing: physical nodes, semantic nodes, edges between them, provenance."""

    tables: DataFrame
    columns: DataFrame
    entities: DataFrame
    properties: DataFrame
    aliases: DataFrame
    join_paths: DataFrame
    entity_on_table: DataFrame
    property_on_column: DataFrame
    refers_to: DataFrame
    uses: DataFrame
    provenance: DataFrame


def unified(claims: DataFrame, source_schema: str | None = None) -> Semantics:
    """All nodes and edges of a scope's claims (GRF-01, GRF-02). The scope is found before anything is made, so no edge is without one.

    claims: id, subject, predicate, payload, object, source, confidence, status.
    """
    parsed = claims.withColumn("_p", parse_ref(F.col("subject"))).where("_p is not null")
    if source_schema is None:
        found = [r[0] for r in parsed.select("_p.schema").where("schema is not null").distinct().limit(2).collect()]
        if len(found) != 1:
            raise ValueError("the claims are of no schema or of several; say which one they belong to")
        source_schema = found[0]
    scope = F.lit(source_schema).alias("source_schema")
    tables = parsed.select("_p.schema", "_p.table").where("`table` is not null").distinct()
    columns = parsed.select("_p.schema", "_p.table", "_p.column").where("`column` is not null").distinct()
    entities, properties = naming.entities(claims), naming.properties(claims)
    aliases, paths = naming.aliases_by_label(claims), naming.join_paths(claims)
    return Semantics(
        tables, columns, entities, properties, aliases, paths,
        entities.select(F.col("entity").alias("from"), F.col("subject").alias("to"), scope),
        properties.select(F.col("name").alias("from"), F.col("subject").alias("to"), scope),
        aliases.select(F.col("text").alias("from"), F.col("target").alias("to"), scope).distinct(),
        naming.path_uses(paths).select(F.col("name").alias("from"), F.concat_ws(".", "table", "column").alias("to"), scope),
        parsed.select(F.col("id").alias("from"), F.col("subject").alias("to"), scope),
    )


def resume(stored: DataFrame, events: DataFrame, source_schema: str | None = None) -> Semantics:
    """The graph anew from stored claims and the log of their status, without asking any source again (GRF-13)."""
    once = pick(stored, ["id"], [F.col("observed_at")])
    return unified(assertions.effective_status(once, events), source_schema)
