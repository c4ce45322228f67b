"""A stored graph: nodes by label and key, edges by the study they come from; studies and tables are deleted where they lie, and what they leave without edges is swept up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.scoped import KeyedTable, ScopedTable
from weftline.sources.staging import Steps

#: Labels whose nodes are shared between studies and go when no edge is left, and those that belong to one study.
SHARED = ["Entity", "Property", "Term", "Vocabulary", "ValueSet"]
OWNED = ["Assertion", "JoinPath"]

NODE = "label string, key string, source_schema string, confidence double"
EDGE = "kind string, from_label string, from string, to_label string, to string, source_schema string, scope string"


def _scope(schema: Column | str) -> Column:
    """Edges of a study are one scope of the table, those of none another."""
    return F.coalesce(F.concat(F.lit("of "), schema), F.lit("of none"))


class StoredGraph:
    """nodes: label, key, source_schema, confidence; edges: kind, from_label, from, to_label, to, source_schema."""

    def __init__(self, spark: SparkSession, name: str, *, path: str, parts: int = 16, buckets: int = 8) -> None:
        self.spark = spark
        self.nodes = KeyedTable(spark.createDataFrame([], NODE), f"{name}_nodes", ["label", "key"], parts=parts, buckets=buckets, path=f"{path}/nodes")
        self.edges = ScopedTable.create(spark.createDataFrame([], EDGE), f"{name}_edges", ["scope"], path=f"{path}/edges")

    def read_edges(self) -> DataFrame:
        return self.edges.read().drop("scope")

    def add(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Merge nodes by confidence; edges join those of their study, each once (SNK-18). Nodes come first, so that no edge is stored before its ends."""
        self.nodes.merge_confident(nodes)
        new = edges.withColumn("scope", _scope(F.col("source_schema")))
        scopes = [(r[0],) for r in new.select("scope").distinct().collect()]  # one for each study
        both = self.edges.rows_of(scopes).unionByName(new) if scopes else new
        self.edges.swap(both.distinct(), scopes)

    def delete_schema(self, schema: str, *, keep_claims: bool = False) -> None:
        """GRF-07: the edges of one study, which are one scope and go at once; its claims and join paths with all their edges; then what is left without edges."""
        self.edges.swap(self.edges.read().where("false"), [(f"of {schema}",)])
        owned = [x for x in OWNED if not (keep_claims and x == "Assertion")]
        self.detach(self.nodes.read().where(F.col("label").isin(owned) & (F.col("source_schema") == schema)))
        self.sweep()

    def delete_table(self, schema: str, table: str, *, keep_claims: bool = False) -> None:
        """GRF-08: a table, its columns and the claims about them with all their edges; then what is left without edges. Other tables of the study stay as they are.

        Keys are ``schema.table`` and ``schema.table.column``; those of claims end in ``@`` and the key of what they are about.
        """
        own = f"{schema}.{table}"
        about = F.regexp_extract("key", "@(.*)$", 1)
        of_table = lambda k: (k == own) | k.startswith(f"{own}.")
        gone = ((F.col("label") == "Table") & (F.col("key") == own)) | ((F.col("label") == "Column") & F.col("key").startswith(f"{own}."))
        if not keep_claims:
            gone = gone | ((F.col("label") == "Assertion") & (F.col("source_schema") == schema) & of_table(about))
        self.detach(self.nodes.read().where(gone))
        self.sweep()

    def detach(self, gone: DataFrame) -> None:
        """Delete nodes with all their edges: only the scopes that such edges are in and the parts of these nodes are written. Edges go first, so that none is left without an end."""
        steps = Steps(self.spark)
        keys = steps.cut(gone.select("label", "key"), "gone")
        edges = self.edges.read()
        ends = [edges.join(keys.toDF(f"{end}_label", end), [f"{end}_label", end], "left_semi").select("scope") for end in ("from", "to")]
        scopes = [(r[0],) for r in ends[0].union(ends[1]).distinct().collect()]
        if scopes:
            rest = self.edges.rows_of(scopes)
            for end in ("from", "to"):
                rest = rest.join(keys.toDF(f"{end}_label", end), [f"{end}_label", end], "left_anti")
            self.edges.swap(rest, scopes)
        self.nodes.delete(keys)
        steps.finish()

    def sweep(self) -> None:
        """GRF-09: aliases that refer to nothing, then shared nodes without any edge.

        Nodes without edges take no edge with them, so nothing else loses its last one: a second sweep finds nothing.
        """
        edges = self.edges.read()
        named = edges.where("kind = 'refers_to'").select(F.col("from_label").alias("label"), F.col("from").alias("key")).distinct()
        self.detach(self.nodes.read().where("label = 'Alias'").join(named, ["label", "key"], "left_anti"))
        edges = self.edges.read()
        used = edges.select(F.col("from_label").alias("label"), F.col("from").alias("key")).union(edges.select("to_label", "to")).distinct()
        self.nodes.delete(self.nodes.read().where(F.col("label").isin(SHARED)).join(used, ["label", "key"], "left_anti"))
