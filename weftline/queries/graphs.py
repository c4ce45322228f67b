"""The graph's joins and its lifecycle, on the catalog and on parts, orders and events as terms and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.operators.profile import columns_of
from weftline.queries.base import query, table
from weftline.queries.catalog import CATALOG_SQL, TABLES, catalog

_ENTITIES = [("Buyer", "customer"), ("Order", "orders"), ("Order", "order"), ("Ghost", "missing")]
_ENTITY_SQL = "entity_table(entity, \"table\") AS (VALUES " + ", ".join(f"('{e}', '{t}')" for e, t in _ENTITIES) + ")"


def _entity_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_ENTITIES, "entity string, table string")


@query(f"""WITH {CATALOG_SQL}, {_ENTITY_SQL} SELECT e.entity, e."table", coalesce(string_agg(c."column", ',' ORDER BY c.position), '') AS columns FROM entity_table e LEFT JOIN catalog c ON c."table" = e."table" GROUP BY e.entity, e."table" """)
def graph_entity_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-09, RSH-06."""
    et = _entity_table(spark)
    found = graph.entity_columns(et.select("entity").distinct(), et, catalog(spark, sf_dir))
    return found.select("entity", "table", F.array_join(F.transform("columns", lambda c: c["column"]), ",").alias("columns"))


_KEYS = {"c_nationkey": "nation", "s_nationkey": "nation", "n_regionkey": "region", "o_custkey": "customer", "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}
_PATH_SQL = "key_of(column_name, to_table) AS (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in _KEYS.items()) + "), paths AS (SELECT \"table\" || '.' || column_name AS path, \"table\" AS from_table, to_table FROM described JOIN key_of USING (column_name))"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each column of the tables that is a key of another table."""
    real = columns_of({t: table(spark, sf_dir, t) for t in TABLES}, "sf")
    key_of = spark.createDataFrame([*_KEYS.items()], "column string, to_table string")
    return real.join(key_of, "column").select(F.concat_ws(".", "table", "column").alias("path"), F.col("table").alias("from_table"), "to_table")


@query(f"WITH {CATALOG_SQL}, {_PATH_SQL} SELECT path FROM paths WHERE from_table IN ('orders', 'part') OR to_table IN ('orders', 'part')")
def join_paths_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10."""
    p = _paths(spark, sf_dir)
    uses = p.select("path", F.col("from_table").alias("table")).unionByName(p.select("path", F.col("to_table").alias("table")))
    return graph.paths_touching(uses, spark.createDataFrame([("orders",), ("part",)], "table string"))


@query(f"""WITH {CATALOG_SQL}, {_PATH_SQL}, {_ENTITY_SQL} SELECT path, a.entity AS from_entity, b.entity AS to_entity FROM paths p LEFT JOIN entity_table a ON a."table" = p.from_table LEFT JOIN entity_table b ON b."table" = p.to_table""")
def join_path_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-28, GRF-06."""
    return graph.join_path_entities(_paths(spark, sf_dir), _entity_table(spark))


@query("""WITH grain AS (SELECT DISTINCT o_orderstatus AS metric, 'd' || o_orderkey % 3 AS name FROM orders WHERE o_orderstatus <> 'O'), dims AS (SELECT DISTINCT o_orderstatus AS metric, o_orderpriority AS name FROM orders), flt AS (SELECT DISTINCT o_orderstatus AS metric, 'f' || (o_custkey % 3) AS name FROM orders WHERE o_custkey % 5 = 0 AND o_orderstatus <> 'P')
    SELECT m.metric, 'Order' AS entity, (SELECT coalesce(string_agg(name, ',' ORDER BY name), '') FROM dims d WHERE d.metric = m.metric) AS dimensions, (SELECT coalesce(string_agg(name, ',' ORDER BY name), '') FROM flt f WHERE f.metric = m.metric) AS filters, (SELECT coalesce(string_agg(name, ',' ORDER BY name), '') FROM grain g WHERE g.metric = m.metric) AS grains
    FROM (SELECT DISTINCT o_orderstatus AS metric FROM orders) m""")
def metric_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-11."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "metric")
    metrics = o.select("metric").distinct()
    dims = o.select("metric", F.col("o_orderpriority").alias("name"))
    flt = o.where("o_custkey % 5 = 0 and metric <> 'P'").select("metric", F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("name"))
    grains = o.where("metric <> 'O'").select("metric", F.concat(F.lit("d"), (F.col("o_orderkey") % 3).cast("string")).alias("name"))
    found = graph.metric_expansion(metrics, metrics.withColumn("entity", F.lit("Order")), dims, flt, grains)
    return found.select("metric", "entity", *(F.array_join(c, ",").alias(c) for c in ("dimensions", "filters", "grains")))


_TYPES = "edges AS (SELECT DISTINCT p_brand AS parent, p_brand || '/' || p_size AS child FROM part UNION SELECT DISTINCT p_brand || '/' || p_size, p_brand || '/' || p_size || '/' || (p_partkey % 4) FROM part UNION SELECT 'all', p_brand FROM part UNION SELECT 'any', 'all')"


@query(f"""WITH RECURSIVE {_TYPES}, up AS (SELECT child AS node, parent AS ancestor, 1 AS distance FROM edges UNION ALL SELECT up.node, e.parent, up.distance + 1 FROM up JOIN edges e ON e.child = up.ancestor WHERE up.distance < 3)
    SELECT node, ancestor, min(distance)::INT AS distance FROM up GROUP BY node, ancestor""")
def graph_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-18, GRF-05."""
    p = table(spark, sf_dir, "part")
    two = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))
    three = F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), (F.col("p_partkey") % 4).cast("string"))
    edges = p.select(F.col("p_brand").alias("parent"), two.alias("child")).union(p.select(two, three)).union(p.select(F.lit("all"), "p_brand")).union(spark.createDataFrame([("any", "all")], "parent string, child string"))
    return graph.ancestors(edges.distinct(), 3)


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders")
    members = o.select(F.lit("set:status").alias("value_set"), F.col("o_orderstatus").alias("code"), F.lit("a").alias("source_schema")).distinct()
    members = members.union(o.select(F.lit("set:priority"), "o_orderpriority", F.lit("a")).distinct()).union(o.where("o_orderstatus <> 'P'").select(F.lit("set:old"), "o_orderstatus", F.lit("b")).distinct())
    return spark.createDataFrame([("set:status", "o_orderstatus"), ("set:priority", "o_orderpriority"), ("set:old", "old_status")], "value_set string, column string"), members


_MEMBERS = """sets(value_set, "column") AS (VALUES ('set:status', 'o_orderstatus'), ('set:priority', 'o_orderpriority'), ('set:old', 'old_status')),
    members AS (SELECT DISTINCT 'set:status' AS value_set, o_orderstatus AS code, 'a' AS source_schema FROM orders UNION ALL SELECT DISTINCT 'set:priority', o_orderpriority, 'a' FROM orders UNION ALL SELECT DISTINCT 'set:old', o_orderstatus, 'b' FROM orders WHERE o_orderstatus <> 'P')"""


@query(f"""WITH {_MEMBERS} SELECT value_set, "column", code FROM sets JOIN members USING (value_set)""")
def value_set_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-14."""
    return graph.value_set_members(*_members(spark, sf_dir))


@query(f"""WITH {_MEMBERS} SELECT code, value_set, "column", CASE WHEN starts_with("column", 'o_') THEN 'orders' END AS "table" FROM sets JOIN members USING (value_set)""")
def term_value_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-15 to JOIN-17."""
    sets, members = _members(spark, sf_dir)
    return graph.sets_of_term(members, sets, spark.createDataFrame([("o_orderstatus", "orders"), ("o_orderpriority", "orders")], "column string, table string"))


@query(f"WITH {_MEMBERS} SELECT code, string_agg(DISTINCT source_schema, ',' ORDER BY source_schema) AS schemas FROM members GROUP BY code HAVING count(DISTINCT source_schema) > 1")
def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-31."""
    return graph.shared_terms(_members(spark, sf_dir)[1]).select("code", F.array_join("schemas", ",").alias("schemas"))


_EDGES = "edges AS (SELECT -1 - o_orderkey AS \"from\", CASE WHEN o_custkey % 3 > 0 THEN o_custkey ELSE o_custkey + 1 END AS \"to\", CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE 's' || (o_orderkey % 4) END AS source_schema FROM orders)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    customer = F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1)  # so that some are in no edge
    return table(spark, sf_dir, "orders").select((-1 - i).alias("from"), customer.alias("to"), F.when(i % 4 != 3, F.concat(F.lit("s"), (i % 4).cast("string"))).alias("source_schema"))


@query(f"""WITH {_EDGES} SELECT * FROM edges WHERE source_schema IS DISTINCT FROM 's1'""")
def study_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-07."""
    return graph.drop_schema(_edges(spark, sf_dir), "s1")


@query(f"""WITH {_EDGES} SELECT * FROM edges WHERE "to" NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 1)""")
def table_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-08."""
    return graph.drop_tables(_edges(spark, sf_dir), table(spark, sf_dir, "customer").where("c_nationkey = 1").select(F.col("c_custkey").alias("table")), "to")


@query(f"""WITH {_EDGES} SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT "from" FROM edges UNION SELECT "to" FROM edges)""")
def orphan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-09."""
    return graph.orphan_nodes(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), [_edges(spark, sf_dir)], "id")


_USED = "used AS (SELECT DISTINCT event_type || '-' || (event_id % 50) AS vocabulary, 's' || (event_id % 50 % 7) AS source_schema, event_id % 50 % 4 = 0 AS current FROM events)"


@query(f"""WITH {_USED}, whole(s) AS (VALUES ('s0'), ('s1'), ('s2'), ('s3'), ('s5'), ('s6')) SELECT DISTINCT vocabulary FROM used u WHERE NOT current AND NOT EXISTS (SELECT 1 FROM used x WHERE x.vocabulary = u.vocabulary AND x.current)
    AND NOT EXISTS (SELECT 1 FROM used x WHERE x.vocabulary = u.vocabulary AND NOT x.current AND x.source_schema NOT IN (SELECT s FROM whole))""")
def stale_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-10, JOIN-29, SET-05."""
    i = F.col("event_id")
    used = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", (i % 50).cast("string")).alias("vocabulary"), F.concat(F.lit("s"), (i % 50 % 7).cast("string")).alias("source_schema"), (i % 50 % 4 == 0).alias("current")).distinct()
    schemas = spark.createDataFrame([(f"s{n}",) for n in range(7)], "source_schema string")
    return graph.stale_vocabularies(used.select("vocabulary").distinct(), used, schemas, schemas.where("source_schema = 's4'"))


#: The kinds of edges that belong to a study, by the labels that they join.
SHAPES = [
    "Entity HAS_PROPERTY Property", "Entity ENTITY_ON_TABLE Table", "Property PROPERTY_ON_COLUMN Column", "Property CLASSIFIED_AS Vocabulary", "Column HAS_VALUE_SET ValueSet", "Term MEMBER_OF ValueSet",
    "Alias REFERS_TO Entity", "Alias REFERS_TO Property", "JoinPath USES Table", "JoinPath FROM_ENTITY Entity", "JoinPath TO_ENTITY Entity",
]


@query(" UNION ALL ".join(f"SELECT '{name}' AS shape, count_if(l_linenumber > {1 + i % 5})::BIGINT AS n_nulls FROM lineitem WHERE l_partkey % {len(SHAPES)} = {i}" for i, name in enumerate(SHAPES)))
def unscoped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-07: all kinds of edges; some have lost their scope."""
    from weftline.operators.quality import unscoped

    rows = table(spark, sf_dir, "lineitem")
    edges = {name: rows.where(F.col("l_partkey") % len(SHAPES) == i).select(F.col("l_orderkey").alias("from"), F.col("l_partkey").alias("to"), F.when(F.col("l_linenumber") <= 1 + i % 5, F.lit("s")).alias("source_schema")) for i, name in enumerate(SHAPES)}
    return unscoped(edges)


_VALUES = """v AS (SELECT DISTINCT value FROM (SELECT unnest([left(p_type, 1), left(p_type, 3), p_type, replace(p_brand, 'Brand#', 'B'), replace(p_brand, 'Brand#', 'B') || '.' || p_size % 7, replace(p_brand, 'Brand#', 'B') || '.' || p_size % 7 || (p_size % 3)]) AS value FROM part))"""


@query(f"""WITH {_VALUES}, p AS (SELECT a.value AS parent, b.value AS child FROM v a JOIN v b ON starts_with(b.value, a.value) AND length(b.value) > length(a.value)
    WHERE regexp_matches(substr(b.value, length(a.value) + 1), '^[.A-Za-z0-9]{{1,3}}$'))
    SELECT parent, child FROM p WHERE NOT EXISTS (SELECT 1 FROM v WHERE starts_with(p.child, v.value) AND starts_with(v.value, p.parent) AND length(v.value) > length(p.parent) AND length(v.value) < length(p.child))""")
def value_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-21, WIN-06: types and brands with codes under them."""
    b = F.regexp_replace("p_brand", "Brand#", "B")
    two = F.concat(b, F.lit("."), (F.col("p_size") % 7).cast("string"))
    all_ = F.array(F.left("p_type", F.lit(1)), F.left("p_type", F.lit(3)), F.col("p_type"), b, two, F.concat(two, (F.col("p_size") % 3).cast("string")))
    return graph.prefix_hierarchy(table(spark, sf_dir, "part").select(F.explode(all_).alias("value")).distinct())


@query("""WITH old AS (SELECT p_partkey AS key, p_brand AS v, true AS is_current FROM part WHERE p_partkey % 3 < 2), new AS (SELECT p_partkey AS key, 'new' AS v FROM part WHERE p_partkey % 3 > 0)
    SELECT key, v, is_current AND key NOT IN (SELECT key FROM new) AS is_current FROM old UNION ALL SELECT key, v, true FROM new""")
def current_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TGT-03."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("v"))
    return graph.current_generation(p.where("key % 3 < 2").withColumn("is_current", F.lit(True)), p.where("key % 3 > 0").withColumn("v", F.lit("new")), ["key"])


@query("""SELECT o_orderkey, o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)""")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TGT-01."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey")
    return graph.dangling(o, table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("key")), "key")
