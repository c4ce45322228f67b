"""Stored tables that change: scopes that are swapped, nodes and edges that are merged by key."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import keys
from weftline.operators import filters, profile, sketches, targets
from weftline.queries.base import query, table
from weftline.sources import accounts, objects
from weftline.sources.graphs import StoredGraph
from weftline.sources.scoped import KeyedTable, ScopedTable
from weftline.sources.staging import cut, new_path, remove


@contextmanager
def _home(spark: SparkSession, *names: str) -> Iterator[list[tuple[str, str]]]:
    """(table, folder) for each of ``names``; all are removed at the end."""
    made = [(f"{n}_{uuid.uuid4().hex}", new_path(spark, n)) for n in names]
    try:
        yield made
    finally:
        for name, path in made:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(spark, path)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN o_totalprice / 2 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('2-HIGH', '3-MEDIUM')
    UNION ALL SELECT o_orderkey, o_totalprice, '2-HIGH' FROM orders WHERE o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F'""")
def scoped_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-09 to SNK-11: all priorities are written, one scope at a time; then two are replaced and one is emptied."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    finished = table(spark, sf_dir, "orders").where("o_orderpriority = '3-MEDIUM' and o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", F.lit("2-HIGH").alias("o_orderpriority"))
    with _home(spark, "swapped") as [(name, path)]:
        stored = ScopedTable.create(o, name, ["o_orderpriority"], path=path)
        for p in PRIORITIES:
            stored.swap(o.where(F.col("o_orderpriority") == p), [(p,)])
        half = o.where("o_orderpriority = '1-URGENT'").withColumn("o_totalprice", F.col("o_totalprice") / 2)
        stored.swap(half.unionByName(finished), [("1-URGENT",), ("2-HIGH",)])
        stored.swap(o.where("false"), [("3-MEDIUM",)])
        stored.vacuum()
        return cut(stored.read().select("o_orderkey", "o_totalprice", "o_orderpriority"), "swapped")


@query("""WITH first AS (SELECT c_custkey AS id, c_mktsegment AS value, (c_custkey % 10)::DOUBLE / 10 AS confidence FROM customer),
    seen AS (SELECT o_custkey AS id, o_orderpriority AS value, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 10)::DOUBLE / 10 END AS confidence FROM orders UNION ALL SELECT s_suppkey - 1000000, s_name, 0.5 FROM supplier),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(confidence, -1) DESC, value) AS n FROM seen) WHERE n = 1)
    SELECT coalesce(f.id, b.id) AS id, CASE WHEN f.id IS NULL OR coalesce(b.confidence, -1) > f.confidence THEN b.value ELSE f.value END AS value,
        CASE WHEN f.id IS NULL OR coalesce(b.confidence, -1) > f.confidence THEN b.confidence ELSE f.confidence END AS confidence FROM first f FULL JOIN best b ON b.id = f.id""")
def stored_node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-18, AGG-20: customers are nodes; what orders say of them, and suppliers, are merged in by confidence, a priority at a time, and everything a second time."""
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("value"), ((F.col("c_custkey") % 10).cast("double") / 10.0).alias("confidence"))
    o, known = table(spark, sf_dir, "orders"), F.when(F.col("o_orderkey") % 7 > 0, (F.col("o_orderkey") % 10).cast("double") / 10.0)
    seen = o.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("value"), known.alias("confidence"))
    seen = seen.unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") - 1_000_000).alias("id"), F.col("s_name").alias("value"), F.lit(0.5).alias("confidence")))
    with _home(spark, "nodes") as [(name, path)]:
        stored = KeyedTable(first, name, ["id"], parts=4, buckets=2, path=path)
        stored.merge_confident(first)
        urgent = F.col("value").isin(PRIORITIES[:1])
        for new in (seen.where(urgent), seen.where(~urgent), seen):
            stored.merge_confident(new)
        return cut(stored.read(), "nodes")


@query("""WITH all_of AS (SELECT l_suppkey AS "from", l_partkey AS "to", l_shipdate AS shipped, l_quantity AS quantity, l_orderkey AS o, l_linenumber AS l FROM lineitem),
    last AS (SELECT "from", "to", quantity, shipped FROM (SELECT *, row_number() OVER (PARTITION BY "from", "to" ORDER BY shipped DESC, o DESC, l DESC) AS n FROM all_of) WHERE n = 1)
    SELECT "from", "to", quantity, shipped FROM last WHERE "from" % 10 > 0""")
def stored_edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-14, SNK-18, GRF-07: edges from suppliers to their parts, the last shipment on each; returned items come late; then the edges of some suppliers go."""
    line = table(spark, sf_dir, "lineitem")
    edges = line.select(F.col("l_suppkey").alias("from"), F.col("l_partkey").alias("to"), F.col("l_shipdate").alias("shipped"), F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), "l_returnflag")
    seconds = F.unix_micros(F.col("shipped").cast("timestamp"))
    later = F.struct("new.shipped", "new.o", "new.l") > F.struct("old.shipped", "old.o", "old.l")
    with _home(spark, "edges") as [(name, path)]:
        stored = KeyedTable(edges.drop("l_returnflag"), name, ["from", "to"], parts=4, buckets=2, path=path)
        for part in (edges.where("l_returnflag <> 'R'"), edges.where("l_returnflag = 'R'")):
            stored.merge(part.drop("l_returnflag"), [-seconds, -F.col("o"), -F.col("l")], later)
        stored.delete(edges.where("`from` % 10 = 0").select("from", "to"))
        return cut(stored.read().select("from", "to", "quantity", "shipped"), "edges")


_LINES = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*)::BIGINT AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_exact, true AS within FROM lineitem" for c in _LINES))
def profile_in_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03, AGG-05: a profile kept as lines arrive in four parts, one of them twice; its distinct counts are held against exact ones."""
    lines = table(spark, sf_dir, "lineitem")
    with _home(spark, "profiles") as [(name, path)]:
        kept = sketches.Profiles(lines, name, path)
        for part in (0, 1, 2, 3, 1):
            kept.arrive(lines.where(F.pmod("l_orderkey", F.lit(4)) == part), "lineitem", f"part {part}")
        found = cut(kept.profile(), "profile")
    exact = profile.profile(lines, "lineitem").select("column", F.col("n_distinct").alias("n_exact"))
    # small counts are told apart by the sketch: the bound is one value at least
    near = F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.greatest(F.lit(1.0), F.col("n_exact") * sketches.distinct_error())
    return found.join(exact, "column").select("column", "n_rows", "n_nulls", "n_exact", near.alias("within"))


_FREQUENT = {"l_suppkey": 10, "l_quantity": 20, "l_shipdate": 5, "l_orderkey": 7, "l_returnflag": 9}


@query(" UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS "column", {f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if c == 'l_shipdate' else f"{c}::VARCHAR"} AS value, count(*) AS frequency FROM lineitem GROUP BY 2 ORDER BY frequency DESC, value LIMIT {k})""" for c, k in _FREQUENT.items()
))
def frequent_values_in_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, PRJ-10: the most frequent values from sketches of two arrivals, made exact by a count of the candidates; where no value is frequent enough for that, all are counted."""
    lines = table(spark, sf_dir, "lineitem").select(*_FREQUENT)
    halves = [sketches.sketch(lines.where(F.pmod("l_orderkey", F.lit(2)) == part), "lineitem", f"half {part}") for part in (0, 1)]
    kept = cut(halves[0].unionByName(halves[1]), "sketches")
    found = [sketches.top_values(lines, kept, "lineitem", c, k).select(F.lit(c).alias("column"), "value", "frequency") for c, k in _FREQUENT.items()]
    return reduce(DataFrame.unionByName, found)


@query("""WITH source AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN '  ' WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey::VARCHAR END AS k, o_orderstatus, o_orderkey % 5 = 0 AS odd FROM orders),
    staged AS (SELECT o_orderstatus = 'P' AS none, o_orderstatus = 'P' AND NOT odd AS empty FROM source WHERE trim(coalesce(k, '')) <> '')
    SELECT (SELECT count(*) FROM source) AS source_rows, (SELECT count(*) FROM source) - count(*) AS missing_rows, count(*) AS written_rows, count_if(empty)::BIGINT AS null_rows, count_if(none)::BIGINT AS no_map_rows,
        0::BIGINT AS resolved_but_null, count_if(none AND NOT empty)::BIGINT AS no_map_but_populated, count_if(none AND NOT empty) = 0 AS passed FROM staged""")
def observed_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07, QA-01, QA-02, QA-06: orders are staged, some without a key and some with a target against their resolution; the counts come with the write."""
    key = F.when(F.col("o_orderkey") % 9 == 0, "  ").when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_custkey").cast("string"))
    source = table(spark, sf_dir, "orders").select("o_orderkey", key.alias("k"), "o_orderstatus", "o_orderpriority")

    def stage(rows: DataFrame) -> DataFrame:
        none = F.col("o_orderstatus") == "P"
        target = F.when(~none | (F.col("o_orderkey") % 5 == 0), F.col("o_orderkey"))
        return rows.where("trim(coalesce(k, '')) <> ''").select("k", target.alias("target_id"), F.when(none, "NO_MAP").otherwise("RESOLVED").alias("resolution"), "o_orderpriority")

    with _home(spark, "staged") as [(name, path)]:
        stored = ScopedTable.create(stage(source), name, ["o_orderpriority"], path=path)
        found = accounts.staged_swap(stored, source, stage, [(p,) for p in PRIORITIES], key="k")
    return accounts.as_row(found, source).drop("recounted")


_GRAPH = """part_of AS (SELECT p_partkey AS id, 's' || (p_partkey % 4) AS s, p_brand AS t, 'c' || (p_size % 5) AS c, p_name AS entity, p_type || ' ' || p_size AS property, p_name || '/' || p_size AS alias FROM part),
    edges AS (SELECT 'entity_on_table' AS kind, 'Entity' AS from_label, entity AS "from", 'Table' AS to_label, s || '.' || t AS "to", s AS source_schema FROM part_of
        UNION SELECT 'property_on_column', 'Property', property, 'Column', s || '.' || t || '.' || c, s FROM part_of UNION SELECT 'refers_to', 'Alias', alias, 'Entity', entity, s FROM part_of
        UNION SELECT 'provenance', 'Assertion', id || '@' || s || '.' || t || '.' || c, 'Property', property, s FROM part_of UNION SELECT 'parent_of', 'Term', c_mktsegment, 'Term', c_mktsegment || c_nationkey, NULL FROM customer),
    nodes AS (SELECT DISTINCT from_label AS label, "from" AS key, CASE WHEN from_label = 'Assertion' THEN source_schema END AS source_schema FROM edges UNION SELECT to_label, "to", NULL FROM edges
        UNION SELECT 'Entity', s_name, NULL FROM supplier UNION SELECT 'Alias', 'alias of nothing', NULL UNION SELECT 'Table', 's1.empty', NULL),
    gone AS (SELECT label, key FROM nodes WHERE (label = 'Assertion' AND (source_schema = 's1' OR regexp_extract(key, '@(.*)$', 1) LIKE 's2.Brand#2.%')) OR (label = 'Table' AND key = 's2.Brand#2') OR (label = 'Column' AND key LIKE 's2.Brand#2.%')),
    left_edges AS (SELECT * FROM edges e WHERE source_schema IS DISTINCT FROM 's1' AND NOT EXISTS (SELECT 1 FROM gone WHERE (label = from_label AND key = "from") OR (label = to_label AND key = "to"))),
    left_nodes AS (SELECT label, key FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.label = n.label AND g.key = n.key)
        AND NOT (label = 'Alias' AND NOT EXISTS (SELECT 1 FROM left_edges WHERE kind = 'refers_to' AND "from" = n.key))
        AND NOT (label IN ('Entity', 'Property', 'Term') AND NOT EXISTS (SELECT 1 FROM left_edges WHERE (from_label = n.label AND "from" = n.key) OR (to_label = n.label AND "to" = n.key))))"""


@query(f"""WITH {_GRAPH} SELECT 'node' AS what, label AS a, key AS b, NULL AS c, NULL AS source_schema FROM left_nodes UNION ALL SELECT 'edge', kind, "from", "to", source_schema FROM left_edges""")
def stored_graph_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-07 to GRF-09: a stored graph of all parts loses one study and one table, and then what no edge reaches."""
    p = table(spark, sf_dir, "part")
    s = F.concat(F.lit("s"), (F.col("p_partkey") % 4).cast("string"))
    t = F.concat_ws(".", s, "p_brand")
    c = F.concat(t, F.lit(".c"), (F.col("p_size") % 5).cast("string"))
    prop, alias = F.concat_ws(" ", "p_type", "p_size"), F.concat_ws("/", "p_name", "p_size")
    edge = lambda rows, kind, a, x, b, y, schema: rows.select(F.lit(kind).alias("kind"), F.lit(a).alias("from_label"), x.alias("from"), F.lit(b).alias("to_label"), y.alias("to"), schema.alias("source_schema"))
    segment = F.col("c_mktsegment")
    edges = reduce(DataFrame.unionByName, [
        edge(p, "entity_on_table", "Entity", F.col("p_name"), "Table", t, s), edge(p, "property_on_column", "Property", prop, "Column", c, s), edge(p, "refers_to", "Alias", alias, "Entity", F.col("p_name"), s),
        edge(p, "provenance", "Assertion", F.concat_ws("@", "p_partkey", c), "Property", prop, s),
        edge(table(spark, sf_dir, "customer"), "parent_of", "Term", segment, "Term", F.concat(segment, F.col("c_nationkey").cast("string")), F.lit(None).cast("string")),
    ])
    own = F.when(F.col("from_label") == "Assertion", F.col("source_schema"))
    ends = edges.select(F.col("from_label").alias("label"), F.col("from").alias("key"), own.alias("source_schema")).union(edges.select("to_label", "to", F.lit(None)))
    more = table(spark, sf_dir, "supplier").select(F.lit("Entity"), "s_name", F.lit(None)).union(spark.createDataFrame([("Alias", "alias of nothing", None), ("Table", "s1.empty", None)], "a string, b string, c string"))
    nodes = ends.union(more).withColumn("confidence", F.lit(0.5))
    with _home(spark, "graph") as [(name, path)]:
        g = StoredGraph(spark, name, path=path, parts=4, buckets=2)
        try:
            g.add(nodes, edges)
            g.delete_schema("s1")
            g.delete_table("s2", "Brand#2")
            found = g.nodes.read().select(F.lit("node").alias("what"), F.col("label").alias("a"), F.col("key").alias("b"), F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("source_schema"))
            return cut(found.union(g.read_edges().select(F.lit("edge"), "kind", "from", "to", "source_schema")), "graph")
        finally:
            for kind in ("nodes", "edges"):
                spark.sql(f"DROP TABLE IF EXISTS {name}_{kind}")


_KIND_OF = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(objects.KINDS)) + " END"
_LIST_OF = "CASE p_partkey % 7 WHEN 1 THEN 'risks' WHEN 4 THEN 'fields' WHEN 6 THEN 'sources' ELSE 'listed' END"


@query(f"""WITH p AS (SELECT *, {_KIND_OF} AS kind, {_LIST_OF} AS field, p_partkey % 7 IN (1, 4, 6) AS free FROM part),
    v AS (SELECT *, 1 AS version, p_size AS size FROM p UNION ALL SELECT *, 2, p_size + 1 FROM p WHERE p_partkey % 5 = 0 UNION ALL SELECT *, 2, p_size FROM p WHERE p_partkey % 5 > 0 AND NOT free),
    t AS (SELECT kind, p_partkey::VARCHAR AS id, version::BIGINT AS version, size, p_brand AS brand, '"brand":"' || p_brand || '"' AS b, '"' || field || '":[' || CASE WHEN free OR version = 1 THEN '"x","y"' ELSE '"y","x"' END || ']' AS l, '"size":{{"a":1,"n":' || size || '}}' AS s, field FROM v)
    SELECT kind, id, version, sha256('{{' || b || ',' || CASE WHEN field < 'size' THEN l || ',' || s ELSE s || ',' || l END || '}}') AS digest, brand, size FROM t""")
def plan_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-15: parts as plan objects of seven kinds, then once more with their keys and lists in another order, some of them changed; all versions are read back typed."""
    p = table(spark, sf_dir, "part")
    kind, field = F.expr(_KIND_OF).alias("kind"), F.expr(_LIST_OF)
    text = lambda *parts: F.concat(*(x if not isinstance(x, str) else F.lit(x) for x in parts)).alias("json")
    size = F.col("p_size").cast("string")
    more = (F.col("p_size") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)).cast("string")
    first = p.select(kind, F.col("p_partkey").alias("id"), text('{"brand":"', F.col("p_brand"), '","size":{"n":', size, ',"a":1},"', field, '":["x","y"]}'))
    second = p.select(kind, F.col("p_partkey").alias("id"), text('{"', field, '": ["y", "x"], "size": {"a": 1, "n": ', more, '}, "brand": "', F.col("p_brand"), '"}'))
    with _home(spark, "objects") as [(name, path)]:
        for arrived in (first, second, second, first.where("false")):
            objects.persist(spark, name, arrived, path)
        found = objects.read(spark, name)
        value = lambda at, of: F.try_variant_get("payload", at, of)
        return cut(found.select("kind", "id", "version", "digest", value("$.brand", "string").alias("brand"), value("$.size.n", "int").alias("size")), "objects")


@query("""SELECT event_id, sha256('{"k":' || (props ->> '$.k') || ',"user":' || user_id || '}') AS profile_hash, sha256(sha256(event_type) || '|v1|' || user_id) AS cache_key, event_id % 3 = 0 AS leaks FROM events""")
def provenance_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-33: digests of signatures with their keys in any order, cache keys, and prefixes that name their source."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    odd = F.concat(F.lit('{"user": '), user, F.lit(", "), F.substring("props", 2, 1000))
    even = F.concat(F.regexp_replace("props", "}$", ""), F.lit(', "user": '), user, F.lit("}"))
    prefix = F.concat(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, F.lit(" of ref")).otherwise(""))
    signature = F.when(F.col("event_id") % 2 == 0, even).otherwise(odd)
    return e.select("event_id", keys.profile_hash(signature).alias("profile_hash"), keys.cache_key(F.col("event_type"), F.lit("v1"), F.col("user_id")).alias("cache_key"), keys.leaks(prefix, F.lit("of ref")).alias("leaks"))


@query("""WITH declared AS (SELECT DISTINCT p_brand AS entity, p_type AS name, 'string' AS type, p_size % 2 = 0 AS nullable FROM part), ends AS (SELECT DISTINCT p_brand AS entity, unnest(['subject', 'object']) AS name, unnest([p_name, p_type]) AS target, unnest(['one', 'many']) AS cardinality FROM part WHERE p_brand > 'Brand#2'),
    joint AS (SELECT entity, name, type, nullable, 'DECLARED' AS kind, NULL AS target, NULL AS cardinality FROM declared UNION ALL SELECT entity, name, 'endpoint', name = 'object', 'ENDPOINT', target, cardinality FROM ends)
    SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY name, kind DESC, type, target NULLS FIRST, nullable)::INT AS place, name, type, nullable, kind, target, cardinality FROM joint""")
def endpoint_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TGT-02: brands as entities, some of them edges from a name to a type."""
    p = table(spark, sf_dir, "part")
    declared = p.select(F.col("p_brand").alias("entity"), F.col("p_type").alias("name"), F.lit("string").alias("type"), (F.col("p_size") % 2 == 0).alias("nullable"))
    end = lambda role, target, many: p.where("p_brand > 'Brand#2'").select(F.col("p_brand").alias("entity"), F.lit(role).alias("role"), F.col(target).alias("target"), F.lit(many).alias("cardinality"), F.lit(role == "object").alias("nullable"))
    return targets.properties(declared, end("subject", "p_name", "one").unionByName(end("object", "p_type", "many")))


@query("""WITH RECURSIVE needs AS (SELECT p_partkey AS stage, p_partkey // 7 AS needed FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 50 FROM part WHERE p_partkey > 0),
    stale AS (SELECT p_partkey AS stage FROM part WHERE p_partkey % 101 = 13 OR p_partkey % 97 = 5 UNION SELECT n.stage FROM stale s JOIN needs n ON n.needed = s.stage)
    SELECT p_partkey AS stage, CASE WHEN p_partkey IN (SELECT stage FROM stale) THEN 'run' ELSE 'skip' END AS state FROM part UNION ALL SELECT -1 - p_partkey, 'drop' FROM part WHERE p_partkey % 10 = 0""")
def guarded_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TGT-04: parts as stages that need two others; some have changed since the last run, some are new, and some are gone."""
    p = table(spark, sf_dir, "part")
    stage = F.col("p_partkey").alias("stage")
    content = lambda changed: targets.content_digests(p.select(stage, "p_name", "p_size", (F.col("p_retailprice") + F.when(changed, 1.0).otherwise(0.0)).alias("price")), "stage")
    some = p.where("p_partkey > 0")
    needs = some.select(stage, F.expr("p_partkey div 7").alias("needed")).union(some.select(stage, F.expr("p_partkey div 50")))
    before = targets.chained(content(F.lit(False)), needs).where("stage % 97 <> 5").unionByName(p.where("p_partkey % 10 = 0").select((-1 - F.col("p_partkey")).alias("stage"), F.lit("gone").alias("digest")))
    now = targets.chained(content((F.col("p_partkey") % 101 == 13) | (F.col("p_partkey") % 97 == 5)), needs)
    return targets.stages_to_run(now, before)


@query("""SELECT o_orderkey, 'status' AS asked FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'none' FROM orders UNION ALL SELECT o_orderkey, 'both' FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'""")
def optional_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10: one lookup, asked with one, no and both of its parameters."""
    o = table(spark, sf_dir, "orders")
    asked = {"status": ("F", None), "none": (None, None), "both": ("F", "5-LOW")}
    found = [filters.optional(o, {"o_orderstatus": s, "o_orderpriority": q}).select("o_orderkey", F.lit(n).alias("asked")) for n, (s, q) in asked.items()]
    return reduce(DataFrame.unionByName, found)
