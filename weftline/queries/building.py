"""From claims to the nodes and edges of a graph, and from hits into it: parts stand for claims, orders for hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import filters, naming, quality
from weftline.plans import answer, build
from weftline.queries.base import query, table
from weftline.queries.claims import _PRECEDENCE, _RANK, SOURCES, _case, _case_sql

_PREDICATE = {0: "has_alias", 1: "has_synonym", 2: "has_name", 3: "has_semantic_type", 4: "joins_to", 5: "has_join_evidence", 6: "fk_to"}
_STATUS = {0: "rejected", 1: "accepted", 2: "pinned"}

#: The same claims in both engines. Subjects are tables named by brand, and five columns of each.
CLAIMS = f"""raw AS (SELECT p_partkey AS id, p_partkey % 3 > 0 OR p_partkey % 7 = 6 AS of_column, 'databricks://w/c/s/' || p_brand AS t, 'c' || (p_size % 5) AS c, p_type AS v, p_size AS n, {_case_sql('p_partkey % 7', _PREDICATE, '')} AS k,
    {_case_sql('p_partkey % 5', SOURCES, 'other')} AS source, (p_size % 10)::DOUBLE / 10::DOUBLE AS confidence, {_case_sql('p_partkey % 11', _STATUS, 'auto')} AS status, p_brand AS brand FROM part),
    claims AS (SELECT *, CASE WHEN of_column THEN t || '/' || c ELSE t END AS subject, CASE WHEN k = 'has_name' THEN CASE WHEN of_column THEN 'has_property_name' ELSE 'has_entity_name' END ELSE k END AS predicate FROM raw),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY {_RANK}, CASE WHEN {_RANK} = 2 THEN -{_PRECEDENCE} ELSE 0 END, CASE WHEN {_RANK} = 2 THEN -confidence ELSE 0 END, id) AS r FROM claims WHERE status <> 'rejected') WHERE r = 1)"""
_ALIASES = """aliases AS (SELECT a.id, CASE WHEN a.of_column THEN 'Property' ELSE 'Entity' END AS label, a.subject AS target, a.v AS text, CASE WHEN a.of_column THEN coalesce(p.v, a.c) ELSE coalesce(e.v, a.brand) END AS parent_name,
    CASE WHEN a.of_column THEN coalesce(e.v, a.brand) END AS parent_entity, a.n % 2 = 0 AS is_preferred, a.source, a.confidence FROM claims a LEFT JOIN best p ON p.subject = a.subject AND p.predicate = 'has_property_name' AND a.of_column
    LEFT JOIN best e ON e.subject = a.t AND e.predicate = 'has_entity_name' WHERE a.k IN ('has_alias', 'has_synonym') AND a.status <> 'rejected')"""
_PROPERTIES = """properties AS (SELECT p.subject, p.v AS name, coalesce(s.v, 'free_text') AS semantic_type, coalesce(e.v, p.brand) AS entity, p.c AS "column", p.brand AS "table", 's' AS schema FROM best p LEFT JOIN best s ON s.subject = p.subject AND s.predicate = 'has_semantic_type'
    LEFT JOIN best e ON e.subject = p.t AND e.predicate = 'has_entity_name' WHERE p.predicate = 'has_property_name')"""
_PATHS = f"""paths AS (SELECT subject, k, n, source, confidence, CASE WHEN k = 'fk_to' THEN 'pk' || n || '/id=' || brand || '/' || c WHEN n % 2 = 0 THEN 'a/x=b/y|b/z=c' || n || '/z' ELSE 'a/x=b/y' END AS name, CASE WHEN k = 'fk_to' THEN 1 WHEN n % 2 = 0 THEN 2 ELSE 1 END AS hop_count,
    CASE WHEN k = 'fk_to' THEN 'databricks://w/c/s/pk' || n ELSE 'a' END AS from_table, CASE WHEN k = 'fk_to' THEN t ELSE 'b' END AS to_table, brand, c
    FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY {_RANK}, CASE WHEN {_RANK} = 2 THEN -{_PRECEDENCE} ELSE 0 END, CASE WHEN {_RANK} = 2 THEN -confidence ELSE 0 END, id) AS r FROM claims WHERE status <> 'rejected' AND k IN ('joins_to', 'has_join_evidence', 'fk_to')) WHERE r = 1)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = F.col("p_partkey"), F.col("p_size")
    of_column = (i % 3 > 0) | (i % 7 == 6)
    t, c = F.concat(F.lit("databricks://w/c/s/"), F.col("p_brand")), F.concat(F.lit("c"), (n % 5).cast("string"))
    k = _case(i % 7, _PREDICATE, "")
    number = n.cast("string")
    eq = lambda a, b, x, y: F.struct(a.alias("left_table"), b.alias("left_column"), x.alias("right_table"), y.alias("right_column"))
    first = eq(F.lit("a"), F.lit("x"), F.lit("b"), F.lit("y"))
    joins = F.when(n % 2 == 0, F.array(first, eq(F.lit("b"), F.lit("z"), F.concat(F.lit("c"), number), F.lit("z")))).otherwise(F.array(first))
    joined = F.to_json(F.struct(joins.alias("join_predicates"), F.when(n % 2 == 0, 2).alias("hop_count"), F.lit("a").alias("from_table"), F.lit("b").alias("to_table")))
    key = F.to_json(F.struct(F.concat(F.lit("pk"), number).alias("pk_table"), F.lit("id").alias("pk_column"), F.col("p_brand").alias("fk_table"), c.alias("fk_column")))
    value = F.to_json(F.struct(F.col("p_type").alias("value"), (n % 2 == 0).alias("is_preferred")))
    return table(spark, sf_dir, "part").select(
        i.alias("id"), F.when(of_column, F.concat_ws("/", t, c)).otherwise(t).alias("subject"), F.when(k != "has_name", k).when(of_column, "has_property_name").otherwise("has_entity_name").alias("predicate"),
        F.when(k == "fk_to", key).when(k.isin("joins_to", "has_join_evidence"), joined).otherwise(value).alias("payload"), F.when(k == "fk_to", F.concat(F.lit("databricks://w/c/s/pk"), number, F.lit("/id"))).alias("object"),
        _case(i % 5, SOURCES, "other").alias("source"), ((n % 10).cast("double") / 10.0).alias("confidence"), _case(i % 11, _STATUS, "auto").alias("status"),
    )


@query(f"WITH {CLAIMS}, {_ALIASES} SELECT * FROM aliases")
def aliases_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-04."""
    return naming.aliases_by_label(claims(spark, sf_dir))


@query(f"WITH {CLAIMS}, {_PROPERTIES} SELECT * FROM properties")
def property_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-25, JOIN-17."""
    return naming.properties(claims(spark, sf_dir))


@query(f"WITH {CLAIMS}, {_PATHS} SELECT subject, name, hop_count, from_table, to_table, source, confidence FROM paths")
def join_paths_of_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-06: all three predicates."""
    return naming.join_paths(claims(spark, sf_dir)).drop("predicates", "cardinality", "sql_snippet")


_USES = """uses AS (SELECT DISTINCT name, unnest(CASE WHEN k = 'fk_to' THEN ['pk' || n, brand] WHEN n % 2 = 0 THEN ['a', 'b', 'b', 'c' || n] ELSE ['a', 'b'] END) AS "table", unnest(CASE WHEN k = 'fk_to' THEN ['id', c] WHEN n % 2 = 0 THEN ['x', 'y', 'z', 'z'] ELSE ['x', 'y'] END) AS "column" FROM paths)"""


@query(f"""WITH {CLAIMS}, {_PATHS}, {_USES} SELECT name, "table", "column" FROM uses UNION SELECT name, "table", NULL FROM uses""")
def join_path_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-06, JOIN-10."""
    return naming.path_uses(naming.join_paths(claims(spark, sf_dir)))


@query(f"""WITH {CLAIMS}, {_ALIASES}, {_PROPERTIES}, {_PATHS}, {_USES}, edges AS (
    SELECT 'entity_on_table' AS kind, v AS "from", subject AS "to" FROM best WHERE predicate = 'has_entity_name' UNION ALL SELECT 'property_on_column', name, subject FROM properties UNION ALL SELECT DISTINCT 'refers_to', text, target FROM aliases
    UNION ALL SELECT 'uses', name, "table" FROM (SELECT DISTINCT name, "table" FROM uses) UNION ALL SELECT 'uses', name, "table" || '.' || "column" FROM uses UNION ALL SELECT 'provenance', id::VARCHAR, subject FROM claims)
    SELECT kind, "from", "to", 's' AS source_schema FROM edges""")
def unified_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-01, GRF-02, GRF-13, JOIN-27: all edges of a graph made from stored claims again, their scope found from the references."""
    stored = claims(spark, sf_dir).withColumn("observed_at", F.col("id"))
    made = build.resume(stored, stored.where("false").select("id", "status", F.col("id").alias("seq")))
    kinds = ["entity_on_table", "property_on_column", "refers_to", "uses", "provenance"]
    return reduce(DataFrame.unionByName, [getattr(made, k).select(F.lit(k).alias("kind"), F.col("from").cast("string").alias("from"), "to", "source_schema") for k in kinds])


_ENTITIES = [("E0", "orders"), ("E1", "lineitem"), ("E2", "part"), ("E3", "customer"), ("E4", "ghost")]
_COLUMNS = [("orders", "o_orderstatus", "P0", "categorical"), ("orders", "o_orderkey", "P1", "identifier"), ("lineitem", "l_returnflag", "P2", "categorical"), ("part", "p_brand", "P3", "categorical"), ("customer", "c_mktsegment", "P4", "categorical"), ("customer", "c_name", "P5", "free_text")]
_PATH_TABLES = [("lo", "lineitem", 0.9), ("lo", "orders", 0.9), ("oc", "orders", 0.8), ("oc", "customer", 0.8), ("lp", "lineitem", 0.7), ("lp", "part", 0.7)]
_METRICS = [("M0", "E0"), ("M1", "E1"), ("M2", "E3")]
_ALIAS_ROWS = [("A0", "Entity", "E1"), ("A1", "Property", "P3"), ("A2", "Term", "1-URGENT"), ("A3", "Entity", None)]
_CATEGORICAL = [(t, c) for t, c, _, kind in _COLUMNS if kind == "categorical"]


def _values(name: str, rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"
    return f"{name} AS (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)})"


_GRAPH = ", ".join([
    _values('entity_table(entity, "table")', _ENTITIES), _values('cols("table", "column", property, semantic_type)', _COLUMNS), _values('path_tables(path, "table", confidence)', _PATH_TABLES), _values("metrics(metric, entity)", _METRICS),
    _values("aliases(text, label, target)", _ALIAS_ROWS), "members AS (" + " UNION ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", {c} AS code FROM {t}" for t, c in _CATEGORICAL) + ")",
    "parent_of AS (SELECT DISTINCT left(o_orderpriority, 1) AS parent, o_orderpriority AS child FROM orders UNION SELECT DISTINCT 'any', left(o_orderpriority, 1) FROM orders)",
])
_HITS = """raw AS (SELECT DISTINCT o_orderkey % 7 AS question_id, CASE o_orderkey % 4 WHEN 0 THEN 'entity' WHEN 1 THEN 'property' WHEN 2 THEN 'term' ELSE 'alias' END AS label,
        CASE o_orderkey % 4 WHEN 0 THEN 'E' || (o_custkey % 5) WHEN 1 THEN 'P' || (o_custkey % 6) WHEN 2 THEN o_orderpriority ELSE 'A' || (o_custkey % 4) END AS name FROM orders),
    hits AS (SELECT question_id, label, name, 0.8::DOUBLE AS confidence FROM raw WHERE label <> 'alias' UNION ALL SELECT question_id, lower(a.label), target, 0.8::DOUBLE FROM raw JOIN aliases a ON a.text = raw.name WHERE raw.label = 'alias' AND target IS NOT NULL),
    entities AS (SELECT question_id, entity, max(confidence) AS confidence FROM (SELECT question_id, name AS entity, confidence FROM hits WHERE label = 'entity' UNION ALL SELECT question_id, entity, 0.6::DOUBLE FROM hits JOIN cols ON property = name AND label = 'property' JOIN entity_table USING ("table")) GROUP BY ALL),
    tables AS (SELECT DISTINCT question_id, "table" FROM entities JOIN entity_table USING (entity)),
    vals AS (SELECT DISTINCT question_id, property, code FROM tables JOIN cols USING ("table") JOIN members USING ("table", "column") WHERE semantic_type = 'categorical'),
    reached AS (SELECT question_id, path, max(confidence) AS confidence FROM tables JOIN path_tables USING ("table") GROUP BY ALL)"""


def _expansion(spark: SparkSession, sf_dir: str) -> answer.Expansion:
    o = table(spark, sf_dir, "orders")
    i, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    made = lambda prefix, k: F.concat(F.lit(prefix), (c % k).cast("string"))
    name = F.when(i == 0, made("E", 5)).when(i == 1, made("P", 6)).when(i == 2, F.col("o_orderpriority")).otherwise(made("A", 4))
    label = F.when(i == 0, "entity").when(i == 1, "property").when(i == 2, "term").otherwise("alias")
    hits = o.select((F.col("o_orderkey") % 7).alias("question_id"), label.alias("label"), name.alias("name"), F.lit(0.8).alias("confidence")).distinct()
    small = spark.createDataFrame
    members = reduce(DataFrame.unionByName, [table(spark, sf_dir, t).select(F.lit(f"{t}.{x}").alias("value_set"), F.col(x).alias("code")).distinct() for t, x in _CATEGORICAL])
    first = F.left("o_orderpriority", F.lit(1))
    parents = o.select(first.alias("parent"), F.col("o_orderpriority").alias("child")).union(o.select(F.lit("any"), first)).distinct()
    known = answer.Knowledge(
        small(_ENTITIES, "entity string, table string"), small(_COLUMNS, "table string, column string, property string, semantic_type string"), small(_PATH_TABLES, "path string, table string, confidence double"),
        small([(f"{t}.{x}", t, x) for t, x in _CATEGORICAL], "value_set string, table string, column string"), members, small(_METRICS, "metric string, entity string"),
        o.select(F.col("o_orderpriority").alias("code"), F.concat(F.lit("v"), (c % 4).cast("string")).alias("vocabulary")), parents, small(_ALIAS_ROWS, "text string, label string, target string"),
    )
    return answer.expand(hits, known)


@query(f"""WITH {_GRAPH}, {_HITS}, terms AS (SELECT DISTINCT question_id, name FROM hits WHERE label = 'term')
    SELECT question_id, 'entity' AS kind, entity AS name FROM entities UNION ALL SELECT question_id, 'column', "table" || '.' || "column" FROM tables JOIN cols USING ("table") UNION ALL SELECT question_id, 'path', path FROM reached
    UNION ALL SELECT question_id, 'value', property || '=' || code FROM vals UNION ALL SELECT DISTINCT question_id, 'metric', metric FROM entities JOIN metrics USING (entity)
    UNION ALL SELECT question_id, 'vocabulary', name || '/' || vocabulary FROM (SELECT *, row_number() OVER (PARTITION BY question_id, name ORDER BY vocabulary) AS r FROM terms JOIN (SELECT DISTINCT o_orderpriority AS name, 'v' || (o_custkey % 4) AS vocabulary FROM orders) USING (name)) WHERE r <= 3
    UNION ALL SELECT question_id, 'ancestor', name || '<' || parent FROM terms JOIN parent_of ON child = name UNION ALL SELECT question_id, 'ancestor', name || '<any' FROM terms JOIN parent_of ON child = name""")
def expanded_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-07 to VEC-10, JOIN-09, JOIN-10, JOIN-14, JOIN-18."""
    x = _expansion(spark, sf_dir)
    kind = lambda df, name, c: df.select("question_id", F.lit(name).alias("kind"), c.alias("name"))
    parts = [
        kind(x.entities, "entity", F.col("entity")), kind(x.columns, "column", F.concat_ws(".", "table", "column")), kind(x.paths, "path", F.col("path")), kind(x.values, "value", F.concat_ws("=", "property", "code")),
        kind(x.metrics, "metric", F.col("metric")), kind(x.vocabularies, "vocabulary", F.concat_ws("/", "code", "vocabulary")), kind(x.ancestry, "ancestor", F.concat_ws("<", "node", "ancestor")),
    ]
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH {_GRAPH}, {_HITS} SELECT e.question_id, entities, paths, "values" FROM (SELECT question_id, string_agg(entity, ',' ORDER BY confidence DESC, entity) AS entities FROM entities GROUP BY question_id) e
    LEFT JOIN (SELECT question_id, string_agg(path, ',' ORDER BY confidence DESC, path) AS paths FROM reached GROUP BY question_id) p USING (question_id)
    LEFT JOIN (SELECT question_id, string_agg(property || '=' || code, ',' ORDER BY property, code) AS "values" FROM vals GROUP BY question_id) v USING (question_id)""")
def context_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-11, AGG-28, SRT-03, RSH-06."""
    found = _expansion(spark, sf_dir).context()
    listed = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    return found.select("question_id", listed("entities", lambda e: e["entity"]), listed("paths", lambda p: p["path"]), listed("values", lambda v: F.concat_ws("=", v["property"], v["code"])))


_GOLD = "gold AS (SELECT p_partkey::VARCHAR AS code, CASE p_partkey % 6 WHEN 0 THEN 'RESOLVED' WHEN 1 THEN 'UNLABELLED' ELSE 'NO_MAP' END AS label FROM part WHERE p_partkey % 2 = 0 OR p_size > 10), staged AS (SELECT l_partkey::VARCHAR AS code, CASE WHEN l_partkey % 5 = 0 THEN 'NO_MAP' ELSE 'RESOLVED' END AS resolution FROM lineitem)"


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = F.col("p_partkey")
    gold = table(spark, sf_dir, "part").where("p_partkey % 2 = 0 or p_size > 10").select(i.cast("string").alias("code"), F.when(i % 6 == 0, "RESOLVED").when(i % 6 == 1, "UNLABELLED").otherwise("NO_MAP").alias("label"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("code"), F.when(F.col("l_partkey") % 5 == 0, "NO_MAP").otherwise("RESOLVED").alias("resolution")), gold


@query(f"""WITH {_GOLD}, none AS (SELECT DISTINCT code FROM staged WHERE resolution = 'NO_MAP'), met AS (SELECT none.code, label FROM none LEFT JOIN gold USING (code))
    SELECT CASE WHEN count_if(label = 'RESOLVED') = 0 THEN 'PASS' ELSE 'FAIL' END AS outcome, count(DISTINCT code) AS n_no_map, coalesce(string_agg(code, ',' ORDER BY code) FILTER (label = 'RESOLVED'), '') AS resolved_in_gold, coalesce(string_agg(code, ',' ORDER BY code) FILTER (label = 'UNLABELLED'), '') AS unlabelled_in_gold FROM met""")
def qa_no_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-03."""
    found = quality.no_map_accounting(*_gold(spark, sf_dir))
    return found.select("outcome", "n_no_map", *(F.array_join(c, ",").alias(c) for c in ("resolved_in_gold", "unlabelled_in_gold")))


@query("""SELECT false AS passed, 'checks: RAIL, SHIP; conformance: ' || count_if(p_size > 40) || '; gold is contradicted' AS reasons FROM part""")
def qa_strict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-08: two checks fail, parts that are too large are violations, and gold is contradicted somewhere."""
    p = table(spark, sf_dir, "part")
    checks = spark.createDataFrame([("SHIP", "FAIL"), ("AIR", "PASS"), ("RAIL", "FAIL"), ("SHIP", "PASS")], "name string, outcome string")
    found = quality.strict_gate(checks, p.where("p_size > 40"), p.select((F.col("p_size") == 1).alias("contradicted")))
    return found.select("passed", F.array_join("reasons", "; ").alias("reasons"))


@query("""SELECT o_orderkey, o_orderstatus = 'F' AND o_custkey IS NOT NULL AS both, o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' AS either FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def row_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, FLT-12."""
    o = filters.in_slice(table(spark, sf_dir, "orders"), ["1-URGENT", "5-LOW"], "o_orderpriority")
    both, either = filters.row_predicate("AND", [("o_orderstatus", "F"), ("o_custkey", ...)]), filters.row_predicate("OR", [("o_orderstatus", "F"), ("o_orderpriority", "1-URGENT")])
    return o.select("o_orderkey", both.alias("both"), either.alias("either"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def grain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-15, FLT-19."""
    return filters.at_grain(table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}).select("o_orderkey")


_CLASSES = {0: "PUBLIC", 1: "PII", 2: "PHI", 3: "FINANCIAL_RESTRICTED", 4: "CONFIDENTIAL"}
_MODES = {0: "RAW", 1: "HASH", 2: "COUNT_ONLY", 3: "CATEGORICAL"}


@query(f"""WITH e AS (SELECT p_partkey, {_case_sql('p_partkey % 5', _CLASSES, '')} AS sensitivity, {_case_sql('p_partkey % 4', _MODES, '')} AS mode, p_size % 3 AS f, p_size % 2 = 0 AS overridden FROM part)
    SELECT p_partkey, CASE sensitivity WHEN 'PUBLIC' THEN 'RAW' WHEN 'PII' THEN 'HASH' WHEN 'FINANCIAL_RESTRICTED' THEN 'HASH' ELSE 'CATEGORICAL' END AS usual,
        CASE WHEN mode = 'COUNT_ONLY' AND f > 0 THEN 'literal values' WHEN mode = 'HASH' AND f <> 1 THEN 'no digest' WHEN mode = 'RAW' AND sensitivity = 'PHI' AND NOT overridden THEN 'raw health data' END AS fault FROM e""")
def evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-20."""
    i, f = F.col("p_partkey"), F.col("p_size") % 3
    fields = F.when(f == 0, F.array(F.lit("count"))).when(f == 1, F.array(F.lit("digest"), F.lit("count"))).otherwise(F.array(F.lit("value")))
    rows = table(spark, sf_dir, "part").select(i, _case(i % 5, _CLASSES, "").alias("sensitivity"), _case(i % 4, _MODES, "").alias("mode"), fields.alias("fields"), (F.col("p_size") % 2 == 0).alias("overridden"))
    return filters.evidence_faults(rows).select("p_partkey", filters.evidence_mode(F.col("sensitivity")).alias("usual"), "fault")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1""")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-26, WIN-03."""
    return filters.first_seen(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("""SELECT k, coalesce(a, b) AS v FROM (SELECT o_custkey AS k, min(o_totalprice) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) x FULL JOIN (SELECT o_custkey AS k, min(o_totalprice) AS b FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) y USING (k)""")
def union_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-04."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    return filters.union_by_key(o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus <> 'F'").drop("o_orderstatus"), ["k"])


@query("SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 500")
def distinct_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-05: the limit is the feature."""
    return filters.distinct_sample(table(spark, sf_dir, "part"), "p_type")
