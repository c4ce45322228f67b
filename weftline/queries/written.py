"""What is written and read back: tables with comments, appends that keep what is stored, catalogs, scripts, dumps, reviews, nested documents and ties."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import interpret, naming, resolve
from weftline.plans import build, fit, plugins
from weftline.queries.base import query, table
from weftline.queries.building import CLAIMS, claims
from weftline.queries.catalog import TABLES
from weftline.sources import catalog, files, sinks
from weftline.sources.staging import cut, new_path


def _table_name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex}"


@query("""SELECT 'o_orderkey' AS "column", 'bigint' AS type, 'key of ' || count(*) || ' orders' AS comment, 0 AS n_tags, count(*) AS n_rows FROM orders
    UNION ALL SELECT 'o_custkey', 'bigint', NULL, 0, count(*) FROM orders UNION ALL SELECT 'state', 'string', 'it''s ' || count(DISTINCT o_orderstatus) || ' states', 0, count(*) FROM orders""")
def table_with_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, SNK-02, SNK-13, SNK-17, SRC-06: orders as a table of their own, written twice, with comments; and what the catalog says of it."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("state"))
    n, states = o.agg(F.count("*"), F.count_distinct("state")).first()
    name = _table_name("noted")
    try:
        for _ in range(2):
            sinks.write_table(spark, name, o, {"o_orderkey": f"key of {n} orders", "state": f"it's {states} states"})
        told = catalog.described(spark.read.table(name)).select("column", "type", "comment", F.size("tags").alias("n_tags"))
        return cut(told.withColumn("n_rows", F.lit(spark.read.table(name).count())), "noted")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


@query("""WITH r AS (SELECT o_custkey AS study, min(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS f, min(o_orderkey) AS k FROM orders GROUP BY o_custkey) SELECT study, coalesce(f, k) AS run FROM r""")
def write_once_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-03, SNK-19: the first run of a customer stays: finished orders are registered first, then all of them, twice."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("study"), F.col("o_orderkey").alias("run"), "o_orderstatus")
    name = _table_name("registry")
    try:
        for part in (o.where("o_orderstatus = 'F'"), o, o):
            sinks.write_once(spark, name, part.drop("o_orderstatus"), ["study"], [F.col("run")])
        return cut(sinks.once(spark, name, ["study"], [F.col("run")]), "registry")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


_DESCRIBED = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", column_name AS \"column\", (row_number() OVER () - 1)::INT AS position FROM (DESCRIBE SELECT * FROM {t})" for t in TABLES)


@query(f"""WITH d AS ({_DESCRIBED}) SELECT * FROM d""")
def tables_of_a_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-01 to SRC-04, SRC-29: a schema with all tables, found by a pattern and read back from the catalog, in order."""
    schema = _table_name("schema")
    spark.sql(f"CREATE DATABASE {schema}")
    try:
        for t in TABLES:
            spark.sql(f"CREATE TABLE {schema}.{t} USING parquet LOCATION '{sf_dir}/{t}.parquet'")
        found = [s for s in catalog.schemas(spark, "schema_*") if s == schema]
        rows = catalog.columns(spark, found[0], catalog.tables(spark, found[0], "*"))
        return catalog.of_schema(rows, schema).select("table", "column", "position")
    finally:
        spark.sql(f"DROP DATABASE {schema} CASCADE")


@query("""SELECT 'l_orderkey' AS child_column, 'orders' AS parent_table, count(DISTINCT l_orderkey) AS n_child, count(DISTINCT o_orderkey) AS n_met FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
    UNION ALL SELECT 'l_partkey', 'part', count(DISTINCT l_partkey), count(DISTINCT p_partkey) FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def declared_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05, FLT-16: the foreign keys that a schema declares, and how many of their values the parent has."""
    constraints = spark.createDataFrame([("fk_order", "FOREIGN KEY"), ("fk_part", "FOREIGN KEY"), ("pk", "PRIMARY KEY")], "constraint string, type string")
    usage = spark.createDataFrame([("fk_order", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("fk_part", "lineitem", "l_partkey", "part", "p_partkey"), ("pk", "orders", "o_orderkey", None, None)], "constraint string, child_table string, child_column string, parent_table string, parent_column string")
    out = None
    for k in catalog.declared_keys(constraints, usage).orderBy("child_column").collect():  # one row a declared key
        child = table(spark, sf_dir, k["child_table"]).select(F.col(k["child_column"]).alias("k")).distinct()
        parent = table(spark, sf_dir, k["parent_table"]).select(F.col(k["parent_column"]).alias("k"), F.lit(1).alias("there")).distinct()
        row = child.join(parent, "k", "left").agg(F.count("k").alias("n_child"), F.count("there").alias("n_met")).select(F.lit(k["child_column"]).alias("child_column"), F.lit(k["parent_table"]).alias("parent_table"), "n_child", "n_met")
        out = row if out is None else out.unionByName(row)
    return out


@query("""WITH e AS (SELECT p_brand AS child, p_type AS parent, p_partkey % 10 / 10.0::DOUBLE AS c FROM part) SELECT child, parent, round(c, 6) AS confidence, count(*) AS n FROM e WHERE c >= 0.8 GROUP BY ALL""")
def materialised_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16: only joins that are sure enough become edges."""
    p = table(spark, sf_dir, "part")
    joins = p.select(F.col("p_brand").alias("child"), F.col("p_type").alias("parent"), ((F.col("p_partkey") % 10) / 10.0).alias("confidence"))
    columns = p.select(F.lit("s").alias("schema"), F.col("p_brand").alias("table"), F.col("p_type").alias("column"), F.col("p_size").alias("position"), F.lit("string").alias("type"), F.lit(None).cast("string").alias("comment"))
    made = build.materialise(columns, joins).joins
    return made.groupBy("child", "parent", F.round("confidence", 6).alias("confidence")).agg(F.count("*").alias("n"))


@query("""SELECT * FROM (SELECT o_orderkey AS o_orderkey, NULL::DOUBLE AS price, NULL::VARCHAR AS state, 'loaded' AS "table" FROM orders) UNION ALL SELECT NULL, o_totalprice, o_orderstatus, 'paid' FROM orders WHERE o_orderstatus <> 'P'""")
def declared_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-19: tables that a script declares, made empty and filled from orders by position."""
    ddl = "CREATE TABLE @x.loaded (o_orderkey bigint NOT NULL, CONSTRAINT p PRIMARY KEY (o_orderkey)); CREATE TABLE x.paid (price numeric(10,2), state varchar(1));"
    empty = files.empty_tables(spark, ddl)
    o = table(spark, sf_dir, "orders")
    loaded = empty["loaded"].union(o.select("o_orderkey")).withColumns({"price": F.lit(None).cast("double"), "state": F.lit(None).cast("string"), "table": F.lit("loaded")})
    paid = empty["paid"].union(o.where("o_orderstatus <> 'P'").select("o_totalprice", "o_orderstatus")).withColumns({"o_orderkey": F.lit(None).cast("bigint"), "table": F.lit("paid")})
    return loaded.unionByName(paid)


@query(f"""WITH {CLAIMS} SELECT subject, predicate, status, round(confidence, 6) AS confidence, count(*) AS n FROM claims GROUP BY ALL""")
def dumped_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-24: claims as JSON lines, read again."""
    c = claims(spark, sf_dir)
    path = new_path(spark, "dump")
    sinks.write_dump(c, path)
    back = spark.read.schema(c.schema).json(path)
    return back.groupBy("subject", "predicate", "status", F.round("confidence", 6).alias("confidence")).agg(F.count("*").alias("n"))


@query(f"""WITH {CLAIMS} SELECT subject, string_agg(id || ':' || predicate, ',' ORDER BY confidence, id) AS claims FROM claims WHERE confidence < 0.5 GROUP BY subject""")
def review_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-23, SRT-07: unsure claims of each subject, the least sure first."""
    found = sinks.review_list(claims(spark, sf_dir), 0.5)
    return found.select("subject", F.array_join(F.transform("claims", lambda c: F.concat_ws(":", c["id"].cast("string"), c["predicate"])), ",").alias("claims"))


@query("""WITH codes AS (SELECT DISTINCT p_brand AS code FROM part), targets AS (SELECT p_brand AS code, p_partkey AS id, p_size % 3 AS domain FROM part WHERE p_size % 4 > 0),
    alive AS (SELECT code, count(*) AS n, min(id) AS target_id FROM targets WHERE domain = 1 GROUP BY code)
    SELECT code, target_id, CASE WHEN n > 0 THEN 'RESOLVED' ELSE 'NO_MAP' END AS resolution, CASE WHEN n > 1 THEN 'review_pending' ELSE 'auto_accepted' END AS status FROM codes LEFT JOIN alive USING (code)""")
def domain_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-03: parts as concepts of their brand's code; only those of one domain may be targets."""
    p = table(spark, sf_dir, "part")
    concepts = p.select(F.lit("V").alias("vocabulary"), F.col("p_brand").alias("code"), F.col("p_partkey").alias("concept_id"), (F.col("p_size") % 3).cast("string").alias("domain"), F.when(F.col("p_size") % 4 > 0, "S").alias("standard"), F.lit(None).cast("string").alias("invalid_reason"))
    none = spark.createDataFrame([], "from_id long, to_id long, relation string")
    policy = resolve.Policy(vocabulary="V", relation="Maps to", standard="S", domain="1")
    return resolve.resolve(p.select(F.col("p_brand").alias("code")), concepts, none, policy).select("code", "target_id", "resolution", "status")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '[{"left_table":"' || p_brand || '","left_column":"a","right_table":"t","right_column":"b"}]' END AS shape FROM part""")
def join_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-32: a snippet, else the predicates as JSON."""
    pair = F.struct(F.col("p_brand").alias("left_table"), F.lit("a").alias("left_column"), F.lit("t").alias("right_table"), F.lit("b").alias("right_column"))
    return table(spark, sf_dir, "part").select("p_partkey", naming.join_shape(F.when(F.col("p_size") % 2 == 0, F.col("p_name")), F.array(pair)).alias("shape"))


@query("""SELECT p_brand AS "table", string_agg(p_partkey || ':' || p_name || ':' || p_type || ':' || CASE WHEN p_size % 3 = 0 THEN '' ELSE 's' || p_size END, ',' ORDER BY p_partkey) AS columns FROM part GROUP BY p_brand""")
def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH-07: a nested row for each brand, its parts as columns in order."""
    comment = F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("s"), F.col("p_size").cast("string")))
    columns = table(spark, sf_dir, "part").select(F.col("p_brand").alias("table"), F.col("p_partkey").alias("position"), F.col("p_name").alias("column"), F.col("p_type").alias("type"), comment.alias("comment"))
    line = lambda c: F.concat_ws(":", c["position"].cast("string"), c["column"], c["type"], F.coalesce(c["comment"], F.lit("")))
    return interpret.table_documents(columns).select("table", F.array_join(F.transform("columns", line), ",").alias("columns"))


@query("""SELECT p_brand, count(DISTINCT p_type) AS n_shapes, count(DISTINCT p_type) = 1 AS uniform FROM part GROUP BY p_brand""")
def uniform_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FKC-03: brands as studies, types as their shapes: which of them may be collapsed together."""
    shapes = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("types")).orderBy("p_brand").collect()  # a row a study
    rows = []
    for r in shapes:
        try:
            fit.require_uniform({f"{i}": (t,) for i, t in enumerate(r["types"])})
            rows.append((r["p_brand"], len(r["types"]), True))
        except ValueError:
            rows.append((r["p_brand"], len(r["types"]), False))
    return spark.createDataFrame(rows, "p_brand string, n_shapes long, uniform boolean")


@query("""WITH s AS (SELECT p_brand AS code, p_partkey AS concept_id, p_size FROM part), n AS (SELECT code, count(*) AS n, max(p_size) AS most, min(concept_id) AS low FROM s GROUP BY code)
    SELECT code, CASE WHEN n = 1 THEN low ELSE (SELECT min(concept_id) FROM s WHERE s.code = n.code AND s.p_size = n.most) END AS concept_id, n = 1 OR (SELECT count(*) FROM s WHERE s.code = n.code AND s.p_size = n.most) = 1 AS settled FROM n""")
def broken_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-01: of a brand's parts the largest one survives, if there is one such; ties that stay go to people, here with their smallest id."""
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), F.col("p_partkey").alias("concept_id"), "p_size")

    def largest(rows: pd.DataFrame) -> pd.DataFrame:
        top = rows[rows["p_size"] == rows["p_size"].max()]
        return top if len(top) == 1 else top[:0]

    picked = plugins.break_ties(s, ["code"], largest)
    open_ = plugins.declined_ties(s, picked, ["code"]).select("code")
    most = s.groupBy("code").agg(F.max("p_size").alias("p_size"))
    low = s.join(most, ["code", "p_size"]).join(open_, "code", "left_semi").groupBy("code").agg(F.min("concept_id").alias("concept_id"))
    return picked.select("code", "concept_id", F.lit(True).alias("settled")).unionByName(low.withColumn("settled", F.lit(False)))


@query("""SELECT (SELECT count(*) FROM nation) AS n_rows, 3::BIGINT AS n_columns, (SELECT count(*) FROM nation JOIN region ON r_regionkey = n_regionkey) AS n_joined""")
def connector_and_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF-02 to UDF-06, SRC-07: a connector to the given folder, made by its name, and SQL run over its tables."""

    class Folder:
        def schemas(self) -> list[str]:
            return ["sf"]

        def table(self, schema: str, name: str) -> DataFrame:
            return table(spark, sf_dir, name)

        def columns(self, schema: str, tables: list[str]) -> DataFrame:
            rows = [(schema, t, c, k, i) for t in tables for i, (c, k) in enumerate(self.table(schema, t).dtypes)]
            return spark.createDataFrame(rows, "schema string, table string, column string, type string, position int")

    registry = plugins.Registry()
    registry.register("folder")(Folder)
    source = registry.make("folder")
    mark = uuid.uuid4().hex
    for t in ("nation", "region"):
        source.table("sf", t).createOrReplaceTempView(f"{t}_{mark}")
    joined = plugins.Runtime(spark).execute(f"SELECT count(*) AS n_joined FROM nation_{mark} JOIN region_{mark} ON r_regionkey = n_regionkey")
    for t in ("nation", "region"):  # the plan has what it needs
        spark.catalog.dropTempView(f"{t}_{mark}")
    n = catalog.sample(source.table("sf", "nation"), 1_000_000).agg(F.count("*").alias("n_rows"))
    width = source.columns("sf", ["nation"]).agg(F.count("*").alias("n_columns"))
    one = lambda df: df.withColumn("_", F.lit(1))
    return one(n).join(one(width), "_").join(one(joined), "_").drop("_")
