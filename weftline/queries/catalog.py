"""Profiles of the tables, keys between them, domain and documentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import profile
from weftline.queries.base import query, table
from weftline.sources import sinks
from weftline.sources.catalog import first_schema_with, profiled_columns

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: Tables beside the real ones, for names and types that these lack: (table, column, type, position).
MORE = [
    (t, c, k, i)
    for t, cs in {"client": "customer_id:bigint name:varchar(25) nation_id:int market-segment:string", "order": "id:bigint code:string", "shipment": "order_id:bigint carrier:string tracking_code:string warehouse_id:int"}.items()
    for i, (c, k) in enumerate(x.split(":") for x in cs.split(" "))
]
_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "FLOAT[]": "array<float>", "TIMESTAMP": "timestamp_ntz"}
_NAMED = "regexp_replace(regexp_replace(column_name, '^(r|n|c|s|p|o|l)_', ''), '^(.+)key$', '\\1_key')"
CATALOG_SQL = (
    "described AS (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", column_name, column_type, row_number() OVER () - 1 AS position FROM (DESCRIBE SELECT * FROM {t})" for t in TABLES) + "), "
    f"catalog(\"table\", \"column\", type, position) AS (SELECT \"table\", {_NAMED}, CASE column_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items()) + " END, position::INT FROM described "
    "UNION ALL VALUES " + ", ".join(f"('{t}', '{c}', '{k}', {i})" for t, c, k, i in MORE) + ")"
)
_BASE = "lower(trim(split_part(type, '(', 1)))"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of all tables, without the letter in front and with ``_key`` parted, and those of ``MORE`` (SRC-04)."""
    real = profile.columns_of({t: table(spark, sf_dir, t) for t in TABLES}, "sf").select("table", "column", "type", "position")
    named = real.withColumn("column", F.regexp_replace(F.regexp_replace("column", "^(r|n|c|s|p|o|l)_", ""), "^(.+)key$", "$1_key"))
    return named.unionByName(spark.createDataFrame(MORE, "table string, column string, type string, position int")).withColumn("schema", F.lit("sf"))


_PROFILED = {"customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderpriority", "part": "p_partkey p_name p_brand p_type p_size p_retailprice"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls, count(DISTINCT {c}) AS n_distinct FROM {t}" for t, cs in _PROFILED.items() for c in cs.split()))
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01, AGG-02, AGG-05, SRC-04, FLT-02: all columns but times."""
    found = []
    for t in _PROFILED:
        rows = table(spark, sf_dir, t)
        found.append(profile.profile(rows.select(*profiled_columns(rows)), t))
    return reduce(DataFrame.unionByName, found)


@query()
def profile_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03: sketches differ between engines, so no SQL."""
    return profile.approx_profile(table(spark, sf_dir, "lineitem"), "lineitem")


@query("""SELECT * FROM (SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS frequency FROM part GROUP BY p_brand ORDER BY frequency DESC, value LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'o_orderpriority', o_orderpriority AS value, count(*) AS frequency FROM orders GROUP BY o_orderpriority ORDER BY frequency DESC, value LIMIT 100)""")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04, PRJ-10."""
    a = profile.top_values(table(spark, sf_dir, "part"), "p_brand", 10).withColumn("column", F.lit("p_brand"))
    return a.unionByName(profile.top_values(table(spark, sf_dir, "orders"), "o_orderpriority", 100).withColumn("column", F.lit("o_orderpriority")))


_PAIRS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("part", "p_size", "supplier", "s_suppkey"), ("customer", "c_custkey", "nation", "n_nationkey")]


@query(" UNION ALL ".join(f"""
    SELECT '{c}.{k}' AS child, '{p}.{q}' AS parent, n_child, n_met, n_parent, n_parent_rows, coalesce(n_met / nullif(n_child, 0), 0.0) AS coverage, t.tier::INT AS tier, CASE t.tier WHEN 1 THEN 0.95 WHEN 2 THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence
    FROM (SELECT count(DISTINCT {k}) AS n_child, count(DISTINCT CASE WHEN {k} IN (SELECT {q} FROM {p}) THEN {k} END) AS n_met FROM {c}), (SELECT count(DISTINCT {q}) AS n_parent, count({q}) AS n_parent_rows FROM {p}),
    LATERAL (SELECT CASE WHEN n_child > 0 AND n_met / n_child >= 0.8 THEN 1 WHEN n_parent > 0 AND n_parent = n_parent_rows AND n_child <= n_parent THEN 2 ELSE 3 END AS tier) t""" for c, k, p, q in _PAIRS))
def fk_coverage_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-30 to AGG-32, SET-03."""
    found = [profile.key_tier(profile.key_evidence(table(spark, sf_dir, c), k, table(spark, sf_dir, p), q)).withColumns({"child": F.lit(f"{c}.{k}"), "parent": F.lit(f"{p}.{q}")}) for c, k, p, q in _PAIRS]
    return reduce(DataFrame.unionByName, found)


@query(f"""WITH {CATALOG_SQL}, b AS (SELECT *, {_BASE} AS base, regexp_extract(lower("column"), '^(.+?)_(id|key|code)$', 1) AS root FROM catalog),
    f AS (SELECT *, CASE WHEN base IN ('int', 'integer', 'bigint', 'smallint', 'tinyint', 'long') THEN 'i' WHEN base IN ('string', 'varchar', 'char', 'text', 'uuid') THEN 't' ELSE base END AS family FROM b)
    SELECT 'sf' AS "schema", c."table" AS child_table, c."column" AS child_column, c.type AS child_type, p."table" AS parent_table, p."column" AS parent_column, p.type AS parent_type
    FROM f c JOIN f p ON c.root <> '' AND lower(p."table") = c.root AND c."table" <> p."table" AND lower(c."table") <> c.root AND c.family = p.family""")
def fk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-19, FN-10, FN-11."""
    return profile.key_candidates(catalog(spark, sf_dir))


@query(f"""WITH {CATALOG_SQL} SELECT a."table" AS from_table, b."table" AS to_table, a."column", CASE WHEN lower(a."column") IN ('id', 'name', 'type', 'status', 'value', 'code', 'description', 'created_at', 'updated_at') THEN 0.4
    WHEN lower(a."column") LIKE '%\\_id' ESCAPE '\\' THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM catalog a JOIN catalog b ON a."column" = b."column" AND a."table" < b."table" """)
def shared_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-20, SET-03."""
    return profile.shared_columns(catalog(spark, sf_dir))


_WORDS = ", ".join(f"('{d}', '{w}')" for d, ws in profile.DOMAIN_WORDS.items() for w in ws)


@query(f"""WITH {CATALOG_SQL}, words(domain, word) AS (VALUES {_WORDS}), names AS (SELECT DISTINCT "table" AS name FROM catalog UNION ALL SELECT "column" FROM catalog UNION ALL SELECT "table" FROM catalog),
    tokens AS (SELECT unnest(string_split(replace(lower(name), '-', '_'), '_')) AS word FROM names), c AS (SELECT domain, count(*) AS n FROM tokens JOIN words USING (word) GROUP BY domain)
    SELECT domain, n, round(n / (SELECT sum(n) FROM c), 2) AS weight FROM c""")
def domain_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-33, FN-14."""
    return profile.domain_weights(catalog(spark, sf_dir))


@query(f"""WITH {CATALOG_SQL}, c AS (SELECT "table", CASE WHEN position % 2 = 0 AND "table" < 'p' THEN 'told' WHEN "table" = 'part' THEN '  ' END AS comment, "table" >= 's' AND position > 0 AS has_values FROM catalog),
    s AS (SELECT "table", avg(CASE WHEN trim(coalesce(comment, '')) <> '' THEN 1 ELSE 0 END) AS coverage, avg(has_values::INT) AS valued FROM c GROUP BY "table"), t AS (SELECT *, "table" = 'region' AS has_samples, "table" = 'customer' AS told FROM s)
    SELECT "table", round(coverage, 4) AS coverage, CASE WHEN coverage >= 0.6 AND (told OR valued >= 0.5 OR has_samples) THEN 'rich' WHEN coverage > 0 OR told OR valued > 0 OR has_samples THEN 'sparse' ELSE 'name_only' END AS tier FROM t""")
def metadata_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-34, on made-up comments."""
    rows = catalog(spark, sf_dir)
    comment = F.when((F.col("position") % 2 == 0) & (F.col("table") < "p"), "told").when(F.col("table") == "part", "  ")
    columns = rows.select("table", comment.alias("comment"), ((F.col("table") >= "s") & (F.col("position") > 0)).alias("has_values"))
    tables = rows.select("table").distinct().select("table", F.when(F.col("table") == "customer", "a table").alias("comment"), (F.col("table") == "region").alias("has_samples"))
    return profile.metadata_tier(columns, tables)


@query("SELECT DISTINCT o_orderstatus AS code FROM orders WHERE trim(coalesce(o_orderstatus, '')) <> ''")
def source_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-26, SRC-27, AGG-08."""
    return profile.distinct_keys(table(spark, sf_dir, "orders"), "o_orderstatus").select(F.col("o_orderstatus").alias("code"))


@query(f"""WITH {CATALOG_SQL}, three AS (SELECT 'sf' AS "schema", "table", "column" FROM catalog UNION ALL SELECT 'zz', "table", "column" FROM catalog UNION ALL SELECT 'aa', "table", 'not ' || "column" FROM catalog)
    SELECT min("schema") AS "schema" FROM three WHERE "table" = 'orders' AND "column" = 'cust_key'""")
def schema_by_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-28."""
    own = catalog(spark, sf_dir)
    return first_schema_with(own.unionByName(own.withColumn("schema", F.lit("zz"))).unionByName(own.withColumns({"schema": F.lit("aa"), "column": F.concat(F.lit("not "), "column")})), "orders", "cust_key")


@query("""SELECT n_pushed, n_target, n_pushed = n_target AS matches FROM (SELECT count(*) AS n_pushed FROM orders), (SELECT count(*) AS n_target FROM orders WHERE o_orderkey % 10 > 0)""")
def push_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07: a push that lost some rows."""
    o = table(spark, sf_dir, "orders")
    return sinks.reconcile(o, o.where(F.col("o_orderkey") % 10 > 0))


@query(f"""WITH {CATALOG_SQL}, parsed AS (SELECT "table", "column", 'about ' || "column" AS comment FROM catalog UNION ALL SELECT 'gone', 'x', 'c' UNION ALL SELECT 'part', 'gone', 'c'),
    live AS (SELECT "table", "column", CASE WHEN position = 0 THEN 'has' ELSE ' ' END AS comment FROM catalog)
    SELECT p."table", p."column", p.comment, CASE WHEN p."table" NOT IN (SELECT "table" FROM live) THEN 'table_not_found' WHEN l."column" IS NULL THEN 'column_not_found' WHEN trim(l.comment) <> '' THEN 'already_commented' ELSE 'apply' END AS state
    FROM parsed p LEFT JOIN live l ON l."table" = p."table" AND l."column" = p."column" """)
def comment_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-24, SNK-20."""
    c = catalog(spark, sf_dir)
    more = spark.createDataFrame([("gone", "x", "c"), ("part", "gone", "c")], "table string, column string, comment string")
    parsed = c.select("table", "column", F.concat(F.lit("about "), "column").alias("comment")).unionByName(more)
    return sinks.comment_plan(parsed, c.select("table", "column", F.when(F.col("position") == 0, "has").otherwise(" ").alias("comment")))
