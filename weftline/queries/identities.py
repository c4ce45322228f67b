"""Identities: registries of customers and suppliers, children of orders, upserts and scoped writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import identity, quality, ranked
from weftline.queries import mapping
from weftline.queries.base import query, table

_MD5 = "('0x' || substr(md5('sf' || chr(31) || 'orders' || chr(31) || o_orderkey), 1, 15))::BIGINT"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.register(None, table(spark, sf_dir, "customer").select(F.lit("crm").alias("source_namespace"), F.col("c_custkey").cast("string").alias("source_key")), "r1")


_REGISTRY = "registry AS (SELECT 'crm' AS source_namespace, c_custkey::VARCHAR AS source_key, row_number() OVER (ORDER BY c_custkey::VARCHAR) AS entity_id FROM customer)"


@query(f"WITH {_REGISTRY} SELECT source_namespace, source_key, sha256(source_namespace || chr(31) || source_key) AS uid, entity_id, 'r1' AS run_id FROM registry")
def identity_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01, ID-02, FN-02, SNK-15: dense ids in the order of the keys."""
    return _customers(spark, sf_dir)


@query(f"""WITH {_REGISTRY}, added AS (SELECT 'crm' AS source_namespace, s_suppkey::VARCHAR || 'x' AS source_key FROM supplier), whole AS (
    SELECT source_namespace, source_key, entity_id, 'r1' AS run_id FROM registry
    UNION ALL SELECT source_namespace, source_key, (SELECT max(entity_id) FROM registry) + row_number() OVER (ORDER BY source_key), 'r2' FROM added)
    SELECT run_id, count(*) AS n, min(entity_id)::BIGINT AS low, max(entity_id)::BIGINT AS high FROM whole GROUP BY run_id""")
def identity_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID-02: known keys keep their ids, new ones go on from the largest."""
    old = _customers(spark, sf_dir)
    new = table(spark, sf_dir, "supplier").select(F.lit("crm").alias("source_namespace"), F.concat(F.col("s_suppkey").cast("string"), F.lit("x")).alias("source_key"))
    both = identity.register(old, new.unionByName(old.select("source_namespace", "source_key")), "r2")
    return both.groupBy("run_id").agg(F.count("*").alias("n"), F.min("entity_id").alias("low"), F.max("entity_id").alias("high"))


_TWO = """two AS (SELECT 'crm' AS source_namespace, c_custkey::VARCHAR AS source_key, c_custkey AS entity_id FROM customer UNION ALL SELECT 'erp', s_suppkey::VARCHAR, s_suppkey + 1000000 FROM supplier UNION ALL SELECT 'lab', s_suppkey::VARCHAR, s_suppkey + 2000000 FROM supplier),
    named AS (SELECT *, CASE WHEN source_namespace IN ('crm', 'erp') THEN 'people' ELSE source_namespace END AS ns FROM two), least AS (SELECT ns, source_key, min(entity_id) AS survivor_id FROM named GROUP BY ns, source_key HAVING count(DISTINCT entity_id) > 1)"""


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    one = lambda t, ns, k, add: t.select(F.lit(ns).alias("source_namespace"), F.col(k).cast("string").alias("source_key"), (F.col(k) + add).alias("entity_id"))
    registry = one(c, "crm", "c_custkey", 0).unionByName(one(s, "erp", "s_suppkey", 1_000_000)).unionByName(one(s, "lab", "s_suppkey", 2_000_000))
    return registry, spark.createDataFrame([("crm", "people"), ("erp", "people")], "source_namespace string, identity_namespace string")


@query(f"WITH {_TWO} SELECT n.source_namespace, n.source_key, n.entity_id AS retired_id, l.survivor_id FROM named n JOIN least l USING (ns, source_key) WHERE n.entity_id <> l.survivor_id")
def identity_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09, JOIN-08, ID-03: two namespaces share keys, a third must not."""
    return identity.collapse_plan(*_two(spark, sf_dir))


@query(f"WITH {_TWO} SELECT n.source_namespace, n.source_key, coalesce(l.survivor_id, n.entity_id) AS entity_id FROM named n LEFT JOIN least l USING (ns, source_key)")
def identity_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-16, twice: the second time nothing changes."""
    registry, groups = _two(spark, sf_dir)
    once = identity.remap(registry, identity.collapse_plan(registry, groups))
    return identity.remap(once, identity.collapse_plan(once, groups))


def _child(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = mapping.staged(spark, sf_dir)[1]
    return identity.children(table(spark, sf_dir, "orders"), _customers(spark, sf_dir), decisions, namespace="crm", key="o_custkey", code="o_orderpriority", row_ref="o_orderkey", schema="sf", table="orders")


@query(f"""WITH {mapping.VOCABULARY}, {_REGISTRY} SELECT {_MD5} AS child_id, r.entity_id AS parent_id, coalesce(d.target_id, 0) AS concept_id, NULL::DATE AS start_date, o_orderkey::VARCHAR AS source_row_ref,
    o_custkey::VARCHAR AS source_key, 'sf' AS source_schema, 'orders' AS source_table FROM orders o JOIN registry r ON r.source_key = o.o_custkey::VARCHAR LEFT JOIN decisions d ON d.code = o.o_orderpriority""")
def fk_closed_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-02, JOIN-07, FN-01, PRJ-06."""
    return _child(spark, sf_dir)


@query("SELECT count(*) AS n_orphans FROM lineitem l LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 > 0) o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderkey IS NULL")
def fk_closure_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-03, QA-04: some orders are left out, so that there are orphans."""
    parents = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 7 > 0)
    return quality.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey"), parents.select("o_orderkey"), "l_orderkey", "o_orderkey").agg(F.count("*").alias("n_orphans"))


@query("SELECT DISTINCT o_custkey AS entity_id FROM orders")
def parent_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-12, AGG-08."""
    return identity.parents(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity_id")))


_BLANKS = "src AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN '  ' ELSE ' ' || o_custkey || ' ' END AS k FROM orders)"


@query(f"WITH {_BLANKS} SELECT count(*) AS source_rows, count_if(trim(coalesce(k, '')) = '')::BIGINT AS missing_rows, count_if(trim(coalesce(k, '')) <> '')::BIGINT AS written_rows, true AS passed FROM src")
def qa_missing_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-06, QA-01, FLT-09, ID-01: null, blank and padded keys."""
    i = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(i, F.when(i % 9 == 0, None).when(i % 9 == 1, "  ").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(" "))).alias("k"))
    return quality.key_accounting(rows, identity.normal_keys(rows, "k"), "k")


@query("""WITH a AS (SELECT p_brand, p_size, p_partkey, p_retailprice FROM part WHERE p_partkey % 2 = 0), b AS (SELECT * FROM part WHERE p_partkey % 3 = 0),
    o AS (SELECT p_brand, p_size, arg_min(p_partkey, p_partkey) AS p_partkey, arg_min(p_retailprice, p_partkey) AS p_retailprice FROM a GROUP BY ALL),
    n AS (SELECT p_brand, p_size, arg_max(p_partkey, p_partkey) AS p_partkey, arg_max(p_retailprice, p_partkey) AS p_retailprice FROM b GROUP BY p_brand, p_size)
    SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.p_brand = o.p_brand AND n.p_size = o.p_size)""")
def value_mapping_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-14, AGG-25: the last of new rows replaces what is stored."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", "p_retailprice")
    key, i = ["p_brand", "p_size"], F.col("p_partkey")
    return ranked.upsert(ranked.pick(p.where(i % 2 == 0), key, [i]), p.where(i % 3 == 0), key, [-i])


@query("""WITH a AS (SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
    SELECT * FROM a WHERE o_orderpriority IS DISTINCT FROM '1-URGENT' UNION ALL SELECT o_orderpriority, o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderpriority = '1-URGENT'""")
def scope_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-09 to SNK-11, FLT-08."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ranked.replace_scope(o.where(F.col("o_orderkey") % 2 == 0), o.withColumn("o_totalprice", F.col("o_totalprice") + 1), {"o_orderpriority": "1-URGENT"})


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-14: a uniqueness check."""
    return quality.repeated_keys(table(spark, sf_dir, "orders"), ["o_custkey"])
