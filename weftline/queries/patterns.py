"""Mapping patterns on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import reshape
from weftline.operators.reshape import Aggregate, Field
from weftline.queries.base import query, table


@query("SELECT l_orderkey AS orderkey, l_quantity::BIGINT AS quantity, l_shipdate::DATE AS shipped, try_cast(l_returnflag AS BIGINT) AS flag FROM lineitem")
def cast_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-01, PRJ-03, PRJ-04: casts that fail are null."""
    fields = [Field("t.orderkey", "src.l_orderkey"), Field("t.quantity", "l_quantity", cast="bigint"), Field("t.shipped", "l_shipdate", cast="date"), Field("t.flag", "l_returnflag", cast="bigint")]
    return reshape.project(table(spark, sf_dir, "lineitem"), fields)


@query("SELECT o_orderkey AS id, 'sf' AS origin, NULL::VARCHAR AS note FROM orders")
def constant_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-02."""
    return reshape.project(table(spark, sf_dir, "orders"), [Field("id", "o_orderkey"), Field("origin", constant="sf", is_constant=True), Field("note", is_constant=True)]).withColumn("note", F.col("note").cast("string"))


@query("""SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS O, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY o_orderpriority""")
def pivot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH-04."""
    wide = reshape.pivot(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", ["F", "O", "P"])
    return wide.select("o_orderpriority", *(F.round(c, 2).alias(c) for c in ("F", "O", "P")))


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS size, CASE WHEN p_partkey % 4 > 0 THEN p_retailprice END AS price FROM part) SELECT p_partkey, 'size' AS metric, size AS value FROM p UNION ALL SELECT p_partkey, 'price', price FROM p""")
def unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH-01, RSH-03: nulls stay."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_retailprice")).alias("price"))
    return reshape.unpivot(p, ["p_partkey"], ["size", "price"], "metric", "value")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_brand END AS a, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS b FROM part)
    SELECT p_partkey, 'a' AS assay, a AS panel FROM p WHERE trim(coalesce(a, '')) <> '' UNION ALL SELECT p_partkey, 'b', b FROM p WHERE trim(coalesce(b, '')) <> ''""")
def unpivot_nonblank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH-02."""
    i = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(i, F.when(i % 3 == 0, " ").otherwise(F.col("p_brand")).alias("a"), F.when(i % 5 > 0, F.col("p_type")).alias("b"))
    return reshape.unpivot(p, ["p_partkey"], ["a", "b"], "assay", "panel", keep_blanks=False)


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS rank, CASE WHEN contains(o_orderpriority, '-') THEN split_part(o_orderpriority, '-', 2) END AS name FROM orders")
def split_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-30."""
    return reshape.split(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-", ["rank", "name"]).drop("o_orderpriority")


@query("""SELECT o_custkey, count(o_orderkey) AS n, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS open_total, arg_min(o_orderkey, o_orderkey) AS first_order, arg_max(o_orderpriority, o_orderkey) AS last_priority, bool_or(o_totalprice > 200000) AS any_large,
    bool_and(o_totalprice > 20000) AS all_large, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey HAVING count(o_orderkey) >= 10""")
def aggregate_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-39."""
    o = table(spark, sf_dir, "orders").withColumns({"large": F.col("o_totalprice") > 200_000, "medium": F.col("o_totalprice") > 20_000})
    found = reshape.aggregate(
        o, ["o_custkey"],
        [Aggregate("n", "COUNT", "o_orderkey"), Aggregate("open_total", "SUM", "o_totalprice", where="o_orderstatus = 'O'"), Aggregate("first_order", "FIRST", "o_orderkey"), Aggregate("last_priority", "LAST", "o_orderpriority", order="o_orderkey"),
         Aggregate("any_large", "ANY", "large"), Aggregate("all_large", "ALL", "medium"), Aggregate("keys", "ARRAY_AGG", "o_orderkey")],
        having="n >= 10",
    )
    return found.withColumn("keys", F.array_join("keys", ",")).withColumn("open_total", F.round("open_total", 2))


@query("SELECT o_custkey, min(o_orderdate) AS low, max(o_orderdate) AS high FROM orders GROUP BY o_custkey")
def rowgen_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH-05, WIN-07."""
    return reshape.envelope(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderdate")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def rowgen_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSH-05."""
    return reshape.distinct_rows(table(spark, sf_dir, "part"), ["p_brand", "p_type"])


@query("SELECT s_suppkey, s_nationkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 4 > 0) ON n_nationkey = s_nationkey")
def join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-32."""
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 4 > 0")
    return reshape.lookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), nations, reshape.Lookup("s_nationkey", "n_nationkey", ["n_name"]))


@query("""WITH w AS (SELECT doc_id, string_split(source || ' ' || lang, ' ') AS s FROM documents) SELECT doc_id, unnest(s) AS synonym, unnest(range(1, len(s) + 1)) = 1 AS is_preferred FROM w""")
def preferred_synonym(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-05."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.concat_ws(" ", "source", "lang"), " ").alias("s"))
    return reshape.preferred_first(d, "doc_id", "s")
