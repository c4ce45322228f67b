"""Study files made from the tables and read again, digests, provenance and scopes, and shapes closed under their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import keys
from weftline.functions import values as V
from weftline.functions.refs import table_key
from weftline.functions.text import canonical_name
from weftline.operators import graph, interpret, lifecycle, retrieve
from weftline.plans import build, fit, plugins
from weftline.queries import mapping
from weftline.queries.base import query, table
from weftline.queries.building import CLAIMS, claims
from weftline.queries.catalog import CATALOG_SQL, catalog
from weftline.queries.claims import SOURCES, _case, _case_sql
from weftline.sources import files, folders
from weftline.sources.staging import new_path


#: Files that a table is written as, at least, and the lines of one of them, about.
PARTS, LINES = 8, 500_000


def _file(spark: SparkSession, name: str, head: list[str], rows: DataFrame) -> str:
    """A folder of files of tab-separated lines, each with ``head`` and then its part of ``rows``, nulls as empty fields."""
    path, parts = new_path(spark, name), max(PARTS, -(-rows.count() // LINES))
    line = F.concat_ws("\t", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns))
    body = rows.select(F.pmod(F.xxhash64(line), F.lit(parts)).cast("int").alias("part"), F.lit(len(head)).alias("at"), line.alias("value"))
    heads = spark.createDataFrame([(p, i, h) for p in range(parts) for i, h in enumerate(head)], "part int, at int, value string")
    heads.union(body).repartitionById(parts, "part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(path)
    return path


@query("SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_name ELSE '' END AS name, c_mktsegment AS segment FROM customer")
def scan_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08, SRC-16."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_name")), "c_mktsegment")
    return files.read_tsv(spark, _file(spark, "t.txt", ["# a note", "", "c_custkey\tname\tsegment"], rows))


@query("SELECT c_custkey::VARCHAR AS \"ID\", CASE WHEN c_custkey % 5 > 0 THEN c_acctbal END AS \"BALANCE\", c_custkey % 2 = 0 AS \"ALIVE\" FROM customer")
def scan_clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09, SRC-17."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.when(k % 5 > 0, F.col("c_acctbal").cast("string")).otherwise("NA"), F.when(k % 2 == 0, "yes").otherwise("no"))
    return files.read_clinical(spark, _file(spark, "data_clinical_x.txt", ["#Id\tBalance\tAlive", "#the id\tmoney\t", "#STRING\tNUMBER\tBOOLEAN", "#1\t1\t1", "ID\tBALANCE\tALIVE"], rows))


@query("SELECT p_name AS \"Gene\", p_partkey AS \"Start_Position\", CASE WHEN p_size % 3 > 0 THEN p_size END AS t_depth, p_brand AS \"gene_2\" FROM part")
def scan_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: integers as decimals or words, a name that repeats in other letters."""
    p = table(spark, sf_dir, "part")
    rows = p.select("p_name", F.concat("p_partkey", F.lit(".0")), F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")).otherwise("none"), "p_brand")
    found = files.read_mutations(spark, _file(spark, "data_mutations.txt", ["Gene\tStart_Position\tt_depth\tgene"], rows))
    return found.select("Gene", "Start_Position", F.col("t_depth").cast("int").alias("t_depth"), "gene_2")


@query("SELECT p_partkey AS \"Site1_Position\", p_brand AS \"Name\" FROM part")
def scan_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11."""
    return files.read_variants(spark, _file(spark, "data_sv.txt", ["Site1_Position\tName"], table(spark, sf_dir, "part").select("p_partkey", "p_brand")))


@query("SELECT s AS sample_id, p_name AS hugo_symbol, p_partkey::VARCHAR AS entrez_gene_id, v::VARCHAR AS cna_value FROM (SELECT *, unnest(['S-1', 'S.2']) AS s, unnest([p_size % 5 - 2, CASE WHEN p_size % 4 > 0 THEN p_size % 3 END]) AS v FROM part)")
def scan_copy_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12, RSH-01."""
    s = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_name", "p_partkey", (s % 5 - 2).alias("a"), F.when(s % 4 > 0, s % 3).alias("b"))
    return files.read_copy_numbers(spark, _file(spark, "data_cna.txt", ["Hugo_Symbol\tEntrez_Gene_Id\tS-1\tS.2"], rows))


@query("SELECT * FROM (SELECT o_orderkey::VARCHAR AS sample_id, unnest(CASE WHEN o_orderkey % 2 > 0 THEN ['mutations', 'cna'] ELSE ['mutations'] END) AS assay, unnest(CASE WHEN o_orderkey % 2 > 0 THEN [o_orderpriority, o_orderstatus] ELSE [o_orderpriority] END) AS panel_id FROM orders)")
def scan_gene_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13, RSH-02."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 2 > 0, F.col("o_orderstatus")).otherwise(" ").alias("x"))
    return files.read_gene_panels(spark, _file(spark, "data_gene_panel_matrix.txt", ["SAMPLE_ID\tmutations\tcna"], rows))


@query("SELECT l_orderkey::VARCHAR AS sample_id, l_linestatus AS chrom, l_partkey AS loc_start, l_suppkey AS loc_end, l_linenumber::BIGINT AS num_mark, l_discount AS seg_mean FROM lineitem")
def scan_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_partkey", "l_suppkey", "l_linenumber", "l_discount")
    return files.read_segments(spark, _file(spark, "a.seg", ["ID\tchrom\tloc.start\tloc.end\tnum.mark\tseg.mean"], rows))


@query("SELECT event_type AS \"TEST\", value AS \"VALUE\", 'u' AS \"UNITS\" FROM events")
def scan_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15."""
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.lit("u").alias("u"))
    return files.read_timeline(spark, _file(spark, "data_timeline_lab.txt", ["TEST\tVALUE\tUNITS"], rows))


@query("SELECT p_partkey::VARCHAR AS concept_id, '\"' || p_name AS concept_name FROM part")
def scan_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18: quotes are letters like others."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('"'), "p_name").alias("n"))
    return files.read_vocabulary(spark, _file(spark, "CONCEPT.csv", ["concept_id\tconcept_name"], rows))


@query("SELECT o_orderpriority AS code, o_orderkey AS n FROM orders")
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-23."""
    rows = table(spark, sf_dir, "orders").select(F.to_json(F.struct(F.col("o_orderpriority").alias("code"), F.col("o_orderkey").alias("n"))))
    return files.read_jsonl(spark, _file(spark, "gold.jsonl", ["# gold", ""], rows), "code string, n bigint")


@query("""SELECT lower(n_name) AS "table", 'c' || n_nationkey AS "column", 'about ' || n_name AS comment FROM nation WHERE n_regionkey > 0""")
def scan_field_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("Table"), F.concat(F.lit("C"), "n_nationkey").alias("Column"), F.when(F.col("n_regionkey") > 0, F.concat(F.lit("about "), "n_name")).otherwise(" ").alias("Comment"))
    path = new_path(spark, "comments.csv")
    n.repartition(PARTS).write.option("header", True).csv(path)
    return files.field_comments(spark, path)


@query("""SELECT p_partkey, sha256('rule|brand=' || p_brand || '|size=' || p_size) AS row_key, sha256(p_name) AS text_digest, substr(sha256(least('a=' || p_brand, 'b=' || p_size) || '|' || greatest('a=' || p_brand, 'b=' || p_size)), 1, 12) AS join_digest FROM part""")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-04, FN-05, FN-06, FN-27."""
    size = F.col("p_size").cast("string")
    pairs = F.array(F.concat(F.lit("b="), size), F.concat(F.lit("a="), "p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", keys.row_key(F.lit("rule"), brand=F.col("p_brand"), size=size).alias("row_key"), keys.text_digest(F.col("p_name")).alias("text_digest"), keys.join_digest(pairs).alias("join_digest"))


@query(f"SELECT event_id, CASE {_case_sql('event_id % 5', SOURCES, 'other')} WHEN 'human' THEN 100 WHEN 'dbt' THEN 60 WHEN 'llm_interpretation' THEN 20 WHEN 'heuristic' THEN 15 ELSE 0 END AS standing FROM events")
def source_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-24."""
    return table(spark, sf_dir, "events").select("event_id", V.precedence(_case(F.col("event_id") % 5, SOURCES, "other")).alias("standing"))


@query("""SELECT brand, arg_min(p_partkey, (-confidence, p_partkey)) AS p_partkey FROM (SELECT *, p_brand AS brand, CASE WHEN p_size % 4 > 0 THEN (p_size % 10)::DOUBLE / 10::DOUBLE ELSE 0 END AS confidence FROM part) GROUP BY brand""")
def best_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), "p_partkey", F.when(F.col("p_size") % 4 > 0, (F.col("p_size") % 10).cast("double") / 10.0).alias("confidence"))
    return retrieve.best_artifacts(p.select("brand", "p_partkey", "confidence"), ["brand"]).select("brand", "p_partkey")


@query("""WITH h AS (SELECT o_orderstatus, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}') AS h FROM orders), p AS (SELECT o_orderstatus, substr(h, 1, 2) AS p, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY ALL)
    SELECT o_orderstatus, sha256(string_agg(p || d, '' ORDER BY p || d)) AS digest FROM p GROUP BY o_orderstatus""")
def snapshot_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-38."""
    return lifecycle.snapshot_digest(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderkey", "o_custkey"])


@query("""SELECT p_brand AS entity, f AS field FROM (SELECT DISTINCT p_brand FROM part) CROSS JOIN (VALUES ('id'), ('name'), ('size')) t(f) EXCEPT SELECT p_brand, CASE WHEN p_size % 2 = 0 THEN 'id' ELSE 'name' END FROM part WHERE p_size < 10""")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-07."""
    p = table(spark, sf_dir, "part")
    obligations = p.select(F.col("p_brand").alias("entity")).distinct().withColumn("required", F.array(F.lit("id"), F.lit("name"), F.lit("size")))
    return lifecycle.missing_fields(obligations, p.where("p_size < 10").select(F.col("p_brand").alias("entity"), F.when(F.col("p_size") % 2 == 0, "id").otherwise("name").alias("field")).distinct())


_DECODED = """c AS (SELECT 'c' || (p_size % 6) AS col, p_brand AS code, p_type AS label, 's' AS source_schema FROM part), named AS (SELECT *, CASE WHEN col IN ('c1', 'c4') THEN 'VOC' ELSE 'set:' || col END AS vocabulary FROM c)"""


def _decoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), (F.col("p_size") % 6).cast("string")).alias("column"), F.col("p_brand").alias("code"), F.col("p_type").alias("label"), F.lit("s").alias("source_schema"))
    return graph.decoded_values(c, spark.createDataFrame([("c1", "VOC"), ("c4", "VOC")], "column string, vocabulary string"))


@query(f"WITH {_DECODED} SELECT DISTINCT 'set:' || col AS value_set, vocabulary, code, source_schema FROM named")
def decoded_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-03, JOIN-35, JOIN-26."""
    return _decoded(spark, sf_dir)[2]


@query(f"WITH {_DECODED} SELECT vocabulary, code, min(label) AS label FROM named GROUP BY ALL")
def decoded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-03, JOIN-16."""
    return _decoded(spark, sf_dir)[1]


@query("""SELECT 'a' || o_orderkey AS alias, 'customer' AS label, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey""")
def alias_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-12."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("a"), "o_orderkey").alias("alias"), F.col("o_custkey").alias("to"))
    return graph.aliases(o, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("label"), F.col("c_name").alias("name")))


@query(f"WITH {CLAIMS} SELECT id, 'Column' AS label, brand || '.' || c AS name, predicate, source, confidence FROM claims WHERE of_column")
def claim_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-13, JOIN-27."""
    c = claims(spark, sf_dir)
    columns = c.select(F.col("subject").alias("ref")).distinct().where("ref rlike '/c[0-9]$'")
    name = F.concat_ws(".", F.element_at(F.split("ref", "/"), -2), F.element_at(F.split("ref", "/"), -1))
    return graph.provenance(c, columns.select("ref", F.lit("Column").alias("label"), name.alias("name")))


@query(f"WITH {CLAIMS} SELECT id FROM claims WHERE brand LIKE 'Brand#1%'")
def claims_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-30, SRC-30: references of one form find those of another."""
    c = claims(spark, sf_dir)
    tables = table(spark, sf_dir, "part").where("p_brand like 'Brand#1%'").select(F.concat(F.lit("unity://c.s."), "p_brand").alias("ref")).distinct()
    return graph.claims_of_table(c, tables).select("id")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN coalesce(CASE WHEN p_size % 5 > 0 THEN p_name END, p_brand) WHEN 1 THEN p_name ELSE p_name || CASE WHEN p_size % 2 = 0 THEN ' - ' || p_type ELSE '' END END AS text FROM part""")
def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-29."""
    p, i = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    name = F.when((i != 0) | (F.col("p_size") % 5 > 0), F.col("p_name"))
    made = interpret.embedding_text(F.when(i == 0, "term").when(i == 1, "alias").otherwise("part"), name, F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(" "), F.col("p_brand"))
    return p.select("p_partkey", made.alias("text"))


@query()
def embedded_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-04, UDF-08: no SQL, as the embedder is a plug-in."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 9 > 0, F.col("p_name")).alias("text"))
    return plugins.embed_nodes(rows, plugins.hashed_embedder(8))


_SHAPE = "known AS (SELECT o_custkey::VARCHAR AS source_key, dense_rank() OVER (ORDER BY o_custkey::VARCHAR) AS entity_id FROM (SELECT DISTINCT o_custkey FROM orders))"


def _shape(spark: SparkSession, sf_dir: str) -> fit.Shape:
    decisions = mapping.staged(spark, sf_dir)[1]
    return fit.shape(table(spark, sf_dir, "orders"), None, decisions, namespace="a", key="o_custkey", code="o_orderpriority", row_ref="o_orderkey", schema="sf", table="orders", run_id="r")


@query(f"WITH {_SHAPE} SELECT o_orderkey::VARCHAR AS source_row_ref, entity_id AS parent_id FROM orders JOIN known ON source_key = o_custkey::VARCHAR")
def closed_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FKC-01, AGG-07: the registry first, then children on its ids."""
    return _shape(spark, sf_dir).child.select("source_row_ref", "parent_id")


@query(f"""WITH {_SHAPE}, two AS (SELECT 'a' AS ns, source_key, entity_id FROM known UNION ALL SELECT 'b', source_key, entity_id + (SELECT count(*) FROM known) - 5 FROM known WHERE source_key::BIGINT % 2 = 0),
    least AS (SELECT source_key, min(entity_id) AS id FROM two GROUP BY 1) SELECT o_orderkey::VARCHAR AS source_row_ref, id AS parent_id FROM orders JOIN least ON source_key = o_custkey::VARCHAR""")
def collapsed_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FKC-02, ID-03: two namespaces of one group; children are on the ids that survive."""
    made = _shape(spark, sf_dir)
    n = made.registry.count()
    other = made.registry.where("cast(source_key as bigint) % 2 = 0").withColumns({"source_namespace": F.lit("b"), "entity_id": F.col("entity_id") + (n - 5)})
    both = fit.Shape(made.child, made.parent, made.registry.unionByName(other), made.missing)
    groups = spark.createDataFrame([("a", "g"), ("b", "g")], "source_namespace string, identity_namespace string")
    return fit.collapse(both, groups, "a").child.select("source_row_ref", "parent_id")


@query(f"""WITH {CATALOG_SQL} SELECT "table", 'sf' AS source_schema, count(*) AS n_columns FROM catalog GROUP BY 1""")
def materialised_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-01, GRF-11: the nodes of a catalog that was read twice."""
    c = catalog(spark, sf_dir).withColumn("comment", F.lit(None).cast("string"))
    made = build.materialise(c.unionByName(c), spark.createDataFrame([], "child_table string, confidence double"))
    return made.columns.groupBy("table", F.col("schema").alias("source_schema")).agg(F.count("*").alias("n_columns"))


@query("""SELECT o_orderkey, 'c.s.' || CASE o_orderkey % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'part' ELSE 'nation' END AS key FROM orders""")
def table_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-25, JOIN-30: one name for a table in three forms of references."""
    i = F.col("o_orderkey")
    ref = F.when(i % 3 == 0, "databricks://w/c/s/orders/x").when(i % 3 == 1, "unity://c.s.part").otherwise("postgres://h/c/s/nation/y")
    return table(spark, sf_dir, "orders").select(i, table_key(ref).alias("key"))


@query(r"""SELECT p_partkey, trim(regexp_replace(nfc_normalize('  Cafe' || chr(769) || '  ' || p_name || ' u' || chr(776)), '\s+', ' ', 'g')) AS name FROM part""")
def composed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-07: composed Unicode, then one space between words."""
    return table(spark, sf_dir, "part").select("p_partkey", canonical_name(F.concat(F.lit("  Cafe\u0301  "), "p_name", F.lit(" u\u0308"))).alias("name"))


@query("""SELECT kind, name, section, row_number() OVER (PARTITION BY kind ORDER BY name)::INT AS place FROM (SELECT DISTINCT k AS kind, p_name AS name, s AS section FROM part JOIN (VALUES ('entity', 1), ('obligation', 2), ('binding', 3), ('term', 4), ('card', 5)) t(k, s) ON s = p_size % 7 + 1)""")
def model_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-08."""
    kind = F.element_at(F.array(*(F.lit(k) for k in [*lifecycle.MODEL_PARTS, "x", "y"])), (F.col("p_size") % 7 + 1).cast("int"))
    return lifecycle.model_order(table(spark, sf_dir, "part").select(kind.alias("kind"), F.col("p_name").alias("name")))


def _study(spark: SparkSession, sf_dir: str) -> str:
    """200 files of orders in two studies, each with its header: one has the columns in another order, and one more; every 29th order is a line with a field too many."""
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    number, odd = (i % 200).cast("int"), i % 2 == 1
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = F.concat_ws("\t", text("o_orderkey"), text("o_custkey"), text("o_totalprice"))
    other = F.concat_ws("\t", text("o_totalprice"), text("o_orderstatus"), text("o_orderkey"), text("o_custkey"))
    line = F.concat(F.when(odd, other).otherwise(plain), F.when(i % 29 == 0, F.lit("\tmore")).otherwise(""))
    body = o.select(F.when(odd, "study_b").otherwise("study_a").alias("study"), number.alias("n"), F.lit(9).alias("at"), line.alias("value"))
    clinical = {
        0: ["#Key\tWho\tPrice", "#the key\tthe customer\tpaid", "#STRING\tSTRING\tNUMBER", "KEY\tWHO\tPRICE"],
        1: ["#Price\tStatus\tKey\tWho", "#paid\t\tthe key\tthe customer", "#NUMBER\tSTRING\tSTRING\tSTRING", "PRICE\tSTATUS\tKEY\tWHO"],
    }
    heads = spark.createDataFrame([("study_b" if n % 2 else "study_a", n, k, h) for n in range(200) for k, h in enumerate(clinical[n % 2])], "study string, n int, at int, value string")
    path = new_path(spark, "studies")
    heads.union(body).repartition(16, "n").sortWithinPartitions("study", "n", "at").select("study", "n", "value").write.partitionBy("study", "n").text(path)
    return path


@query("""SELECT o_orderkey::VARCHAR AS "KEY", o_custkey::VARCHAR AS "WHO", o_totalprice AS "PRICE", CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS "STATUS", CASE WHEN o_orderkey % 2 = 1 THEN 'b' ELSE 'a' END AS study FROM orders WHERE o_orderkey % 29 > 0""")
def study_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08, SRC-09, SRC-21, SRC-31: 200 files of two header variants in one scan."""
    found = folders.read_files(spark, [_study(spark, sf_dir)], "clinical")
    return found.select("KEY", "WHO", "PRICE", "STATUS", F.regexp_extract("source_file", "study=study_([ab])", 1).alias("study"))


@query("""SELECT n::INT AS n, count(*) FILTER (o_orderkey % 29 > 0) AS n_rows, count(*) FILTER (o_orderkey % 29 = 0) AS n_malformed, 2 AS n_comments FROM (SELECT unnest(range(200)) AS n) LEFT JOIN orders ON o_orderkey % 200 = n GROUP BY n""")
def study_folder_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08, SRC-31: good and bad lines of each of 200 files, and how many columns their headers comment besides the key."""
    path = [_study(spark, sf_dir)]
    n = F.regexp_extract("source_file", "/n=([0-9]+)/", 1).cast("int").alias("n")
    told = folders.comments(spark, path).where("column <> 'KEY'").groupBy(n).agg(F.count("*").cast("int").alias("n_comments"))
    return folders.malformed(spark, path).select(n, "n_rows", "n_malformed").join(told, "n")
