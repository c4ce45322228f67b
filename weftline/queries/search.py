"""Vocabulary patterns, seeds, nearest vectors, ranking and context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import values as V
from weftline.functions.text import STOP_WORDS
from weftline.operators import retrieve
from weftline.plans import answer
from weftline.queries.base import query, table
from weftline.queries.catalog import CATALOG_SQL, catalog

_CELLS = """cells AS (SELECT 'zip' AS col, lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS v FROM part UNION ALL SELECT 'icd', CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE chr((65 + p_partkey % 20)::INT) || lpad((p_partkey % 100)::VARCHAR, 2, '0') || '.' || p_size % 10 END FROM part
    UNION ALL SELECT 'loinc', (p_partkey % 99999) || '-' || p_size % 10 FROM part UNION ALL SELECT 'name', p_name FROM part)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = table(spark, sf_dir, "part"), F.col("p_partkey")
    size = (F.col("p_size") % 10).cast("string")
    icd = F.when(i % 5 == 0, "none").otherwise(F.concat(F.char(65 + i % 20), F.lpad((i % 100).cast("string"), 2, "0"), F.lit("."), size))
    cells = {"zip": F.lpad((i % 100_000).cast("string"), 5, "0"), "icd": icd, "loinc": F.concat_ws("-", (i % 99_999).cast("string"), size), "name": F.col("p_name")}
    return reduce(DataFrame.unionByName, [p.select(F.lit(n).alias("col"), c.alias("v")) for n, c in cells.items()])


_MATCHES = " UNION ALL ".join(f"SELECT col, {i} AS i, '{name}' AS vocabulary, avg(regexp_matches(trim(v), '{V.vocabulary_pattern(i)}')::INT) AS ratio FROM cells GROUP BY col" for i, (name, *_) in enumerate(V.VOCABULARIES))


@query(f"WITH {_CELLS}, m AS ({_MATCHES}) SELECT col, vocabulary, round(ratio, 6) AS ratio, round(least(0.9 + (ratio - 0.6) * 0.25, 1.0), 6) AS confidence FROM m WHERE ratio >= 0.6")
def vocab_pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-16, FN-17, AGG-29: all patterns at once, one pass over the cells."""
    counts = [F.struct(F.lit(name).alias("vocabulary"), F.avg(F.trim("v").rlike(V.vocabulary_pattern(i)).cast("int")).alias("ratio")) for i, (name, *_) in enumerate(V.VOCABULARIES)]
    found = _cells(spark, sf_dir).groupBy("col").agg(F.array(*counts).alias("m")).select("col", F.explode("m").alias("m")).select("col", "m.*")
    return found.withColumn("confidence", F.round(V.pattern_confidence(F.col("ratio")), 6)).withColumn("ratio", F.round("ratio", 6)).where("ratio >= 0.6")


_QUESTIONS = [(1, "Which orders of a customer are open?"), (2, "the region and the nation's balance"), (3, "why"), (4, "tracking-code/status of all shipments")]
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SEEDS = f"""q(question_id, question) AS (VALUES {', '.join(f"({i}, '" + t.replace("'", "''") + "')" for i, t in _QUESTIONS)}),
    t AS (SELECT DISTINCT question_id, token FROM (SELECT question_id, unnest(regexp_split_to_array(lower(question), '[\\s\\-_/.,;:!?()]+')) AS token FROM q) WHERE length(token) >= 3 AND token NOT IN ({_STOP})),
    nodes AS (SELECT DISTINCT 'column' AS label, "column" AS name, 0.6::DOUBLE AS confidence FROM catalog UNION ALL SELECT DISTINCT 'table', "table", 0.9::DOUBLE FROM catalog),
    seeds AS (SELECT question_id, label, name, confidence, count(*) AS n_tokens FROM nodes JOIN t ON contains(lower(name), token) GROUP BY ALL)"""


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_QUESTIONS, "question_id int, question string")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    node = lambda label, column, confidence: c.select(F.lit(label).alias("label"), F.col(column).alias("name")).distinct().withColumn("confidence", F.lit(confidence))
    return node("column", "column", 0.6).unionByName(node("table", "table", 0.9))


@query(f"WITH {CATALOG_SQL}, {_SEEDS} SELECT question_id, label, name, n_tokens, confidence, 1.0::DOUBLE AS score, 'lexical_exact' AS match FROM seeds")
def lexical_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-05, FN-13, FN-15."""
    return retrieve.lexical_seeds(_questions(spark), _nodes(spark, sf_dir))


@query(f"WITH {CATALOG_SQL}, {_SEEDS} SELECT question_id, label, name, round(0.4 + confidence * 0.3 + 0.3 + 0.3, 6) AS final_score FROM seeds")
def lexical_seed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-23, AGG-23, SRT-02, VEC-06."""
    return answer.hits(_questions(spark), _nodes(spark, sf_dir)).select("question_id", "label", "name", F.round("final_score", 6).alias("final_score"))


@query("""WITH q AS (SELECT c_custkey AS question_id, 'Where is ' || substr(c_name, 6) || ' of ' || c_mktsegment || ', buyer of a ' || p_name || '?' AS question FROM customer LEFT JOIN part ON p_partkey = c_custkey),
    t AS (SELECT DISTINCT question_id, token FROM (SELECT question_id, unnest(regexp_split_to_array(lower(question), '[\\s\\-_/.,;:!?()]+')) AS token FROM q) WHERE length(token) >= 3 AND token NOT IN (""" + _STOP + """)),
    nodes AS (SELECT 'customer' AS label, c_name AS name FROM customer UNION SELECT 'supplier', s_name FROM supplier UNION SELECT 'part', p_name FROM part),
    tokens AS (SELECT DISTINCT token FROM t), met AS (SELECT label, name, token FROM nodes JOIN tokens ON contains(lower(name), token))
    SELECT question_id, label, name, count(*) AS n_tokens FROM met JOIN t USING (token) GROUP BY ALL""")
def lexical_seeds_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-05, FN-15: a question of every customer, against the names of all customers, suppliers and parts."""
    c, p = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    text = F.concat(F.lit("Where is "), F.substring("c_name", 6, 100), F.lit(" of "), "c_mktsegment", F.lit(", buyer of a "), "p_name", F.lit("?"))
    questions = c.join(p, c["c_custkey"] == p["p_partkey"], "left").select(F.col("c_custkey").alias("question_id"), text.alias("question"))
    node = lambda t, label, name: table(spark, sf_dir, t).select(F.lit(label).alias("label"), F.col(name).alias("name"), F.lit(0.9).alias("confidence"))
    nodes = reduce(DataFrame.unionByName, [node("customer", "customer", "c_name"), node("supplier", "supplier", "s_name"), node("part", "part", "p_name")])
    return retrieve.lexical_seeds(questions, nodes).select("question_id", "label", "name", "n_tokens")


_NEAR = """pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM pairs) WHERE rank <= 10)"""


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieve.nearest(v.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query")), v, 10)


@query(f"WITH {_NEAR} SELECT query_id, id, score, rank FROM near")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-01, VEC-02, SRT-01."""
    return _near(spark, sf_dir)


@query(f"""WITH {_NEAR}, h AS (SELECT query_id, id, score, 'vector' AS match, 0.0 AS boost FROM near UNION ALL SELECT query_id, id, 1.0, 'lexical_exact', 0.3 FROM near WHERE id % 3 = 0)
    SELECT query_id AS question_id, 'v' || id AS name, round(max(score * 0.4 + 0.5 * 0.3 + boost + 0.3), 6) AS final_score FROM h WHERE id % 7 > 0 GROUP BY query_id, id""")
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-06: both kinds of hits, deprecated ones left out, the best of each node."""
    n = _near(spark, sf_dir)
    hit = lambda t, score, match: t.select(F.col("query_id").alias("question_id"), F.lit("vec").alias("label"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("name"), score.alias("score"), F.lit(None).cast("double").alias("confidence"), F.lit(match).alias("match"), F.when(F.col("id") % 7 == 0, "DEPRECATED").alias("status"))
    both = hit(n, F.col("score"), "vector").unionByName(hit(n.where("id % 3 = 0"), F.lit(1.0), "lexical_exact"))
    return retrieve.ranked(both).select("question_id", "name", F.round("final_score", 6).alias("final_score"))


@query("""WITH t AS (SELECT DISTINCT p_brand AS code, 'v' || (p_size % 5) AS vocabulary FROM part), h AS (SELECT DISTINCT p_size % 3 AS question_id, p_brand AS code FROM part)
    SELECT question_id, code, vocabulary, n > 1 AS ambiguous FROM (SELECT *, row_number() OVER (PARTITION BY question_id, code ORDER BY vocabulary) AS r, count(*) OVER (PARTITION BY question_id, code) AS n FROM h JOIN t USING (code)) WHERE r <= 3""")
def term_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-10, SRT-04."""
    p = table(spark, sf_dir, "part")
    terms = p.select(F.col("p_brand").alias("code"), F.concat(F.lit("v"), (F.col("p_size") % 5).cast("string")).alias("vocabulary"))
    hits = p.select((F.col("p_size") % 3).alias("question_id"), F.col("p_brand").alias("name")).distinct()
    return retrieve.term_expansion(terms, hits)


@query("""SELECT 'Status' AS property, 'o_orderstatus' AS "column", 'orders' AS "table", string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS codes FROM orders UNION ALL
    SELECT 'Priority', 'o_orderpriority', 'orders', string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FROM orders""")
def governed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-27, JOIN-14."""
    o = table(spark, sf_dir, "orders")
    one = lambda prop, c: o.select(F.lit(prop).alias("property"), F.lit(c).alias("column"), F.lit("orders").alias("table"), F.lit("v").alias("vocabulary"), F.lit(False).alias("ambiguous"), F.col(c).alias("code"), F.lower(c).alias("label"))
    found = retrieve.governed_values(one("Status", "o_orderstatus").unionByName(one("Priority", "o_orderpriority")))
    return found.select("property", "column", "table", F.array_join(F.transform("values", lambda v: v["code"]), ",").alias("codes"))


_WRONG = ["CANDA", "germny", "Untied States", "x"]


@query(f"""WITH w(wrong) AS (VALUES {', '.join(f"('{x}')" for x in _WRONG)}) SELECT wrong, known, distance, n FROM (SELECT *, row_number() OVER (PARTITION BY wrong ORDER BY distance, known)::INT AS n FROM
    (SELECT wrong, n_name AS known, levenshtein(lower(wrong), lower(n_name))::INT AS distance FROM nation, w)) WHERE n <= 3""")
def edit_distance_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-22, SRT-06."""
    return retrieve.suggestions(_WRONG, table(spark, sf_dir, "nation").select(F.col("n_name").alias("known")))


@query("""WITH w AS (SELECT DISTINCT wrong FROM (SELECT left(s_name, (s_suppkey % 8)::INT) || substr(s_name, (s_suppkey % 8)::INT + 2) AS wrong FROM supplier UNION ALL SELECT upper(p_name) || 's' FROM part UNION ALL SELECT p_type || ' ' || p_brand FROM part)),
    known AS (SELECT p_name AS known FROM part UNION SELECT s_name FROM supplier UNION SELECT n_name FROM nation)
    SELECT wrong, known, distance, n FROM (SELECT *, row_number() OVER (PARTITION BY wrong ORDER BY distance, known)::INT AS n FROM (SELECT wrong, known, levenshtein(lower(wrong), lower(known))::INT AS distance FROM known, w)) WHERE n <= 3""")
def nearest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-22, SRT-06: misspelt names of all suppliers and parts, and words that are near to none, against all names."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    cut_at = (F.col("s_suppkey") % 8).cast("int")
    wrong = s.select(F.concat(F.substring("s_name", F.lit(1), cut_at), F.substring("s_name", cut_at + 2, F.length("s_name"))).alias("wrong"))
    wrong = wrong.union(p.select(F.concat(F.upper("p_name"), F.lit("s")))).union(p.select(F.concat_ws(" ", "p_type", "p_brand")))
    known = p.select(F.col("p_name").alias("known")).union(s.select("s_name")).union(table(spark, sf_dir, "nation").select("n_name"))
    return retrieve.suggestions(wrong, known)


@query(f"""WITH {CATALOG_SQL}, asked AS (SELECT "table", CASE WHEN position % 3 = 1 THEN 'gone' ELSE "column" END AS "column" FROM catalog UNION ALL SELECT "table" || 's', "column" FROM catalog WHERE position < 2 UNION ALL SELECT DISTINCT "table", NULL FROM catalog UNION ALL SELECT 'nowhere', NULL)
    SELECT DISTINCT "table", "column" FROM asked a WHERE "table" NOT IN (SELECT "table" FROM catalog) OR ("column" IS NOT NULL AND NOT EXISTS (SELECT 1 FROM catalog c WHERE c."table" = a."table" AND c."column" = a."column"))""")
def closed_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17: references to the catalog's columns, some of them to columns or tables that it lacks."""
    c = catalog(spark, sf_dir)
    asked = c.select("table", F.when(F.col("position") % 3 == 1, "gone").otherwise(F.col("column")).alias("column")).unionByName(c.where("position < 2").select(F.concat("table", F.lit("s")).alias("table"), "column"))
    asked = asked.unionByName(c.select("table", F.lit(None).cast("string").alias("column")).distinct()).unionByName(spark.createDataFrame([("nowhere", None)], "table string, column string"))
    return retrieve.unknown_references(asked, c)


@query("""SELECT vec_id FROM embeddings WHERE vec_id % 10 = 0 OR vec_id % 10 <> 3""")
def stale_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC-03: every tenth has none, most have one of an older text."""
    i = F.col("vec_id")
    text = F.concat(F.lit("text of "), i.cast("string"))
    digest = F.when(i % 10 == 3, F.sha2(text, 256)).otherwise(F.sha2(F.lit("older"), 256))
    nodes = table(spark, sf_dir, "embeddings").select(i, F.when(i % 10 > 0, F.col("embedding")).alias("embedding"), text.alias("description"), digest.alias("description_hash"))
    return retrieve.stale_embeddings(nodes).select("vec_id")
