"""Codes to concepts: orders as a study, their priority as the code, a small vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import quality, resolve
from weftline.plans import fit
from weftline.queries.base import query, table

POLICY = resolve.Policy("PRIO", domain="Urgency")
#: (id, vocabulary, code, domain, standard, invalid): one plain code, one with two targets, one whose target is in another domain, one without a valid target.
CONCEPTS = [
    ("1", "PRIO", "1-URGENT", "Urgency", "S", None), ("2", "PRIO", "2-HIGH", "Urgency", None, None), ("3", "PRIO", "3-MEDIUM", "Urgency", None, None),
    ("4", "PRIO", "4-NOT SPECIFIED", "Urgency", None, None), ("101", "STD", "U1", "Urgency", "S", None), ("102", "STD", "U2", "Urgency", "S", None),
    ("103", "STD", "C1", "Comfort", "S", None), ("104", "STD", "X1", "Urgency", "S", "D"),
]
RELATIONS = [("2", "Maps to", "102"), ("2", "Maps to", "101"), ("3", "Maps to", "103"), ("4", "Maps to", "104"), ("4", "Is a", "101")]


def concepts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONCEPTS, "concept_id string, vocabulary string, code string, domain string, standard string, invalid_reason string")


def relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATIONS, "from_id string, relation string, to_id string")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


VOCABULARY = f"""
concepts(concept_id, vocabulary, code, domain, standard, invalid_reason) AS (VALUES {_values(CONCEPTS)}),
relations(from_id, relation, to_id) AS (VALUES {_values(RELATIONS)}),
codes AS (SELECT DISTINCT o_orderpriority AS code FROM orders WHERE o_orderpriority IS NOT NULL),
cand AS (SELECT c.code, k.concept_id, k.domain, k.standard, k.invalid_reason FROM codes c JOIN concepts k ON k.code = c.code AND k.vocabulary = 'PRIO'),
std AS (
    SELECT code, concept_id, domain FROM cand WHERE standard = 'S' AND invalid_reason IS NULL
    UNION SELECT cand.code, t.concept_id, t.domain FROM cand JOIN relations r ON r.from_id = cand.concept_id AND r.relation = 'Maps to'
        JOIN concepts t ON t.concept_id = r.to_id WHERE t.standard = 'S' AND t.invalid_reason IS NULL
),
alive AS (SELECT code, count(*) AS n, min(concept_id::BIGINT) AS target_id FROM std WHERE domain = 'Urgency' GROUP BY code),
decisions AS (
    SELECT c.code, a.target_id, CASE WHEN a.n > 0 THEN 'RESOLVED' ELSE 'NO_MAP' END AS resolution,
        CASE WHEN a.n > 1 THEN 'review_pending' ELSE 'auto_accepted' END AS status, CASE WHEN a.n > 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
        CASE WHEN a.n > 0 THEN NULL WHEN c.code NOT IN (SELECT code FROM cand) THEN '''PRIO'' has no such code'
            WHEN c.code NOT IN (SELECT code FROM std) THEN 'the code has no valid standard target by ''Maps to'''
            ELSE 'all standard targets are outside the domain ''Urgency''' END AS reason
    FROM codes c LEFT JOIN alive a ON a.code = c.code
)"""
STAGED = """
staged AS (
    SELECT 'sf' AS source_schema, 'orders' AS source_table, o_orderkey::VARCHAR AS source_row_ref, o_orderpriority AS source_value, d.target_id,
        coalesce(d.resolution, 'NO_MAP') AS resolution, d.status, d.confidence
    FROM orders o LEFT JOIN decisions d ON d.code = o.o_orderpriority
)"""


def staged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fit.stage(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", concepts(spark), relations(spark), POLICY, "sf", "orders")


@query(f"WITH {VOCABULARY}, {STAGED} SELECT * FROM staged")
def vocab_resolve_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-02, JOIN-01, PRJ-05."""
    return staged(spark, sf_dir)[0]


@query(f"WITH {VOCABULARY} SELECT * FROM decisions")
def resolve_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-01 to MAP-04, AGG-11, AGG-12, JOIN-04 to JOIN-06."""
    return staged(spark, sf_dir)[1]


@query(f"WITH {VOCABULARY} SELECT 'orders' AS source_table, min(confidence) AS confidence, bool_or(status = 'review_pending') AS review FROM decisions WHERE resolution = 'RESOLVED'")
def resolution_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, MAP-05."""
    return resolve.fold(staged(spark, sf_dir)[1].withColumn("source_table", F.lit("orders")), ["source_table"])


@query(f"""WITH {VOCABULARY}, {STAGED} SELECT *, resolved_but_null = 0 AND no_map_but_populated = 0 AS passed FROM (
    SELECT count(*) AS total, count_if(target_id IS NULL)::BIGINT AS null_rows, count_if(resolution = 'NO_MAP')::BIGINT AS no_map_rows,
        count_if(resolution = 'RESOLVED' AND target_id IS NULL)::BIGINT AS resolved_but_null, count_if(resolution = 'NO_MAP' AND target_id IS NOT NULL)::BIGINT AS no_map_but_populated FROM staged)""")
def qa_null_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-02."""
    return quality.null_rate(staged(spark, sf_dir)[0])


@query(f"""WITH {VOCABULARY}, {STAGED}, n AS (SELECT count(*) AS c, count(target_id) AS target_id, count(source_value) AS source_value, count(status) AS status FROM staged)
    SELECT 'target_id' AS "column", c - target_id AS n_nulls FROM n UNION ALL SELECT 'source_value', c - source_value FROM n UNION ALL SELECT 'status', c - status FROM n""")
def qa_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """QA-05, AGG-05."""
    return quality.null_counts(staged(spark, sf_dir)[0], ["target_id", "source_value", "status"])


@query("""WITH c(concept_id, standard, invalid_reason, domain) AS (VALUES ('1', 'S', NULL, 'Part'), ('2', NULL, NULL, 'Part'), ('3', 'S', 'D', 'Part'), ('4', 'S', NULL, 'Other')),
    d AS (SELECT p_brand AS code, (min(p_partkey) % 6)::BIGINT AS target_id FROM part GROUP BY p_brand)
    SELECT code, target_id, violation FROM (SELECT d.code, d.target_id, CASE WHEN c.concept_id IS NULL THEN 'absent' WHEN c.standard IS DISTINCT FROM 'S' THEN 'not standard'
        WHEN c.invalid_reason IS NOT NULL THEN 'invalid' WHEN c.domain IS DISTINCT FROM 'Part' THEN 'wrong domain' END AS violation
        FROM d LEFT JOIN c ON c.concept_id = d.target_id::VARCHAR) WHERE violation IS NOT NULL""")
def conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18, FLT-11: brands with made-up targets against a small vocabulary."""
    known = spark.createDataFrame([("1", "S", None, "Part"), ("2", None, None, "Part"), ("3", "S", "D", "Part"), ("4", "S", None, "Other")], "concept_id string, standard string, invalid_reason string, domain string")
    decisions = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("code")).agg((F.min("p_partkey") % 6).alias("target_id")).withColumn("resolution", F.lit("RESOLVED"))
    return resolve.conformance(decisions, known, resolve.Policy("P", domain="Part"))


_GOLD = """
gold AS (SELECT doc_id::VARCHAR AS code, CASE WHEN toxic = 1 THEN 'UNLABELLED' WHEN quality = 1 THEN 'RESOLVED' ELSE 'NO_MAP' END AS label, CASE WHEN quality = 1 THEN doc_id % 7 END AS gold_id FROM labels),
gold_n AS (SELECT g.*, d.n_chars AS row_count FROM gold g JOIN documents d ON d.doc_id::VARCHAR = g.code),
dec AS (SELECT doc_id::VARCHAR AS code, CASE WHEN doc_id % 5 = 0 THEN 'NO_MAP' ELSE 'RESOLVED' END AS resolution, CASE WHEN doc_id % 5 > 0 THEN doc_id % 7 + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END END AS target_id,
    CASE WHEN doc_id % 3 = 0 THEN 'review_pending' ELSE 'auto_accepted' END AS status FROM documents WHERE doc_id % 13 > 0),
zones AS (SELECT g.*, d.target_id, CASE WHEN d.resolution = 'NO_MAP' AND d.target_id IS NULL THEN 3 WHEN d.status IN ('auto_accepted', 'human_pinned') AND d.resolution = 'RESOLVED' AND d.target_id IS NOT NULL THEN 1 ELSE 2 END AS z
    FROM gold_n g LEFT JOIN dec d ON d.code = g.code WHERE label <> 'UNLABELLED'),
cells AS (SELECT code, CASE WHEN label = 'RESOLVED' THEN CASE z WHEN 1 THEN CASE WHEN target_id IS NOT DISTINCT FROM gold_id THEN 'tp' ELSE 'wrong' END WHEN 3 THEN 'fn' ELSE 'recall_miss' END
    ELSE CASE z WHEN 1 THEN 'fp_map' WHEN 3 THEN 'tn' ELSE 'na' END END AS cell, row_count, CASE WHEN row_count >= 1000 THEN 'high' WHEN row_count >= 100 THEN 'medium' ELSE 'low' END AS bucket FROM zones)"""
_COUNTS = ", ".join(f"count_if(cell = '{c}')::BIGINT AS {c}" for c in quality.CELLS)
_ROWS = ", ".join(f"coalesce(sum(row_count) FILTER (WHERE cell = '{c}'), 0)::BIGINT AS {c}_rows" for c in quality.CELLS)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as gold, made-up decisions on documents: every cell occurs."""
    docs = table(spark, sf_dir, "documents")
    label = F.when(F.col("toxic") == 1, "UNLABELLED").when(F.col("quality") == 1, "RESOLVED").otherwise("NO_MAP")
    gold = table(spark, sf_dir, "labels").join(docs.select("doc_id", F.col("n_chars").alias("row_count")), "doc_id")
    gold = gold.select(F.col("doc_id").cast("string").alias("code"), F.when(F.col("quality") == 1, F.col("doc_id") % 7).alias("gold_id"), label.alias("label"), "row_count")
    i = F.col("doc_id")
    none = i % 5 == 0
    decisions = docs.where(i % 13 > 0).select(
        i.cast("string").alias("code"), F.when(none, "NO_MAP").otherwise("RESOLVED").alias("resolution"), F.when(~none, i % 7 + F.when(i % 11 == 0, 1).otherwise(0)).alias("target_id"),
        F.when(i % 3 == 0, "review_pending").otherwise("auto_accepted").alias("status"),
    )
    return quality.cells(gold, decisions)


@query(f"WITH {_GOLD} SELECT bucket, {_COUNTS}, {_ROWS} FROM cells GROUP BY bucket")
def gold_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, AGG-15, FN-28, JOIN-21."""
    return quality.confusion(_cells(spark, sf_dir), ["bucket"])


@query(f"""WITH {_GOLD}, c AS (SELECT 'all' AS scope, {_COUNTS} FROM cells), m AS (SELECT *, tp / nullif(tp + wrong + fp_map, 0) AS p, (tp + wrong + fp_map) / nullif(tp + wrong + fn + recall_miss + tn + fp_map + na, 0) AS a FROM c)
    SELECT scope, p AS precision, tp / nullif(tp + wrong + fn + recall_miss, 0) AS recall, a AS auto_rate, tn / nullif(tn + fp_map, 0) AS no_map_accuracy, wrong + fn + fp_map > 0 AS contradicted,
        CASE WHEN p >= 0.95 AND a >= 0.70 THEN 'accepted' ELSE 'not_accepted' END AS verdict FROM m""")
def gold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14, AGG-16, AGG-17."""
    found = quality.metrics(quality.confusion(_cells(spark, sf_dir).withColumn("scope", F.lit("all")), ["scope"]))
    return found.select("scope", "precision", "recall", "auto_rate", "no_map_accuracy", "contradicted", "verdict")


@query("""WITH s AS (SELECT c_nationkey::VARCHAR AS code FROM customer UNION ALL SELECT s_nationkey::VARCHAR FROM supplier) SELECT code, count(*) AS n FROM s WHERE trim(coalesce(code, '')) <> '' GROUP BY code""")
def code_histogram_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06, SET-01."""
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("code"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("code"))
    return a.unionByName(b).where(F.trim(F.coalesce("code", F.lit(""))) != "").groupBy("code").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT event_id, value FROM events WHERE event_id % 3 < 2), b AS (SELECT event_id, CASE WHEN event_id % 6 = 1 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 3 > 0)
    SELECT * FROM (SELECT coalesce(a.event_id, b.event_id) AS event_id, CASE WHEN a.event_id IS NULL THEN 'added' WHEN b.event_id IS NULL THEN 'removed' WHEN a.value IS DISTINCT FROM b.value THEN 'changed' END AS change,
        a.value AS "old", b.value AS "new" FROM a FULL OUTER JOIN b ON a.event_id = b.event_id) WHERE change IS NOT NULL""")
def dump_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-22, SET-02: two overlapping dumps of events, one with changed values."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    i = F.col("event_id")
    return quality.diff(e.where(i % 3 < 2), e.where(i % 3 > 0).withColumn("value", F.when(i % 6 == 1, F.col("value") + 1).otherwise(F.col("value"))), ["event_id"], "value")
