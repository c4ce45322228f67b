"""Rules on what interpreters said, lifecycles and entity matching: events and parts stand for results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import interpret, lifecycle, match
from weftline.queries.base import query, table

_TYPES = ["identifier", "categorical", "Temporal", "numeric", "free text"]
_TYPE_SQL = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TYPES)) + " END"


def _type() -> Column:
    out = F.lit(None).cast("string")
    for i, t in enumerate(_TYPES):
        out = F.when(F.col("event_id") % 5 == i, t).otherwise(out)
    return out


@query(f"""WITH c AS (SELECT event_id, lower({_TYPE_SQL}) AS t, event_id % 7 = 0 AS flagged, event_id % 90 AS d, event_id % 3 > 0 AS v, (event_id % 10)::DOUBLE / 10::DOUBLE AS conf, event_id % 4 = 0 AS noted FROM events)
    SELECT event_id FROM c WHERE t NOT IN ('identifier', 'temporal', 'free text') AND (flagged OR (d <= 50 AND v) OR (conf < 0.5 AND noted))""")
def decoding_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(i, _type().alias("semantic_type"), (i % 7 == 0).alias("flagged"), (i % 90).alias("n_distinct"), (i % 3 > 0).alias("has_values"), ((i % 10) / 10.0).alias("confidence"), F.when(i % 4 == 0, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>")).alias("notes"))
    return rows.where(interpret.needs_decoding()).select("event_id")


@query("""WITH c AS (SELECT user_id, NOT ((event_id % 10)::DOUBLE / 10::DOUBLE < 0.4 AND event_id % 4 = 0) AS ok, event_id % 40 = 8 AS crit, CASE WHEN user_id % 2 = 0 THEN 'rich' ELSE 'sparse' END AS tier FROM events),
    g AS (SELECT user_id, round(count_if(ok)::DOUBLE / count(*), 4) AS raw, coalesce(round(count_if(ok AND crit)::DOUBLE / nullif(count_if(crit), 0), 4), 1.0) AS critical, min(tier) AS tier FROM c GROUP BY user_id)
    SELECT user_id AS "table", raw, critical, CASE WHEN critical < 1 THEN 'B_FAILED' WHEN raw >= 1 THEN 'B_SUCCESS' WHEN raw >= CASE WHEN tier = 'rich' THEN 0.75 ELSE 0.6 END THEN 'B_PARTIAL' ELSE 'B_FAILED' END AS outcome FROM g""")
def stage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-35, FLT-13."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("table"), i, ((i % 10) / 10.0).alias("confidence"), F.when(i % 4 == 0, F.array(F.lit("n"))).otherwise(F.array().cast("array<string>")).alias("notes"))
    columns = rows.select("table", (~interpret.unresolved(rows)).alias("resolved"), (i % 40 == 8).alias("critical"), F.when(F.col("table") % 2 == 0, "rich").otherwise("sparse").alias("tier"))
    return interpret.coverage(columns)


#: vocabulary, what a model guessed, kind and name of a column; then the confidence of 0.7 after the guess, whether there is a hierarchy, and whether the name is one of codes.
_NAMES = [("ICD-10", "icd-10 codes", "categorical", "dx_code", 0.1, True, True), ("AJCC Staging", "AJCC 8th edition", "categorical", "stage", 0.1, True, True), ("TNM Classification", None, "Numeric", "t", 0.0, False, False), ("LOINC", "SNOMED", "identifier", "lab", 0.0, False, False), ("ZIP", "zip", None, "zip", 0.1, False, False)]


@query(f"""WITH g(n, vocabulary, guess, kind, name, boost, hierarchical, coded) AS (VALUES {", ".join("(" + str(n) + ", " + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::DOUBLE" if isinstance(v, float) else f"'{v}'" for v in r) + ")" for n, r in enumerate(_NAMES))})
    SELECT event_id, vocabulary, round((event_id % 8)::DOUBLE / 10 + boost, 6) AS confidence, hierarchical, CASE WHEN coded THEN event_type || '_' || name ELSE name END AS name, coded FROM events JOIN g ON n = event_id % 5""")
def vocabulary_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-18 to FN-20: a guess on a column for every event."""
    n = F.col("event_id") % 5
    of = lambda k: reduce(lambda c, x: c.when(n == x[0], F.lit(x[1][k])), enumerate(_NAMES[1:], 1), F.when(n == 0, F.lit(_NAMES[0][k])))
    name = F.when(of(6), F.concat_ws("_", "event_type", of(3))).otherwise(of(3))
    rows = table(spark, sf_dir, "events").select("event_id", of(0).alias("vocabulary"), of(1).alias("guess"), of(2).alias("kind"), name.alias("name"), ((F.col("event_id") % 8).cast("double") / 10.0).alias("c"))
    v = F.col("vocabulary")
    return rows.select("event_id", "vocabulary", F.round(interpret.boosted(F.col("c"), v, F.col("guess")), 6).alias("confidence"), interpret.has_hierarchy(F.col("kind"), v).alias("hierarchical"), "name", interpret.is_coded_name(F.col("name")).alias("coded"))


@query("""WITH t AS (SELECT 't' || n_nationkey AS ref, n_name AS entity, n_regionkey % 2 = 0 AS fixed FROM nation), a AS (SELECT ref, unnest(['x' || ref, 'y' || ref]) AS v, unnest([true, false]) AS p FROM t WHERE NOT fixed)
    SELECT ref AS subject, 'has_entity_name' AS predicate, '{"value":"' || CASE WHEN fixed THEN 'fixed' ELSE entity END || '","grain":"row"}' AS payload FROM t UNION ALL SELECT ref, 'has_alias', '{"value":"' || v || '","is_preferred":' || p || '}' FROM a
    UNION ALL SELECT ref || '.c', 'has_property_name', '{"value":"p"}' FROM t WHERE fixed UNION ALL SELECT ref || '.c', 'has_semantic_type', '{"value":"k"}' FROM t WHERE fixed UNION ALL SELECT ref || '.c', 'has_decoded_value', '{"raw":"1","label":"one"}' FROM t""")
def stage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-09, JOIN-34."""
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("ref"), F.col("n_name").alias("entity"), (F.col("n_regionkey") % 2 == 0).alias("fixed"))
    names = F.array(F.concat(F.lit("x"), "ref"), F.concat(F.lit("y"), "ref"))
    tables = n.select("ref", "entity", F.lit("row").alias("grain"), names.alias("synonyms"), F.lit(0.9).alias("confidence"), F.when(F.col("fixed"), "fixed").alias("entity_fix"), F.lit(None).cast("string").alias("grain_fix"))
    ref = F.concat("ref", F.lit(".c"))
    columns = n.select(ref.alias("ref"), F.lit("p").alias("property"), F.lit("k").alias("semantic_type"), F.array().cast("array<string>").alias("synonyms"), F.lit(0.8).alias("confidence"), F.col("fixed").alias("resolved"))
    decoded = n.select(ref.alias("ref"), F.lit("1").alias("raw"), F.lit("one").alias("label"))
    return interpret.merged_claims(tables, columns, decoded).drop("confidence")


_RUN = """r AS (SELECT event_id AS i, CASE WHEN event_id % 10 < 6 THEN 'success' WHEN event_id % 10 < 9 THEN 'failed' ELSE 'skipped' END AS status, event_id % 4 = 0 AS partial, CASE WHEN event_id % 10 = 6 THEN 'L2 stage B' ELSE 'L2 stage A' END AS stage, CASE WHEN event_id % 20 = 9 THEN 'resume: done' END AS skip FROM events)"""


@query(f"""WITH {_RUN}, n AS (SELECT count_if(status = 'success')::BIGINT AS succeeded, count_if(status = 'success' AND partial)::BIGINT AS partial, count_if(status = 'failed' AND stage = 'L2 stage B')::BIGINT AS stage_b_failed,
    count_if(status = 'failed' AND stage <> 'L2 stage B')::BIGINT AS other_failed, count_if(status = 'skipped' AND skip IS NOT NULL)::BIGINT AS resumed, count_if(status = 'skipped')::BIGINT AS skipped,
    sum(CASE WHEN status = 'success' THEN i % 3 END)::BIGINT AS n_entities, sum(CASE WHEN status = 'success' THEN i % 5 END)::BIGINT AS n_properties, sum(CASE WHEN status = 'success' THEN i % 7 END)::BIGINT AS n_terms FROM r)
    SELECT *, CASE WHEN succeeded + stage_b_failed + resumed >= 5 AND stage_b_failed / (succeeded + stage_b_failed + resumed) > 0.3 THEN 'stage_b_failure_rate'
        WHEN succeeded + stage_b_failed + other_failed + skipped - resumed >= 5 AND other_failed / (succeeded + stage_b_failed + other_failed + skipped - resumed) > 0.4 THEN 'run_non_contributing_rate' END AS broken FROM n""")
def build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-36."""
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.when(i % 10 < 6, "success").when(i % 10 < 9, "failed").otherwise("skipped").alias("status"), (i % 4 == 0).alias("partial"), F.when(i % 10 == 6, "L2 stage B").otherwise("L2 stage A").alias("failed_stage"),
        F.when(i % 20 == 9, "resume: done").alias("skip_reason"), (i % 3).alias("n_entities"), (i % 5).alias("n_properties"), (i % 7).alias("n_terms"),
    )
    return interpret.run_report(rows)


@query("""SELECT count(*) AS n_tables, count_if(event_id % 3 = 0)::BIGINT AS b_success, count_if(event_id % 3 = 1)::BIGINT AS b_partial, count_if(event_id % 3 = 2)::BIGINT AS b_failed, round(avg((event_id % 9)::DOUBLE / 9::DOUBLE), 4) AS avg_coverage,
    round(avg(event_id % 1000), 1) AS avg_latency_ms, sum(event_id % 2)::BIGINT AS retries, sum(event_id % 77)::BIGINT AS tokens_in, sum(event_id % 33)::BIGINT AS tokens_out FROM events""")
def run_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-37."""
    i = F.col("event_id")
    outcome = F.when(i % 3 == 0, "B_SUCCESS").when(i % 3 == 1, "B_PARTIAL").otherwise("B_FAILED")
    return interpret.telemetry(table(spark, sf_dir, "events").select(outcome.alias("outcome"), ((i % 9) / 9.0).alias("coverage"), (i % 1000).alias("latency_ms"), (i % 2).alias("retries"), (i % 77).alias("tokens_in"), (i % 33).alias("tokens_out")))


@query("""WITH a AS (SELECT p_brand AS t, count(*) AS n FROM part WHERE p_partkey % 2 = 0 AND p_brand < 'Brand#4' GROUP BY 1), b AS (SELECT p_brand AS t, count(*) AS n FROM part WHERE p_partkey % 3 = 0 AND p_brand > 'Brand#2' GROUP BY 1)
    SELECT coalesce(a.t, b.t) AS "table", a.n AS n_old, b.n AS n_new, CASE WHEN a.t IS NULL THEN 'only_new' WHEN b.t IS NULL THEN 'only_old' ELSE 'both' END AS state FROM a FULL OUTER JOIN b ON a.t = b.t""")
def run_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-33."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("databricks://w/c/s/"), "p_brand").alias("ref"), "p_partkey", "p_brand")
    return interpret.churn(p.where("p_partkey % 2 = 0 and p_brand < 'Brand#4'"), p.where("p_partkey % 3 = 0 and p_brand > 'Brand#2'"))


_STATUS = ["candidate", "auto_accepted", "review_pending", "human_pinned", "rejected"]
_ALLOWED = [(a, b) for a, bs in lifecycle.TRANSITIONS.items() for b in bs]


_STATUS_OF = "CASE {} % 5 " + " ".join(f"WHEN {n} THEN '{s}'" for n, s in enumerate(_STATUS)) + " END"


@query(f"""WITH moves AS (SELECT event_id, {_STATUS_OF.format('event_id')} AS current, {_STATUS_OF.format('(event_id // 5)')} AS target FROM events)
    SELECT event_id, current, target, (current, target) IN ({", ".join(f"('{a}', '{b}')" for a, b in _ALLOWED)}) AS allowed FROM moves""")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-07: whether each event's status may follow the one before."""
    moves = table(spark, sf_dir, "events").select("event_id", F.expr(_STATUS_OF.format("event_id")).alias("current"), F.expr(_STATUS_OF.format("(event_id div 5)")).alias("target"))
    return moves.withColumn("allowed", lifecycle.may_follow(F.col("current"), F.col("target")))


@query("""WITH b AS (SELECT event_id AS i FROM events) SELECT i AS id, CASE WHEN i % 11 = 0 THEN 'awaiting_review' WHEN i % 7 = 0 THEN 'blocked_by_resolution' WHEN i % 5 = 0 OR i % 13 = 0 THEN 'blocked_by_obligation' WHEN i % 3 = 0 THEN 'blocked_by_fk'
    WHEN i % 2 = 0 THEN 'blocked_by_constraint' ELSE 'compilable' END AS plan, CASE WHEN i % 11 = 0 THEN 'awaiting_review' WHEN i % 2 = 0 AND i % 3 = 0 THEN 'unresolved' WHEN i % 5 = 0 THEN 'ambiguous' WHEN i % 7 = 0 THEN 'unresolved' WHEN i % 2 = 0 THEN 'awaiting_review' ELSE 'resolved' END AS resolution FROM b""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-06, MAP-10."""
    i = F.col("event_id")
    every = lambda n: i % n == 0
    rows = table(spark, sf_dir, "events").select(
        i.alias("id"), every(11).alias("review_pending"), every(7).alias("resolution_missing"), every(5).alias("required_missing"), every(13).alias("row_violated"), every(3).alias("fk_unsatisfied"),
        F.when(every(2), F.array(F.lit("RISK_X"), F.lit("RISK_VOCAB_DOMAIN_MISMATCH"))).otherwise(F.array(F.lit("RISK_X"))).alias("risks"),
        every(2).alias("blocked"), every(3).alias("cycle_blocked"), every(5).alias("ambiguous"), (~every(7)).alias("complete"),
    )
    return rows.select("id", lifecycle.plan_verdict().alias("plan"), lifecycle.resolution_verdict().alias("resolution"))


@query("""WITH p AS (SELECT p_partkey AS pin_id, CASE p_partkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'revalidated' WHEN 2 THEN 'invalidated' ELSE 'stale' END AS s, p_partkey % 3 = 0 AS d1, p_partkey % 5 = 0 AS d2 FROM part),
    d AS (SELECT *, CASE WHEN d1 AND d2 THEN 'vocab_release,source_schema_hash' WHEN d1 THEN 'vocab_release' WHEN d2 THEN 'source_schema_hash' ELSE '' END AS drifted FROM p), e AS (SELECT *, CASE WHEN s <> 'invalidated' AND drifted <> '' THEN 'stale' ELSE s END AS state FROM d)
    SELECT pin_id, drifted, state, CASE WHEN state IN ('active', 'revalidated') THEN 'SKIP' WHEN state = 'stale' THEN 'REVALIDATE' ELSE 'DISPATCH' END AS decision FROM e""")
def pin_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-08."""
    i = F.col("p_partkey")
    state = F.when(i % 4 == 0, "active").when(i % 4 == 1, "revalidated").when(i % 4 == 2, "invalidated").otherwise("stale")
    confirmed = F.create_map(F.lit("vocab_release"), F.when(i % 3 == 0, "old").otherwise("v1"), F.lit("source_schema_hash"), F.when(i % 5 == 0, "old").otherwise("h1"))
    pins = table(spark, sf_dir, "part").select(i.alias("pin_id"), state.alias("state"), F.array(F.lit("vocab_release"), F.lit("source_schema_hash")).alias("expires_on"), confirmed.alias("confirmed"))
    found = lifecycle.pin_decisions(pins, {"vocab_release": "v1", "source_schema_hash": "h1"})
    return found.select("pin_id", F.array_join("drifted", ",").alias("drifted"), "state", "decision")


@query("""WITH f AS (SELECT p_partkey AS entity, CASE p_size % 3 WHEN 0 THEN 'terms' WHEN 1 THEN 'structure' ELSE 'obligations' END AS facet, CASE p_partkey % 3 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'EXTERNAL' ELSE 'PARTIAL' END AS annotation, p_partkey % 7 = 0 AS supplied FROM part)
    SELECT entity, facet, CASE WHEN supplied THEN 'supplied_by_adapter' WHEN annotation <> 'PARTIAL' THEN 'not_required' WHEN facet = 'terms' THEN 'required_skipped' ELSE 'required_deferred' END AS status FROM f""")
def facet_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TGT-06."""
    i, s = F.col("p_partkey"), F.col("p_size") % 3
    facets = table(spark, sf_dir, "part").select(
        i.alias("entity"), F.when(s == 0, "terms").when(s == 1, "structure").otherwise("obligations").alias("facet"), F.when(i % 3 == 0, "COMPLETE").when(i % 3 == 1, "EXTERNAL").otherwise("PARTIAL").alias("annotation"), (i % 7 == 0).alias("supplied"),
    )
    return lifecycle.facet_decisions(facets, ["terms"]).select("entity", "facet", "status")


@query("SELECT p_brand AS entity, p_size AS version FROM part GROUP BY p_brand, p_size HAVING max(p_partkey) % 5 = 0")
def card_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TGT-07."""
    cards = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("entity"), F.col("p_size").alias("version")).agg(F.max("p_partkey").alias("k"))
    stored = cards.select("entity", "version", F.sha2(F.concat(F.col("k").cast("string"), F.when(F.col("k") % 5 == 0, "x").otherwise("")), 256).alias("digest"))
    return lifecycle.card_drift(cards.select("entity", "version", F.col("k").cast("string").alias("content")), stored).select("entity", "version")


@query("""WITH o AS (SELECT DISTINCT p_brand AS entity FROM part) SELECT entity, 'required' AS kind, unnest(['id', 'name']) AS field, NULL::VARCHAR AS target FROM o UNION ALL SELECT entity, 'nullable', 'note', NULL FROM o UNION ALL SELECT entity, 'foreign_key', 'id', 'parent' FROM o""")
def obligation_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TGT-09."""
    o = table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity")).distinct()
    return lifecycle.constraints_of(o.select("entity", F.array(F.lit("id"), F.lit("name")).alias("required"), F.array(F.lit("note")).alias("nullable"), F.create_map(F.lit("id"), F.lit("parent")).alias("keys")))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderkey % 10 = 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 1")
def slice_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-08."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return lifecycle.contaminated(o.where("o_orderkey % 10 = 0"), o.where("o_orderkey % 10 = 1"), ["k"])


@query("""SELECT o_orderkey AS "from", o_custkey AS "to", coalesce(CASE WHEN o_orderkey % 4 <> 3 THEN 's' || (o_orderkey % 4) END, CASE WHEN o_orderkey % 8 = 3 THEN 'filled' END) AS source_schema FROM orders""")
def edge_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF-12."""
    i = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    edges = o.select(i.alias("from"), F.col("o_custkey").alias("to"), F.when(i % 4 != 3, F.concat(F.lit("s"), (i % 4).cast("string"))).alias("source_schema"))
    return lifecycle.backfilled(edges, o.where("o_orderkey % 8 = 3").select(i.alias("node"), F.lit("filled").alias("scope")))


@query("""WITH RECURSIVE r AS (SELECT c_custkey AS id, c_nationkey || '/' || c_custkey % 40 AS k1, CASE WHEN c_custkey % 3 = 0 THEN 'p' || c_custkey // 9 END AS k2 FROM customer),
    links AS (SELECT x.id AS a, y.id AS b FROM r x JOIN r y ON x.id <> y.id AND (x.k1 = y.k1 OR x.k2 = y.k2)), reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT a AS id, least(a, min(b)) AS entity FROM reach GROUP BY a""")
def multi_key_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-09: records that share any of two keys, closed over links."""
    i = F.col("c_custkey")
    r = table(spark, sf_dir, "customer").select(i.alias("id"), F.concat_ws("/", F.col("c_nationkey").cast("string"), (i % 40).cast("string")).alias("k1"), F.when(i % 3 == 0, F.concat(F.lit("p"), F.floor(i / 9).cast("string"))).alias("k2"))
    return match.closure(match.shared_key_links(r, "id", ["k1", "k2"]))


@query("""WITH r AS (SELECT p_partkey AS id, p_size AS block, lower(p_name) AS t FROM part), h AS (SELECT block, t, min(id) AS head FROM r GROUP BY block, t)
    SELECT head AS a, id AS b, 1.0::DOUBLE AS score FROM r JOIN h USING (block, t) WHERE id <> head UNION ALL
    SELECT least(x.head, y.head), greatest(x.head, y.head), round(1 - levenshtein(x.t, y.t)::DOUBLE / greatest(length(x.t), length(y.t)), 6) FROM h x JOIN h y ON x.block = y.block AND x.t < y.t WHERE 1 - levenshtein(x.t, y.t)::DOUBLE / greatest(length(x.t), length(y.t)) >= 0.8""")
def fuzzy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-09, FN-22."""
    return match.by_score(table(spark, sf_dir, "part"), "p_partkey", F.col("p_size"), "p_name", 0.8).withColumn("score", F.round("score", 6))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN sha256(c_nationkey || chr(31) || trim(c_mktsegment)) END AS entity FROM customer")
def hashed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP-09."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).otherwise(" ").alias("segment"))
    return match.by_hash(c, ["c_nationkey", "segment"]).select("c_custkey", "entity")
