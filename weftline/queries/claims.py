"""Claims, their status log and winners: events stand for claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import keys, refs
from weftline.operators import assertions, ranked
from weftline.plans import build
from weftline.queries.base import query, table
from weftline.queries.catalog import CATALOG_SQL, catalog

SOURCES = {0: "human", 1: "dbt", 2: "llm_interpretation", 3: "heuristic"}
STATUSES = {0: "pinned", 1: "accepted", 2: "rejected", 3: "superseded"}


def _case(c: Column, names: dict[int, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in names.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _case_sql(c: str, names: dict[int, str], other: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + f" ELSE '{other}' END"


CLAIMS = f"""claims AS (SELECT event_id AS id, user_id AS subject, event_type AS predicate, {_case_sql('event_id % 5', SOURCES, 'other')} AS source, (event_id % 10)::DOUBLE / 10::DOUBLE AS confidence,
    {_case_sql('event_id % 17', STATUSES, 'auto')} AS status, ts AS observed_at FROM events)"""
_RANK = "CASE status WHEN 'pinned' THEN 0 WHEN 'accepted' THEN 1 ELSE 2 END"
_PRECEDENCE = "CASE source WHEN 'human' THEN 100 WHEN 'dbt' THEN 60 WHEN 'llm_interpretation' THEN 20 WHEN 'heuristic' THEN 15 ELSE 0 END"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        i.alias("id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), _case(i % 5, SOURCES, "other").alias("source"),
        ((i % 10).cast("double") / 10.0).alias("confidence"), _case(i % 17, STATUSES, "auto").alias("status"), F.col("ts").alias("observed_at"),
    )


@query(f"""WITH {CLAIMS} SELECT subject, predicate, id, source, confidence, status FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY {_RANK}, CASE WHEN {_RANK} = 2 THEN -{_PRECEDENCE} ELSE 0 END,
    CASE WHEN {_RANK} = 2 THEN -confidence ELSE 0 END, id) AS n FROM claims WHERE status NOT IN ('rejected', 'superseded')) WHERE n = 1""")
def winner_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18, FLT-07, WIN-02."""
    return assertions.winner_by_standing(claims(spark, sf_dir), ["subject", "predicate"], "id").drop("observed_at")


@query(f"""WITH {CLAIMS} SELECT subject, predicate, id, status FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY {_RANK}, CASE WHEN {_RANK} = 2 THEN 0 ELSE -epoch_us(observed_at) END,
    CASE WHEN {_RANK} = 2 THEN -({_PRECEDENCE} / 100::DOUBLE * 0.4::DOUBLE + confidence * 0.6::DOUBLE) ELSE 0 END, id) AS n FROM claims WHERE status NOT IN ('rejected', 'superseded')) WHERE n = 1""")
def winner_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-19."""
    return assertions.winner_by_score(claims(spark, sf_dir), ["subject", "predicate"], "observed_at", "id").select("subject", "predicate", "id", "status")


_MAPPING_STATUS = {0: "human_pinned", 1: "auto_accepted", 2: "review_pending", 3: "rejected"}


@query(f"""WITH {CLAIMS}, m AS (SELECT id, subject, confidence, observed_at, id % 4 AS version, {_case_sql('id % 19', _MAPPING_STATUS, 'candidate')} AS s FROM claims), live AS (SELECT * FROM m WHERE s <> 'rejected')
    SELECT subject, id, s AS status, n_live FROM (SELECT *, count(*) OVER (PARTITION BY subject) AS n_live, row_number() OVER (PARTITION BY subject ORDER BY CASE s WHEN 'human_pinned' THEN 4 WHEN 'auto_accepted' THEN 3 WHEN 'review_pending' THEN 2 ELSE 1 END DESC,
    confidence DESC, observed_at DESC, version DESC, id) AS n FROM live) WHERE n = 1""")
def winner_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21, AGG-22."""
    rows = claims(spark, sf_dir).withColumn("status", _case(F.col("id") % 19, _MAPPING_STATUS, "candidate")).withColumn("version", F.col("id") % 4)
    return assertions.winner_of_mappings(rows, ["subject"], "observed_at", "version", "id").select("subject", "id", "status", "n_live")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5, WIN-04."""
    return assertions.latest(table(spark, sf_dir, "events").drop("props"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query(f"""WITH {CLAIMS}, log AS (SELECT id // 3 AS id, {_case_sql('id % 7', {0: 'accepted', 1: 'rejected', 2: 'pinned'}, 'auto')} AS status, id AS seq FROM claims), last AS (SELECT id, arg_max(status, seq) AS s FROM log GROUP BY id)
    SELECT coalesce(s, status) AS status, count(*) AS n FROM claims c LEFT JOIN last l ON l.id = c.id GROUP BY 1""")
def effective_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5: the log's last event goes before the stored status."""
    c = claims(spark, sf_dir)
    log = c.select(F.floor(F.col("id") / 3).alias("id"), _case(F.col("id") % 7, {0: "accepted", 1: "rejected", 2: "pinned"}, "auto").alias("status"), F.col("id").alias("seq"))
    return assertions.effective_status(c, log).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {CLAIMS}, r AS (SELECT subject, confidence, id, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS is_new, CASE WHEN id % 4 = 0 THEN NULL ELSE confidence END AS c FROM claims)
    SELECT subject, c AS confidence, id FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY coalesce(c, -1) DESC, is_new, c NULLS FIRST, id) AS n FROM r) WHERE n = 1""")
def confidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-20, SNK-18: missing confidences, equal ones keep what is stored."""
    rows = claims(spark, sf_dir).select("subject", F.when(F.col("id") % 4 != 0, F.col("confidence")).alias("confidence"), "id")
    return ranked.merge_confident(rows.where("id % 3 = 0"), rows.where("id % 3 > 0"), ["subject"])


@query(f"""WITH {CLAIMS}, p AS (SELECT *, CASE WHEN id % 6 = 0 THEN 'structural' WHEN id % 6 = 1 THEN 'semantic' END AS policy, CASE WHEN id % 4 = 0 THEN 'structural' ELSE source END AS src, CASE WHEN id % 29 = 0 THEN 'DEPRECATED' END AS lifecycle FROM claims)
    SELECT id, status, confidence FROM p WHERE coalesce(lifecycle, 'ACTIVE') <> 'DEPRECATED' AND status NOT IN ('rejected', 'superseded')
    AND (status IN ('pinned', 'accepted') OR confidence >= CASE WHEN coalesce(policy, CASE WHEN src = 'structural' THEN 'structural' END) = 'structural' THEN 0.5 ELSE 0.7 END)""")
def visibility_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-05, FLT-06."""
    i = F.col("id")
    rows = claims(spark, sf_dir).withColumns({
        "confidence_policy": F.when(i % 6 == 0, "structural").when(i % 6 == 1, "semantic"), "source": F.when(i % 4 == 0, "structural").otherwise(F.col("source")), "lifecycle": F.when(i % 29 == 0, "DEPRECATED"),
    })
    return assertions.visible(rows).select("id", "status", "confidence")


@query(f"""WITH {CATALOG_SQL}, c AS (SELECT 'databricks://w/cat/sf/' || "table" || '/' || "column" AS subject, type, CASE WHEN position = 0 THEN 'first of ' || "table" WHEN position = 1 THEN ' ' END AS comment FROM catalog)
    SELECT subject, 'column_exists' AS predicate, '{{"value":"true"}}' AS payload, sha256(subject || '|column_exists||') AS family FROM c
    UNION ALL SELECT subject, 'has_datatype', '{{"value":"' || type || '"}}', sha256(subject || '|has_datatype|' || type || '|') FROM c
    UNION ALL SELECT subject, 'has_comment', '{{"value":"' || comment || '"}}', sha256(subject || '|has_comment|' || comment || '|') FROM c WHERE trim(coalesce(comment, '')) <> ''""")
def normalise_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-08, D2, D6, FN-03."""
    comment = F.when(F.col("position") == 0, F.concat(F.lit("first of "), "table")).when(F.col("position") == 1, " ")
    return build.claims_of_catalog(catalog(spark, sf_dir).withColumn("comment", comment), "r1", "w", "cat").select("subject", "predicate", "payload", "family")


#: Forms of references, over the schema s, table t and column c that a part makes, with what they are parsed to and translated to.
_FORMS = [
    ("databricks://ws/cat/{s}/{t}", ("ws", "cat", "{s}", "{t}", None), None), ("databricks://ws/cat/{s}/{t}/{c}", ("ws", "cat", "{s}", "{t}", "{c}"), None), ("databricks://ws/cat/{s}/{t}.{c}", ("ws", "cat", "{s}", "{t}", "{c}"), None),
    ("postgres://host/db/{s}/{t}/{c}", ("host/db", "db", "{s}", "{t}", "{c}"), None), ("postgres://host/db/{s}/{t}", ("host/db", "db", "{s}", "{t}", None), None),
    ("mysql://host/db/{t}", ("host/db", "db", None, "{t}", None), None), ("mysql://host/db/{t}/{c}", ("host/db", "db", None, "{t}", "{c}"), None),
    ("unity://cat.{s}.{t}", ("unity", "cat", "{s}", "{t}", None), "databricks://w/cat/{s}/{t}"), ("unity://cat.{s}.{t}.{c}", ("unity", "cat", "{s}", "{t}", "{c}"), "databricks://w/cat/{s}/{t}/{c}"), ("nothing {t}", (None,) * 5, None), ("", (None,) * 5, None),
]


def _made(form: str | None) -> str:
    """SQL of both engines: a form with its names put in."""
    if form is None:
        return "NULL"
    out = "'" + form + "'"
    for k in "stc":
        out = f"replace({out}, '{{{k}}}', {k})"
    return out


def _of_form(values: list[str | None]) -> str:
    return "CASE i % 11 " + " ".join(f"WHEN {n} THEN {_made(v)}" for n, v in enumerate(values)) + " END"


_NAMED = "SELECT p_partkey AS i, 's' || p_size AS s, lower(p_type) AS t, 'c' || (p_partkey % 7) AS c FROM part"


@query(f"""WITH named AS ({_NAMED}) SELECT i, {_of_form([f for f, _, _ in _FORMS])} AS ref, """ + ", ".join(f"{_of_form([p[n] for _, p, _ in _FORMS])} AS \"{name}\"" for n, name in enumerate(["source", "catalog", "schema", "table", "column"])) + f""", {_of_form([t or f for f, _, t in _FORMS])} AS translated FROM named""")
def parse_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D7, FN-25: references of all parts, in all forms."""
    named = table(spark, sf_dir, "part").selectExpr("p_partkey AS i", "'s' || p_size AS s", "lower(p_type) AS t", "'c' || (p_partkey % 7) AS c")
    rows = named.select("i", F.expr(_of_form([f for f, _, _ in _FORMS])).alias("ref"))
    return rows.select("i", "ref", refs.parse_ref(F.col("ref")).alias("p"), refs.translate_ref(F.col("ref"), "w").alias("translated")).select("i", "ref", "p.*", "translated")


@query("""SELECT doc_id, lower(regexp_replace(regexp_replace(source || '  ' || chr(9) || lang || ' ', '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')) AS name FROM documents""")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-07."""
    return table(spark, sf_dir, "documents").select("doc_id", F.lower(keys.normal_name(F.concat("source", F.lit("  \t"), "lang", F.lit(" ")))).alias("name"))


@query("""WITH s AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' / a Very-Long & name of more than sixty three letters' ELSE '' END AS raw FROM part),
    n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS plain FROM s)
    SELECT p_partkey, CASE WHEN plain = '' THEN NULL WHEN length('st_' || plain) <= 63 THEN 'st_' || plain ELSE 'st_' || regexp_replace(substr(plain, 1, 49), '_+$', '') || '_' || substr(sha256(raw), 1, 10) END AS name FROM n""")
def schema_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-08."""
    raw = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, " / a Very-Long & name of more than sixty three letters").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", keys.safe_schema_name("st", raw).alias("name"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN lower(p_type) || ' (STRING)' WHEN 1 THEN 'n' || p_size || ' [INT]' WHEN 2 THEN ' t' || p_size || '_id: VARCHAR ' WHEN 3 THEN '' WHEN 4 THEN 'id' ELSE 'a ' || p_name END AS raw,
    CASE p_partkey % 6 WHEN 0 THEN lower(p_type) WHEN 1 THEN 'n' || p_size WHEN 2 THEN 't' || p_size || '_id' WHEN 4 THEN 'id' ELSE '' END AS name, p_partkey % 6 IN (2, 4) AS is_key FROM part""")
def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-09, FN-12: headers made of all parts."""
    i, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    raw = F.when(i == 0, F.concat(F.lower("p_type"), F.lit(" (STRING)"))).when(i == 1, F.concat(F.lit("n"), size, F.lit(" [INT]"))).when(i == 2, F.concat(F.lit(" t"), size, F.lit("_id: VARCHAR "))).when(i == 3, "").when(i == 4, "id").otherwise(F.concat(F.lit("a "), "p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    return rows.withColumn("name", keys.bare_column_name(F.col("raw"))).withColumn("is_key", keys.is_key_name(F.col("name")))


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-31."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query(f"""WITH {CLAIMS}, c AS (SELECT *, sha256(subject || '|' || predicate || '||') AS family FROM claims), given AS (SELECT family, CASE WHEN min(id) % 2 = 0 THEN 'rejected' ELSE 'accepted' END AS g FROM c GROUP BY family HAVING min(id) % 3 = 0)
    SELECT coalesce(g, status) AS status, count(*) AS n FROM c LEFT JOIN given USING (family) GROUP BY 1""")
def correction_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-23, SNK-22."""
    c = claims(spark, sf_dir).withColumn("family", keys.family_key(F.col("subject").cast("string"), F.col("predicate"), F.lit(None), F.lit(None)))
    low = c.groupBy("family").agg(F.min("id").alias("m")).where("m % 3 = 0")
    return assertions.replay_corrections(c, low.select("family", F.when(F.col("m") % 2 == 0, "rejected").otherwise("accepted").alias("status"))).groupBy("status").agg(F.count("*").alias("n"))
