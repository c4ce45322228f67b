"""Claims about tables and columns, the log of their status, and which claim of a family wins.

A claim has: id, subject, predicate, payload (JSON), object, source, confidence, status, run_id, observed_at, schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import keys
from weftline.functions.values import precedence
from weftline.operators.ranked import pick

#: How the status of a claim is spelled; the last two take it out of play.
STATUSES = ["auto", "accepted", "rejected", "pinned", "superseded"]
OUT = ["rejected", "superseded"]
#: Predicates whose payload has the claim's identity, by the field that holds it. Others have none.
IDENTITY_FIELD = {
    "value": [
        "vocabulary_match", "has_entity_name", "has_property_name", "has_semantic_type", "has_alias", "has_synonym",
        "has_datatype", "has_label", "has_description", "has_comment", "has_tag", "maps_to",
    ],
    "code": ["has_decoded_value"],
}
#: The standing of a mapping's status.
MAPPING_TIER = {"human_pinned": 4, "auto_accepted": 3, "review_pending": 2, "candidate": 1, "rejected": 0}


def from_columns(columns: DataFrame) -> DataFrame:
    """Claims of columns (ref, type, comment): existence, data type and comment, each one where it has a value (PRJ-08)."""
    one = lambda p, v: F.struct(F.lit(p).alias("predicate"), v.cast("string").alias("value"))
    claims = F.array(one("column_exists", F.lit("true")), one("has_datatype", F.col("type")), one("has_comment", F.when(~keys.is_blank(F.col("comment")), F.col("comment"))))
    rows = columns.select(F.col("ref").alias("subject"), F.explode(F.filter(claims, lambda c: c["value"].isNotNull())).alias("c"))
    return rows.select("subject", "c.predicate", F.to_json(F.struct(F.col("c.value").alias("value"))).alias("payload"))


def identity_of(predicate: Column, payload: Column) -> Column:
    """The payload's part of the family key; null where claims of a predicate all compete."""
    out = F.lit(None).cast("string")
    for name, predicates in IDENTITY_FIELD.items():
        out = F.when(predicate.isin(predicates), F.get_json_object(payload, f"$.{name}")).otherwise(out)
    return out


def with_family(claims: DataFrame) -> DataFrame:
    """``claims`` with ``family``, the key of competing ones (D6)."""
    return claims.withColumn("family", keys.family_key(F.col("subject"), F.col("predicate"), identity_of(F.col("predicate"), F.col("payload")), F.col("object")))


def latest(events: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last event of each key (D5, WIN-04); ``order``: total, ascending, of numeric or timestamp columns."""
    packed = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*events.columns).alias("_row"))
    return events.groupBy(*key).agg(F.max(packed).alias("_last")).select("_last._row.*")


def effective_status(claims: DataFrame, events: DataFrame) -> DataFrame:
    """``claims`` with the status of their last event (id, status, seq), if they have one; ``auto`` if neither says (D5)."""
    last = latest(events, ["id"], [F.col("seq")]).select("id", F.col("status").alias("_status"))
    return claims.join(last, "id", "left").withColumn("status", F.coalesce("_status", "status", F.lit("auto"))).drop("_status")


def _rank(status: Column) -> Column:
    return F.when(status == "pinned", 0).when(status == "accepted", 1).otherwise(2)


def winner_by_standing(claims: DataFrame, key: list[str], order: str) -> DataFrame:
    """AGG-18: the first pinned one, else the first accepted one, else the best source, then the most confident, then the first."""
    live = claims.where(~F.col("status").isin(OUT))
    rank = _rank(F.col("status"))
    scored = F.when(rank == 2, -precedence(F.col("source"))).otherwise(0), F.when(rank == 2, -F.col("confidence")).otherwise(0.0)
    return pick(live, key, [rank, *scored, F.col(order)])


def winner_by_score(claims: DataFrame, key: list[str], observed: str, order: str) -> DataFrame:
    """AGG-19: the latest pinned one, else the latest accepted one, else the best of 0.4 of the source's standing and 0.6 of confidence, then the first."""
    live = claims.where(~F.col("status").isin(OUT)).withColumn("_at", F.unix_micros(F.col(observed).cast("timestamp")))
    rank = _rank(F.col("status"))
    score = precedence(F.col("source")) / 100.0 * 0.4 + F.col("confidence") * 0.6
    chosen = pick(live, key, [rank, F.when(rank == 2, F.lit(0).cast("long")).otherwise(-F.col("_at")), F.when(rank == 2, -score).otherwise(0.0), F.col(order)])
    return chosen.drop("_at")


def winner_of_mappings(mappings: DataFrame, key: list[str], at: str, version: str, order: str) -> DataFrame:
    """AGG-21, AGG-22: by status, confidence, time and template version, all descending; rejected ones never. Also how many were live."""
    tier = F.lit(0)
    for name, n in MAPPING_TIER.items():
        tier = F.when(F.col("status") == name, n).otherwise(tier)
    live = mappings.where(F.col("status") != "rejected")
    best = pick(live, key, [-tier, -F.col("confidence"), -F.unix_micros(F.col(at).cast("timestamp")), -F.col(version), F.col(order)])
    many = live.groupBy(*key).agg(F.count("*").alias("n_live"))
    return best.join(many, key)


def visible(claims: DataFrame) -> DataFrame:
    """FLT-05, FLT-06: accepted and pinned ones, and automatic ones that are sure enough; nothing rejected, superseded or deprecated.

    A policy column, where it has a value, goes before the source. Null statuses are automatic.
    """
    status = F.coalesce(F.col("status"), F.lit("auto"))
    structural = F.when(F.col("confidence_policy").isNotNull(), F.col("confidence_policy") == "structural").otherwise(F.coalesce(F.col("source") == "structural", F.lit(False)))
    sure = F.coalesce(F.col("confidence"), F.lit(0.0)) >= F.when(structural, 0.5).otherwise(0.7)
    active = F.coalesce(F.col("lifecycle"), F.lit("ACTIVE")) != "DEPRECATED"
    return claims.where(active & ~status.isin(OUT) & (status.isin("pinned", "accepted") | sure))


def replay_corrections(claims: DataFrame, corrections: DataFrame) -> DataFrame:
    """New claims take the status that a person gave to their family before (JOIN-23). corrections: family, status."""
    return claims.join(corrections.select("family", F.col("status").alias("_given")), "family", "left").withColumn("status", F.coalesce("_given", "status")).drop("_given")
