"""Status, pins and verdicts of mappings, and the generations of a target model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranked import number

#: Which status may follow which.
TRANSITIONS = {
    "candidate": ["auto_accepted", "review_pending", "rejected", "human_pinned"],
    "auto_accepted": ["review_pending", "human_pinned", "rejected"],
    "review_pending": ["human_pinned", "rejected", "auto_accepted"],
    "human_pinned": ["rejected"],
    "rejected": [],
}
#: What a pin depends on unless it says otherwise; risks that stop a plan.
PIN_DIMENSIONS = ["target_model_version", "target_schema_snapshot_hash", "source_schema_hash", "source_profile_hash", "context_card_version", "vocab_release"]
BLOCKING_RISKS = ["RISK_PIVOT_CARDINALITY_UNVERIFIED", "RISK_VOCAB_DOMAIN_MISMATCH"]


def may_follow(current: Column, target: Column) -> Column:
    """MAP-07."""
    out = F.lit(False)
    for a, following in TRANSITIONS.items():
        out = out | ((current == a) & target.isin(following))
    return F.coalesce(out, F.lit(False))


def plan_verdict() -> Column:
    """MAP-06, over: review_pending, resolution_missing, required_missing, row_violated, fk_unsatisfied (booleans), risks (array). The first that holds counts."""
    return (
        F.when(F.col("review_pending"), "awaiting_review").when(F.col("resolution_missing"), "blocked_by_resolution").when(F.col("required_missing") | F.col("row_violated"), "blocked_by_obligation")
        .when(F.col("fk_unsatisfied"), "blocked_by_fk").when(F.arrays_overlap("risks", F.array(*map(F.lit, BLOCKING_RISKS))), "blocked_by_constraint").otherwise("compilable")
    )


def resolution_verdict() -> Column:
    """MAP-10, over: review_pending, blocked, cycle_blocked, ambiguous, complete (booleans)."""
    return (
        F.when(F.col("review_pending"), "awaiting_review").when(F.col("blocked") & F.col("cycle_blocked"), "unresolved").when(F.col("ambiguous"), "ambiguous")
        .when(~F.col("complete"), "unresolved").when(F.col("blocked"), "awaiting_review").otherwise("resolved")
    )


def pin_decisions(pins: DataFrame, now: dict[str, str]) -> DataFrame:
    """``pins`` (pin_id, state, expires_on array, confirmed map) with drifted, state and decision (MAP-08).

    A pin is stale if anything it depends on is no longer what it was; invalidated pins stay so.
    """
    current = F.create_map(*(F.lit(x) for kv in now.items() for x in kv))
    drifted = F.filter("expires_on", lambda d: ~F.element_at("confirmed", d).eqNullSafe(F.element_at(current, d)))
    state = F.when((F.col("state") != "invalidated") & (F.size("drifted") > 0), "stale").otherwise(F.col("state"))
    decision = F.when(F.col("state").isin("active", "revalidated"), "SKIP").when(F.col("state") == "stale", "REVALIDATE").otherwise("DISPATCH")
    return pins.withColumn("drifted", drifted).withColumn("state", state).withColumn("decision", decision)


def facet_decisions(facets: DataFrame, skipped: list[str]) -> DataFrame:
    """``facets`` (entity, facet, annotation, supplied) with status (TGT-06)."""
    status = F.when(F.col("supplied"), "supplied_by_adapter").when(F.col("annotation").isin("COMPLETE", "EXTERNAL"), "not_required").when(F.col("facet").isin(skipped), "required_skipped").otherwise("required_deferred")
    return facets.withColumn("status", status)


def card_drift(cards: DataFrame, stored: DataFrame) -> DataFrame:
    """Cards (entity, version, content) whose content changed under one version (TGT-07). stored: entity, version, digest."""
    digest = F.sha2(F.coalesce("content", F.lit("")), 256)
    return cards.select("entity", "version", digest.alias("digest")).join(stored.select("entity", "version", F.col("digest").alias("before")), ["entity", "version"]).where("digest <> before")


def card_version(cards: DataFrame, key: list[str]) -> DataFrame:
    """(key, version): of one card its own, of several a digest of all, in any order (TGT-07)."""
    all_ = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "entity", "version"))), ","), 256)
    return cards.groupBy(*key).agg(F.when(F.count("*") == 1, F.max("version")).otherwise(all_).alias("version"))


def snapshot_digest(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, digest): of all rows in any order, from their columns in the order of names (AGG-38).

    Rows are hashed first, so a group gathers 64 characters a row; hashes of a large group are joined by ranges of their first byte.
    """
    own = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(columns)))), 256).alias("h")
    part = rows.select(*key, own).groupBy(*key, F.substring("h", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"))
    return part.groupBy(*key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("p", "d"))), ""), 256).alias("digest"))


def constraints_of(obligations: DataFrame) -> DataFrame:
    """(entity, kind, field, target): one row for each thing that an obligation asks for (TGT-09). obligations: entity, required, nullable (arrays), keys (map of field to parent)."""
    required = obligations.select("entity", F.lit("required").alias("kind"), F.explode("required").alias("field"), F.lit(None).cast("string").alias("target"))
    nullable = obligations.select("entity", F.lit("nullable").alias("kind"), F.explode("nullable").alias("field"), F.lit(None).cast("string").alias("target"))
    foreign = obligations.select("entity", F.explode("keys").alias("field", "target")).select("entity", F.lit("foreign_key").alias("kind"), "field", "target")
    return required.unionByName(nullable).unionByName(foreign)


def missing_fields(obligations: DataFrame, mapped: DataFrame) -> DataFrame:
    """(entity, field) that are required and not mapped (SET-07)."""
    return obligations.select("entity", F.explode("required").alias("field")).join(mapped, ["entity", "field"], "left_anti")


def contaminated(holdout: DataFrame, dev: DataFrame, key: list[str]) -> DataFrame:
    """Keys in both slices; there should be none (SET-08)."""
    return holdout.select(*key).intersect(dev.select(*key))


def scope_of_table(claims: DataFrame) -> DataFrame:
    """(table, source_schema, n): the one study of each table's claims; n is 0 or over 1 where that fails (GRF-02)."""
    return claims.groupBy("table").agg(F.min("source_schema").alias("source_schema"), F.countDistinct("source_schema").alias("n"))


def backfilled(edges: DataFrame, scope_of: DataFrame, end: str = "from") -> DataFrame:
    """Edges with the scope of the node they begin in where they have none (GRF-12). scope_of: node, scope."""
    met = edges.join(scope_of.select(F.col("node").alias(end), "scope"), end, "left")
    return met.withColumn("source_schema", F.coalesce("source_schema", "scope")).select(*edges.columns)


def flipped(edges: DataFrame) -> DataFrame:
    """Edges the other way round (GRF-12)."""
    return edges.withColumns({"from": F.col("to"), "to": F.col("from")})


#: The parts of a target model, in the order in which they are written.
MODEL_PARTS = ["entity", "obligation", "binding", "term", "card"]


def model_order(parts: DataFrame) -> DataFrame:
    """SRT-08: ``parts`` (kind, name) with ``section``, the kind's place, and ``place``, the name's in it: one order for any run. Unknown kinds are left out."""
    section = F.array_position(F.array(*map(F.lit, MODEL_PARTS)), F.col("kind")).cast("int")
    known = parts.select("kind", "name").distinct().withColumn("section", section).where("section > 0")
    return number(known, ["kind"], [F.asc("name")], "place")
