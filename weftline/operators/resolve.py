"""Source codes to concepts of a target vocabulary, and the staged rows that follow.

concepts: concept_id (string), vocabulary, code, domain, standard, invalid_reason.
relations: from_id, relation, to_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranked import pick


@dataclass(frozen=True)
class Policy:
    vocabulary: str
    relation: str = "Maps to"
    domain: str | None = None
    standard: str = "S"


def targets(codes: DataFrame, concepts: DataFrame, relations: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """(candidates: code, concept_id), (standardised: code, concept_id, domain) for the column ``code`` (MAP-01, JOIN-04 to JOIN-06).

    A candidate that is standard and valid stands for itself too.
    """
    own = concepts.where(F.col("vocabulary") == policy.vocabulary)
    found = codes.select("code").distinct().join(own, "code")
    good = (F.col("standard") == policy.standard) & F.col("invalid_reason").isNull()
    linked = relations.where(F.col("relation") == policy.relation).select(F.col("from_id").alias("concept_id"), "to_id")
    across = found.select("code", "concept_id").join(linked, "concept_id").select("code", F.col("to_id").alias("concept_id"))
    across = across.join(concepts.where(good).select("concept_id", "domain"), "concept_id")
    self = found.where(good).select("code", "concept_id", "domain")
    return found.select("code", "concept_id"), self.unionByName(across.select("code", "concept_id", "domain")).distinct()


def resolve(codes: DataFrame, concepts: DataFrame, relations: DataFrame, policy: Policy) -> DataFrame:
    """(code, target_id, resolution, status, confidence, reason) for each distinct code (MAP-02, AGG-11, AGG-12, FLT-03).

    One survivor is accepted. Of several, the smallest id is taken for review. None: NO_MAP, and why.
    """
    candidates, standard = targets(codes, concepts, relations, policy)
    alive = standard if policy.domain is None else standard.where(F.col("domain") == policy.domain)
    count = lambda t, n: t.groupBy("code").agg(F.count("*").alias(n))
    chosen = alive.groupBy("code").agg(F.count("*").alias("n"), F.min(F.col("concept_id").cast("bigint")).alias("target_id"))
    rows = codes.select("code").where("code is not null").distinct().join(chosen, "code", "left").join(count(candidates, "c"), "code", "left").join(count(standard, "s"), "code", "left")
    reason = (
        F.when(F.col("n") > 0, None)
        .when(F.col("c").isNull(), f"'{policy.vocabulary}' has no such code")
        .when(F.col("s").isNull(), f"the code has no valid standard target by '{policy.relation}'")
        .otherwise(f"all standard targets are outside the domain '{policy.domain}'")
    )
    return rows.select(
        "code",
        "target_id",
        F.when(F.col("n") > 0, "RESOLVED").otherwise("NO_MAP").alias("resolution"),
        F.when(F.col("n") > 1, "review_pending").otherwise("auto_accepted").alias("status"),
        F.when(F.col("n") > 1, 0.5).otherwise(1.0).alias("confidence"),
        reason.alias("reason"),
    )


def fold(decisions: DataFrame, key: list[str]) -> DataFrame:
    """One row for each column of codes: the least confidence of its resolved codes, and whether any waits for review (AGG-10, MAP-05)."""
    return decisions.where("resolution = 'RESOLVED'").groupBy(*key).agg(F.min("confidence").alias("confidence"), F.max((F.col("status") == "review_pending").cast("int")).cast("boolean").alias("review"))


def broken(decisions: DataFrame) -> DataFrame:
    """Decisions where resolution, target and reason do not fit (MAP-04)."""
    none = F.col("resolution") == "NO_MAP"
    return decisions.where((none != F.col("target_id").isNull()) | (none != F.col("reason").isNotNull()))


def stage(source: DataFrame, code: str, row_ref: str, decisions: DataFrame, schema: str, table: str) -> DataFrame:
    """Every row of ``source`` with the decision on its code (JOIN-01, PRJ-05).

    The decisions are one row for each distinct code; Spark sends them to all tasks when they are small, and joins by
    sorted parts when not.
    """
    dec = decisions.select(F.col("code").alias("_code"), "target_id", "resolution", "status", "confidence")
    return source.join(dec, source[code] == dec["_code"], "left").select(
        F.lit(schema).alias("source_schema"), F.lit(table).alias("source_table"), F.col(row_ref).cast("string").alias("source_row_ref"), F.col(code).alias("source_value"),
        F.col("target_id"), F.coalesce("resolution", F.lit("NO_MAP")).alias("resolution"), "status", "confidence",
    )


def conformance(decisions: DataFrame, concepts: DataFrame, policy: Policy) -> DataFrame:
    """(code, target_id, violation) for resolved decisions whose concept breaks the contract; the first reason counts (FLT-18, FLT-11)."""
    found = concepts.select(F.col("concept_id").alias("_id"), "standard", "invalid_reason", "domain")
    rows = decisions.where("resolution = 'RESOLVED'").join(found, F.col("target_id").cast("string") == F.col("_id"), "left")
    why = F.when(F.col("_id").isNull(), "absent").when(~F.col("standard").eqNullSafe(F.lit(policy.standard)), "not standard").when(F.col("invalid_reason").isNotNull(), "invalid")
    if policy.domain is not None:
        why = why.when(~F.col("domain").eqNullSafe(F.lit(policy.domain)), "wrong domain")
    return rows.select("code", "target_id", why.alias("violation")).where("violation is not null")


def last_decision(decisions: DataFrame, key: list[str], order: str) -> DataFrame:
    """AGG-25: of repeated decisions the last one counts."""
    return pick(decisions, key, [-F.col(order)])
