"""Row filters, lookups by their whole key, and rules on what evidence may show."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranked import pick

#: How evidence of a class of data is shown unless someone says otherwise.
EVIDENCE_MODE = {"PUBLIC": "RAW", "PII": "HASH", "PHI": "CATEGORICAL", "FINANCIAL_RESTRICTED": "HASH", "CONFIDENTIAL": "CATEGORICAL"}


def in_slice(rows: DataFrame, allowed: list[str], column: str = "table") -> DataFrame:
    """FLT-01: rows of the tables in a slice."""
    return rows.where(F.col(column).isin(allowed))


def row_predicate(op: str, clauses: list[tuple[str, Any]]) -> Column:
    """FLT-12: AND or OR of clauses (field, value); with the value ``...`` a field only has to be there. Never null."""
    if op not in ("AND", "OR") or not clauses:
        raise ValueError("a row predicate is an AND or OR of one clause at least")
    each = [F.col(f).isNotNull() if v is ... else F.coalesce(F.col(f) == F.lit(v), F.lit(False)) for f, v in clauses]
    return reduce((lambda a, b: a & b) if op == "AND" else (lambda a, b: a | b), each)


def optional(rows: DataFrame, wanted: dict[str, Any]) -> DataFrame:
    """FLT-10: the rows with these values; a parameter that is None is not set and filters nothing, so its column is not even read for it."""
    return at_grain(rows, set_) if (set_ := {c: v for c, v in wanted.items() if v is not None}) else rows


def at_grain(rows: DataFrame, key: dict[str, Any]) -> DataFrame:
    """FLT-15, FLT-19: the rows with all of these values; null is a value."""
    return rows.where(reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in key.items())))


def evidence_mode(sensitivity: Column) -> Column:
    """FLT-20: null for an unknown class."""
    out = F.lit(None).cast("string")
    for name, mode in EVIDENCE_MODE.items():
        out = F.when(sensitivity == name, mode).otherwise(out)
    return out


def evidence_faults(evidence: DataFrame) -> DataFrame:
    """FLT-20: ``evidence`` (sensitivity, mode, fields, overridden) with ``fault``: what is against the rules, null if nothing is.

    Counts show counts only, digests need one, and raw health data needs someone's word.
    """
    counts_only = F.size(F.array_except("fields", F.array(F.lit("count"), F.lit("distinct")))) > 0
    digest = F.arrays_overlap("fields", F.array(F.lit("hash"), F.lit("digest")))
    fault = F.when((F.col("mode") == "COUNT_ONLY") & counts_only, "literal values").when((F.col("mode") == "HASH") & ~digest, "no digest")
    fault = fault.when((F.col("mode") == "RAW") & (F.col("sensitivity") == "PHI") & ~F.coalesce("overridden", F.lit(False)), "raw health data")
    return evidence.withColumn("fault", fault)


def first_seen(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """AGG-26: the first row of each key."""
    return pick(rows, key, [F.col(order)])


def union_by_key(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """SET-04: rows of both, one for each key; those of ``first`` go before, then the least row."""
    both = first.withColumn("_side", F.lit(0)).unionByName(second.withColumn("_side", F.lit(1)))
    return pick(both, key, [F.col("_side"), *(F.col(c) for c in first.columns)]).drop("_side")


def distinct_sample(table: DataFrame, column: str, most: int = 500) -> DataFrame:
    """SRT-05: up to ``most`` distinct values that are not null, the smallest ones."""
    return table.select(F.col(column)).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most)
