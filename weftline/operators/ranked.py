"""The three operators most others are made of: pick the best row of a key, insert or replace by key, replace a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first by ``order`` (AGG-18 to AGG-25, WIN-02, WIN-03).

    A grouped minimum over structs, so sums are partial and a hot key is no hot task. ``order`` should be total; columns of
    orderable types only. Null keys are a key. Descending order: see ``down``.
    """
    packed = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(order)), F.struct(*(F.col(c) for c in rows.columns)).alias("_row"))
    return rows.groupBy(*key).agg(F.min(packed).alias("_best")).select("_best._row.*")


def down(c: Column, kind: str = "double") -> Column:
    """For ``pick``: larger values first, nulls last."""
    return F.coalesce(-c.cast(kind), F.lit(float("inf")).cast(kind)) if kind == "double" else -F.coalesce(c, F.lit(0)).cast(kind)


def number(rows: DataFrame, key: list[str], order: list[Column], name: str = "n", most: int | None = None) -> DataFrame:
    """Rows with their place in their key; the first ``most`` of each if given (SRT-01, SRT-04, SRT-06)."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return out if most is None else out.where(F.col(name) <= most)


def same_key(a: DataFrame, b: DataFrame, key: list[str]) -> list[Column]:
    return [a[c].eqNullSafe(b[c]) for c in key]


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``stored`` with the keys of ``new`` replaced; of several new rows of a key the first by ``order`` counts (SNK-14, SNK-18)."""
    best = pick(new, key, order)
    return stored.join(best, same_key(stored, best, key), "left_anti").unionByName(best)


def insert_missing(stored: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``stored`` and the rows of ``new`` whose keys it lacks; what is stored never changes (SNK-03, SNK-15, SNK-19)."""
    best = pick(new, key, order)
    return stored.unionByName(best.join(stored, same_key(best, stored, key), "left_anti"))


def merge_confident(stored: DataFrame, new: DataFrame, key: list[str], confidence: str = "confidence") -> DataFrame:
    """Of stored and new rows the most confident one of each key; no confidence counts as -1, and stored rows win ties (AGG-20)."""
    rank = lambda c: F.coalesce(F.col(c), F.lit(-1.0))
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [F.col(c) for c in stored.columns if c not in key]
    return pick(both, key, [-rank(confidence), F.col("_new"), *rest]).drop("_new")


def replace_scope(stored: DataFrame, new: DataFrame, scope: dict[str, object]) -> DataFrame:
    """``stored`` without the rows of ``scope``, and ``new``: also when ``new`` is empty (SNK-09 to SNK-11, FLT-08)."""
    inside = F.lit(True)
    for name, value in scope.items():
        inside = inside & F.col(name).eqNullSafe(F.lit(value))
    return stored.where(~inside).unionByName(new.where(inside))
