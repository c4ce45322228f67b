"""Mapping patterns: small declarations that become DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.values import text_cast


@dataclass(frozen=True)
class Field:
    """One target column. Exactly one of source, constant (with ``is_constant``) or cast decides its value (PRJ-01 to PRJ-03)."""

    target: str
    source: str | None = None
    constant: object = None
    is_constant: bool = False
    cast: str | None = None

    def column(self, is_text: bool = False) -> Column:
        """``is_text``: the source is a text, whose cast to a number is guarded."""
        name = self.target.rpartition(".")[2]
        if self.is_constant:
            return F.lit(self.constant).alias(name)
        if self.source is None:
            raise ValueError(f"field {self.target} has neither a source nor a constant")
        column = F.col(self.source.rpartition(".")[2])
        if self.cast:
            column = text_cast(column, self.cast) if is_text else column.try_cast(self.cast)
        return column.alias(name)


def project(source: DataFrame, fields: list[Field]) -> DataFrame:
    """PRJ-04. A field list must not be empty; casts that fail give null."""
    if not fields:
        raise ValueError("a projection needs fields")
    texts = {n for n, kind in source.dtypes if kind == "string"}
    return source.select(*(f.column((f.source or "").rpartition(".")[2] in texts) for f in fields))


def pivot(rows: DataFrame, key: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One row for each key, a column for each of ``names``, the sum of its values (RSH-04). The names are given, so the plan's schema is fixed."""
    return rows.groupBy(*key).pivot(name, names).agg(F.sum(value))


def unpivot(rows: DataFrame, key: list[str], columns: list[str], name: str, value: str, *, keep_nulls: bool = True, keep_blanks: bool = True) -> DataFrame:
    """RSH-01 to RSH-03, SRC-12, SRC-13."""
    out = rows.unpivot([F.col(f"`{c}`") for c in key], [F.col(f"`{c}`") for c in columns], name, value)
    if not keep_nulls:
        out = out.where(F.col(value).isNotNull())
    return out if keep_blanks else out.where(F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))) != "")


def split(rows: DataFrame, column: str, delimiter: str, targets: list[str]) -> DataFrame:
    """Parts of a text as columns; parts that lack are null (FN-30)."""
    parts = F.split(F.col(column), f"\\Q{delimiter}\\E")
    return rows.select("*", *(F.get(parts, i).alias(t) for i, t in enumerate(targets)))


#: Aggregates of the pattern, by name. FIRST and LAST need an order, and go by it.
_AGGREGATES = {
    "COUNT": lambda c, o: F.count(c), "SUM": lambda c, o: F.sum(c), "AVG": lambda c, o: F.avg(c), "MIN": lambda c, o: F.min(c), "MAX": lambda c, o: F.max(c),
    "FIRST": lambda c, o: F.min_by(c, o), "LAST": lambda c, o: F.max_by(c, o), "ANY": lambda c, o: F.bool_or(c), "ALL": lambda c, o: F.bool_and(c),
    "ARRAY_AGG": lambda c, o: F.transform(F.array_sort(F.collect_list(F.struct(o, c))), lambda s: s.getField("col2")),
    "JSON_AGG": lambda c, o: F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(o, c))), lambda s: s.getField("col2"))),
}


@dataclass(frozen=True)
class Aggregate:
    target: str
    function: str
    source: str
    order: str | None = None
    where: str | None = None


def aggregate(rows: DataFrame, key: list[str], aggregates: list[Aggregate], having: str | None = None) -> DataFrame:
    """AGG-39."""
    found = []
    for a in aggregates:
        value = F.col(a.source) if a.where is None else F.when(F.expr(a.where), F.col(a.source))
        order = F.col(a.order) if a.order else F.col(a.source)
        order = order if a.where is None else F.when(F.expr(a.where), order)
        found.append(_AGGREGATES[a.function](value.alias("col2") if a.function.endswith("_AGG") else value, order.alias("col1") if a.function.endswith("_AGG") else order).alias(a.target))
    out = rows.groupBy(*key).agg(*found)
    return out if having is None else out.where(having)


def distinct_rows(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key (RSH-05)."""
    return rows.select(*key).distinct()


def envelope(rows: DataFrame, key: list[str], low: str, high: str) -> DataFrame:
    """The least and the largest value of each key (RSH-05, WIN-07)."""
    return rows.groupBy(*key).agg(F.min(low).alias("low"), F.max(high).alias("high"))


@dataclass(frozen=True)
class Lookup:
    """JOIN-32. ``single``: a key that the other side has more than once is an error of the data, see ``lookup_conflicts``."""

    key: str
    other_key: str
    take: list[str] = field(default_factory=list)


def lookup(rows: DataFrame, other: DataFrame, how: Lookup) -> DataFrame:
    right = other.select(F.col(how.other_key).alias("_key"), *how.take)
    return rows.join(right, rows[how.key] == right["_key"], "left").drop("_key")


def lookup_conflicts(other: DataFrame, how: Lookup) -> DataFrame:
    return other.groupBy(F.col(how.other_key).alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def preferred_first(rows: DataFrame, key: str, synonyms: str) -> DataFrame:
    """(key, synonym, is_preferred): the first of a list is the preferred one (WIN-05)."""
    return rows.select(key, F.posexplode(synonyms).alias("_i", "synonym")).select(key, "synonym", (F.col("_i") == 0).alias("is_preferred"))


def latest_window(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Every row with the value of ``is_last`` in its key."""
    return rows.withColumn("is_last", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) == 1)
