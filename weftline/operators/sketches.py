"""Profiles that grow: what each arrival of a table adds is kept as sketches that can be merged, so no arrival is scanned twice.

Distinct counts are HyperLogLog sketches, frequent values are frequent-item sketches; both merge to what one pass over everything would give, up to their error.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators import profile
from weftline.sources.scoped import ScopedTable

#: The logarithm of a distinct count's registers, and the values that a frequent-item sketch keeps apart.
REGISTERS = 14
TRACKED = 1000


def distinct_error(registers: int = REGISTERS) -> float:
    """The relative error of a merged distinct count: three standard errors of its estimator, about 99.7 % of all counts."""
    return 3 * 1.04 / math.sqrt(1 << registers)


def frequency_error(rows: int, tracked: int = TRACKED) -> int:
    """A value that occurs more often than this among ``rows`` values is sure to be in their sketch, merged or not."""
    slots = 1 << math.ceil(math.log2(tracked * 4 / 3))
    return math.ceil(3.5 * rows / slots)


def sketch(rows: DataFrame, name: str, arrival: str) -> DataFrame:
    """(column, n_rows, n_nulls, distinct_sketch, frequent_sketch, table, arrival) for every column of ``rows``, in one pass; values count as texts (AGG-01 to AGG-05)."""
    each = []
    for c in rows.columns:
        v = f"cast(`{c}` as string)"
        each.append(F.expr(f"struct('{c}' as column, count(*) as n_rows, count_if(`{c}` is null) as n_nulls, hll_sketch_agg({v}, {REGISTERS}) as distinct_sketch, approx_top_k_accumulate({v}, {TRACKED}) as frequent_sketch)"))
    made = rows.agg(F.array(*each).alias("each")).select(F.explode("each").alias("each")).select("each.*")
    return made.withColumns({"table": F.lit(name), "arrival": F.lit(arrival)})


def merged(sketches: DataFrame) -> DataFrame:
    """(table, column, n_rows, n_nulls, n_distinct, frequent_sketch) over all arrivals."""
    both = sketches.groupBy("table", "column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.expr(f"approx_top_k_combine(frequent_sketch, {TRACKED})").alias("frequent_sketch")
    )
    return both.select("table", "column", "n_rows", "n_nulls", F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), "frequent_sketch")


def top_values(rows: DataFrame, sketches: DataFrame, name: str, column: str, k: int) -> DataFrame:
    """(value, frequency): the k most frequent values that are not null, ties to the smaller text; as ``profile.top_values`` gives them (AGG-04, PRJ-10).

    The sketch names the candidates, a second pass counts these alone. If the k-th of them is not more frequent than what a sketch may lack, all values are counted.
    """
    found = merged(sketches.where((F.col("table") == name) & (F.col("column") == column)))
    facts = found.select("n_rows", F.expr(f"approx_top_k_estimate(frequent_sketch, {TRACKED})").alias("top")).first()
    value = F.col(f"`{column}`").cast("string").alias("value")
    exact = rows.where(f"`{column}` is not null").select(value)
    if facts is not None:
        candidates = rows.sparkSession.createDataFrame([(t["item"],) for t in facts["top"]], "value string")  # TRACKED at most
        counted = profile.top_values(exact.join(F.broadcast(candidates), "value", "left_semi"), "value", k).collect()
        if len(counted) == k and counted[-1]["frequency"] > frequency_error(facts["n_rows"]):
            return rows.sparkSession.createDataFrame(counted, "value string, frequency long")
    return profile.top_values(exact, "value", k)


class Profiles:
    """Stored sketches, a scope for each table and arrival: an arrival that comes again takes the place of what it was."""

    def __init__(self, like: DataFrame, name: str, path: str | None = None) -> None:
        self.store = ScopedTable.create(sketch(like, "", ""), name, ["table", "arrival"], path=path)

    def arrive(self, rows: DataFrame, table: str, arrival: str) -> None:
        self.store.swap(sketch(rows, table, arrival), [(table, arrival)])

    def profile(self) -> DataFrame:
        return merged(self.store.read())
