"""Writes that account for themselves: the counts of the gates come with the rows, in the one pass that writes them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftline.functions import keys
from weftline.sources.scoped import ScopedTable
from weftline.sources.staging import observed


@dataclass(frozen=True)
class Account:
    """What a staged write read and wrote: every source row is written or lacks its key, and targets agree with resolutions (SNK-07, QA-01, QA-02, QA-06)."""

    source_rows: int = 0
    missing_rows: int = 0
    written_rows: int = 0
    null_rows: int = 0
    no_map_rows: int = 0
    resolved_but_null: int = 0
    no_map_but_populated: int = 0
    recounted: bool = False

    @property
    def adds_up(self) -> bool:
        return self.written_rows + self.missing_rows == self.source_rows

    @property
    def passed(self) -> bool:
        return self.adds_up and not self.resolved_but_null and not self.no_map_but_populated


def _source_counts(key: str) -> list[Column]:
    return [F.count("*").alias("source_rows"), F.count_if(keys.is_blank(F.col(key).cast("string"))).alias("missing_rows")]


def _staged_counts() -> list[Column]:
    empty, resolved, none = F.col("target_id").isNull(), F.col("resolution").eqNullSafe("RESOLVED"), F.col("resolution").eqNullSafe("NO_MAP")
    return [
        F.count("*").alias("written_rows"), F.count_if(empty).alias("null_rows"), F.count_if(none).alias("no_map_rows"),
        F.count_if(resolved & empty).alias("resolved_but_null"), F.count_if(none & ~empty).alias("no_map_but_populated"),
    ]


def staged_swap(target: ScopedTable, source: DataFrame, stage: Callable[[DataFrame], DataFrame], scopes: list[tuple], *, key: str) -> Account:
    """Write ``stage(source)`` (with target_id and resolution) in place of ``scopes``, and account for it. ``stage`` leaves out the rows whose ``key`` is blank.

    Source and result are counted while they pass, so both gates cost no scan. A task that is run again after an executor is lost may count its rows twice: an account that does not add up is
    made once more from the source and the stored rows, and says so.
    """
    read, staged = Observation(), Observation()
    done = target.swap(stage(source.observe(read, *_source_counts(key))).observe(staged, *_staged_counts()), scopes)
    found = replace(Account(), **{k: v for k, v in (observed(read) | observed(staged)).items() if v is not None})
    found = replace(found, written_rows=found.written_rows - done.n_outside)
    if found.adds_up and done.n_written == found.written_rows:
        return found
    counts = source.agg(*_source_counts(key)).first().asDict() | target.rows_of(scopes).agg(*_staged_counts()).first().asDict()
    return Account(**counts, recounted=True)


def as_row(account: Account, like: DataFrame) -> DataFrame:
    """The account as a table of one row."""
    facts = asdict(account) | {"passed": account.passed}
    return like.sparkSession.createDataFrame([tuple(facts.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long'}" for k, v in facts.items()))
