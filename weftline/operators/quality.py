"""Gates on staged data, evaluation against a gold set, and the comparison of two dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import keys
from weftline.functions.values import frequency_bucket

CELLS = ["tp", "wrong", "fn", "recall_miss", "tn", "fp_map", "na"]


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children without a parent; a null key is an orphan (JOIN-03, QA-04)."""
    return child.join(parent, child[child_key] == parent[parent_key], "left_anti")


def null_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_nulls), one pass (AGG-05, QA-05)."""
    found = rows.agg(F.array(*(F.struct(F.lit(c).alias("column"), (F.count("*") - F.count(c)).alias("n_nulls")) for c in columns)).alias("s"))
    return found.select(F.explode("s").alias("s")).select("s.*")


def null_rate(staged: DataFrame) -> DataFrame:
    """One row: totals, and how many rows have a target against their resolution (QA-02)."""
    resolved, none = F.col("resolution") == "RESOLVED", F.col("resolution") == "NO_MAP"
    empty = F.col("target_id").isNull()
    return staged.agg(
        F.count("*").alias("total"), F.count_if(empty).alias("null_rows"), F.count_if(none).alias("no_map_rows"),
        F.count_if(resolved & empty).alias("resolved_but_null"), F.count_if(none & ~empty).alias("no_map_but_populated"),
    ).withColumn("passed", (F.col("resolved_but_null") == 0) & (F.col("no_map_but_populated") == 0))


def key_accounting(source: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """One row: written + missing == source (QA-06, QA-01)."""
    marks = source.select(F.lit("s").alias("side"), keys.is_blank(F.col(key).cast("string")).alias("blank")).unionByName(written.select(F.lit("w").alias("side"), F.lit(False).alias("blank")))
    both = marks.agg(F.count_if(F.col("side") == "s").alias("source_rows"), F.count_if("blank").alias("missing_rows"), F.count_if(F.col("side") == "w").alias("written_rows"))
    return both.withColumn("passed", F.col("written_rows") + F.col("missing_rows") == F.col("source_rows"))


def zone(resolution: Column, status: Column, target: Column) -> Column:
    """FN-28."""
    return F.when((resolution == "NO_MAP") & target.isNull(), 3).when(status.isin("auto_accepted", "human_pinned") & (resolution == "RESOLVED") & target.isNotNull(), 1).otherwise(2)


def cells(gold: DataFrame, decisions: DataFrame) -> DataFrame:
    """(code, cell, row_count, bucket) for every gold code with a label; codes without a decision are in zone 2 (JOIN-21).

    gold: code, gold_id, label (RESOLVED, NO_MAP, UNLABELLED), row_count. decisions: code, target_id, resolution, status.
    """
    met = gold.where("label in ('RESOLVED', 'NO_MAP')").join(decisions, "code", "left")
    z = zone(F.col("resolution"), F.col("status"), F.col("target_id"))
    known = F.when(z == 1, F.when(F.col("target_id").eqNullSafe(F.col("gold_id")), "tp").otherwise("wrong")).when(z == 3, "fn").otherwise("recall_miss")
    unknown = F.when(z == 1, "fp_map").when(z == 3, "tn").otherwise("na")
    return met.select("code", F.when(F.col("label") == "RESOLVED", known).otherwise(unknown).alias("cell"), "row_count", frequency_bucket(F.col("row_count")).alias("bucket"))


def confusion(found: DataFrame, key: list[str]) -> DataFrame:
    """The seven cells, by codes and by rows, for each ``key`` (AGG-13)."""
    of = lambda c: F.col("cell") == c
    counts = [F.count_if(of(c)).alias(c) for c in CELLS]
    rows = [F.sum(F.when(of(c), F.col("row_count")).otherwise(0)).alias(f"{c}_rows") for c in CELLS]
    return found.groupBy(*key).agg(*counts, *rows)


def metrics(counts: DataFrame, coverage: Column | None = None) -> DataFrame:
    """``counts`` with ratios that are null where nothing can be said, and a verdict (AGG-14, AGG-16, AGG-17).

    coverage: the part of the codes that has a gold label; below 1 the verdict stays provisional.
    """
    full = (F.lit(1.0) if coverage is None else coverage) >= 1.0
    total = lambda *names: sum((F.col(n) for n in names[1:]), F.col(names[0]))
    precision = F.try_divide(F.col("tp"), total("tp", "wrong", "fp_map"))
    auto = F.try_divide(total("tp", "wrong", "fp_map"), total(*CELLS))
    return counts.withColumns({
        "precision": precision,
        "recall": F.try_divide(F.col("tp"), total("tp", "wrong", "fn", "recall_miss")),
        "auto_rate": auto,
        "no_map_accuracy": F.try_divide(F.col("tn"), total("tn", "fp_map")),
        "contradicted": total("wrong", "fn", "fp_map") > 0,
        "verdict": F.when(~full, "provisional").when((precision >= 0.95) & (auto >= 0.70), "accepted").otherwise("not_accepted"),
    })


def diff(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, change, old, new): added, removed and changed keys (JOIN-22, SET-02)."""
    a = old.select(*key, F.col(value).alias("old"), F.lit(True).alias("_a"))
    b = new.select(*key, F.col(value).alias("new"), F.lit(True).alias("_b"))
    met = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return met.select(*key, change.alias("change"), "old", "new").where("change is not null")


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that should be unique and are not (GRF-14)."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def unscoped(edges: dict[str, DataFrame], scope: str = "source_schema") -> DataFrame:
    """(shape, n_nulls): edges of each kind without a scope (QA-07)."""
    out = None
    for name, table in edges.items():
        one = table.agg(F.count_if(F.col(scope).isNull()).alias("n_nulls")).select(F.lit(name).alias("shape"), "n_nulls")
        out = one if out is None else out.unionByName(one)
    return out


def no_map_accounting(staged: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: outcome, n_no_map, resolved_in_gold, unlabelled_in_gold: staged codes without a map against the gold labels (QA-03).

    staged: code, resolution; gold: code, label. Codes that gold resolves and the stage does not are a failure; both lists are sorted.
    """
    none = staged.where("resolution = 'NO_MAP'").select("code").distinct().join(gold.select("code", "label"), "code", "left")
    listed = lambda label: F.sort_array(F.collect_set(F.when(F.col("label") == label, F.col("code"))))
    found = none.agg(F.countDistinct("code").alias("n_no_map"), listed("RESOLVED").alias("resolved_in_gold"), listed("UNLABELLED").alias("unlabelled_in_gold"))
    return found.select(F.when(F.size("resolved_in_gold") == 0, "PASS").otherwise("FAIL").alias("outcome"), "*")


def strict_gate(checks: DataFrame, violations: DataFrame, report: DataFrame) -> DataFrame:
    """One row: passed, reasons: what keeps a run from passing strictly (QA-08).

    checks: name, outcome; violations: decisions against the contract; report: contradicted (boolean). Missing gold labels alone are no reason.
    """
    failed = checks.where("outcome <> 'PASS'").agg(F.sort_array(F.collect_set("name")).alias("failed"))
    broken = violations.agg(F.count("*").alias("n_violations"))
    denied = report.agg(F.coalesce(F.max("contradicted"), F.lit(False)).alias("contradicted"))
    reasons = F.array(
        F.when(F.size("failed") > 0, F.concat(F.lit("checks: "), F.array_join("failed", ", "))),
        F.when(F.col("n_violations") > 0, F.concat(F.lit("conformance: "), F.col("n_violations").cast("string"))),
        F.when(F.col("contradicted"), F.lit("gold is contradicted")),
    )
    one = failed.crossJoin(broken).crossJoin(denied).withColumn("reasons", F.array_compact(reasons))  # one row each
    return one.select((F.size("reasons") == 0).alias("passed"), "reasons")
