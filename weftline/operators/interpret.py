"""What interpreters said about tables and columns: admission, confidence, merging into claims, and reports on a run.

Interpreters themselves (language models, embedders) are plug-ins, see ``weftline.plans.plugins``; here are the rules on their results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import keys

#: Types of columns whose values need no decoding; types without a hierarchy; vocabularies with one; words in names of coded columns.
NOT_DECODED = [
    "identifier", "patient identifier", "encounter identifier", "specimen/sample identifier", "account identifier", "transaction identifier", "instrument identifier",
    "temporal", "temporal field", "free_text", "free text",
]
NO_HIERARCHY = ["numeric", "temporal", "identifier", "free_text"]
HIERARCHICAL = ["icd-10", "atc", "cpt", "snomed", "ajcc", "tnm", "oncotree", "loinc", "meddra"]
CODED_WORDS = ["code", "cd", "type", "stage", "class", "category", "dx", "icd", "cpt"]
#: Floors of coverage for a partial result, by how well a table is documented.
RICH_FLOOR, OTHER_FLOOR = 0.75, 0.60


def unresolved(columns: DataFrame, floor: float = 0.4) -> Column:
    """FLT-13: unsure and with notes on why."""
    return (F.col("confidence") < floor) & (F.size("notes") > 0)


def needs_decoding() -> Column:
    """FLT-14, over: semantic_type, flagged, n_distinct, has_values, confidence, notes."""
    few = F.coalesce((F.col("n_distinct") <= 50) & F.col("has_values"), F.lit(False))
    return ~F.lower("semantic_type").isin(NOT_DECODED) & (F.col("flagged") | few | ((F.col("confidence") < 0.5) & (F.size("notes") > 0)))


def plain_vocabulary(name: Column) -> Column:
    """A vocabulary's name for comparison (FN-19)."""
    # The edition's pattern and the words that are left out.
    bare = F.regexp_replace(F.trim(F.lower(name)), r"\s*\d+(st|nd|rd|th)\s+edition\s*", "")
    for word in ("staging", "classification", "codes", "system"):
        bare = F.trim(F.regexp_replace(bare, word, ""))
    return bare


def boosted(confidence: Column, found: Column, guess: Column) -> Column:
    """FN-19: a guess that agrees adds 0.1."""
    agrees = F.coalesce(plain_vocabulary(found) == plain_vocabulary(guess), F.lit(False))
    return F.when(agrees, F.least(confidence + 0.1, F.lit(1.0))).otherwise(confidence)


def has_hierarchy(semantic_type: Column, vocabulary: Column) -> Column:
    """FN-20; without a vocabulary there is none."""
    return ~F.coalesce(F.lower(semantic_type).isin(NO_HIERARCHY), F.lit(False)) & F.coalesce(plain_vocabulary(vocabulary).isin(HIERARCHICAL), F.lit(False))


def is_coded_name(column: Column) -> Column:
    return F.lower(column).rlike("|".join(CODED_WORDS))


def coverage(columns: DataFrame) -> DataFrame:
    """(table, raw, critical, outcome) from columns (table, resolved, critical, tier) (AGG-35).

    A critical column that is not resolved fails the table; else all resolved is success, and enough of them partial.
    """
    share = lambda good, of: F.coalesce(F.round(F.try_divide(F.count_if(good & of), F.count_if(of)), 4), F.lit(1.0))
    every, done, crit = F.lit(True), F.col("resolved"), F.col("critical")
    found = columns.groupBy("table").agg(share(done, every).alias("raw"), share(done, crit).alias("critical"), F.first("tier").alias("tier"))
    floor = F.when(F.col("tier") == "rich", RICH_FLOOR).otherwise(OTHER_FLOOR)
    outcome = F.when(F.col("critical") < 1.0, "B_FAILED").when(F.col("raw") >= 1.0, "B_SUCCESS").when(F.col("raw") >= floor, "B_PARTIAL").otherwise("B_FAILED")
    return found.select("table", "raw", "critical", outcome.alias("outcome"))


def merged_claims(tables: DataFrame, columns: DataFrame, decoded: DataFrame) -> DataFrame:
    """(subject, predicate, payload, confidence) from three stages, each the owner of its predicates (PRJ-09).

    tables: ref, entity, grain, synonyms, confidence, entity_fix, grain_fix; columns: ref, property, semantic_type, synonyms,
    confidence, resolved; decoded: ref, raw, label. A table's synonyms are dropped if the second stage corrected its entity.
    """
    to_json = lambda **f: F.to_json(F.struct(*(c.alias(n) for n, c in f.items())))
    claim = lambda df, predicate, payload, confidence: df.select(F.col("ref").alias("subject"), F.lit(predicate).alias("predicate"), payload.alias("payload"), confidence.alias("confidence"))
    sure = F.col("confidence")

    def synonyms(df: DataFrame) -> DataFrame:
        each = df.select("ref", "confidence", F.posexplode("synonyms").alias("i", "value"))
        return claim(each, "has_alias", to_json(value=F.col("value"), is_preferred=F.col("i") == 0), sure)

    names = claim(tables, "has_entity_name", to_json(value=F.coalesce("entity_fix", "entity"), grain=F.coalesce("grain_fix", "grain")), sure)
    good = columns.where("resolved")
    out = names.unionByName(synonyms(tables.where("entity_fix is null and grain_fix is null")))
    out = out.unionByName(claim(good, "has_property_name", to_json(value=F.col("property")), sure)).unionByName(claim(good, "has_semantic_type", to_json(value=F.col("semantic_type")), sure))
    return out.unionByName(synonyms(good)).unionByName(claim(decoded, "has_decoded_value", to_json(raw=F.col("raw"), label=F.col("label")), F.lit(1.0)))


def vocabulary_work(values: DataFrame, columns: DataFrame) -> DataFrame:
    """Values of resolved columns only (JOIN-34)."""
    return values.join(columns.where("resolved").select("ref", "semantic_type"), "ref")


def table_documents(columns: DataFrame) -> DataFrame:
    """(table, columns): one nested row for each table, as interpreters take it (RSH-07)."""
    return columns.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("position", "column", "type", "comment"))).alias("columns"))


def run_report(results: DataFrame) -> DataFrame:
    """One row of counts over tables (status, partial, failed_stage, skip_reason, n_entities, n_properties, n_terms), and which budget is broken (AGG-36).

    The rates count only from five tables on.
    """
    status, stage = F.col("status"), F.coalesce("failed_stage", F.lit(""))
    n = results.agg(
        F.count_if(status == "success").alias("succeeded"), F.count_if((status == "success") & F.col("partial")).alias("partial"),
        F.count_if((status == "failed") & (stage == "L2 stage B")).alias("stage_b_failed"), F.count_if((status == "failed") & (stage != "L2 stage B")).alias("other_failed"),
        F.count_if((status == "skipped") & F.coalesce(F.col("skip_reason").startswith("resume"), F.lit(False))).alias("resumed"), F.count_if(status == "skipped").alias("skipped"),
        *(F.coalesce(F.sum(F.when(status == "success", F.col(c))), F.lit(0)).alias(c) for c in ("n_entities", "n_properties", "n_terms")),
    )
    in_graph = F.col("succeeded") + F.col("stage_b_failed") + F.col("resumed")
    tried = F.col("succeeded") + F.col("stage_b_failed") + F.col("other_failed") + F.col("skipped") - F.col("resumed")
    broken = F.when((in_graph >= 5) & (F.try_divide("stage_b_failed", in_graph) > 0.30), "stage_b_failure_rate").when((tried >= 5) & (F.try_divide(F.col("other_failed"), tried) > 0.40), "run_non_contributing_rate")
    return n.withColumn("broken", broken)


def telemetry(tables: DataFrame) -> DataFrame:
    """One row of averages and sums over tables (outcome, coverage, latency_ms, retries, tokens_in, tokens_out); zeros for none (AGG-37)."""
    mean = lambda c, digits: F.coalesce(F.round(F.avg(c), digits), F.lit(0.0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return tables.agg(
        F.count("*").alias("n_tables"), *(F.count_if(F.col("outcome") == o).alias(o.lower()) for o in ("B_SUCCESS", "B_PARTIAL", "B_FAILED")),
        mean("coverage", 4).alias("avg_coverage"), mean("latency_ms", 1).alias("avg_latency_ms"), *(total(c) for c in ("retries", "tokens_in", "tokens_out")),
    )


def churn(old: DataFrame, new: DataFrame) -> DataFrame:
    """(table, n_old, n_new, state): tables of two runs by their short name (JOIN-33)."""
    short = lambda t, n: t.groupBy(F.substring_index("ref", "/", -1).alias("table")).agg(F.count("*").alias(n))
    met = short(old, "n_old").join(short(new, "n_new"), "table", "full_outer")
    state = F.when(F.col("n_old").isNull(), "only_new").when(F.col("n_new").isNull(), "only_old").otherwise("both")
    return met.select("table", "n_old", "n_new", state.alias("state"))


def embedding_text(label: Column, name: Column, description: Column, code: Column) -> Column:
    """FN-29: what a node is embedded as."""
    told = F.when(keys.is_blank(description), None).otherwise(description)
    return F.when(label == "term", F.coalesce(name, code)).when(label == "alias", name).otherwise(F.concat_ws(" - ", name, told))
