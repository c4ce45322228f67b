"""What a catalog's tables look like: counts, frequent values, keys that point to each other, domain and documentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import keys

#: Words of table and column names that speak for a domain.
DOMAIN_WORDS = {
    "healthcare": [
        "patient", "diagnosis", "encounter", "provider", "claim", "procedure", "medication", "prescription", "clinical", "icd", "cpt", "ndc", "loinc", "snomed", "vitals", "lab", "observation", "condition", "allergy", "immunization", "practitioner", "hospital", "admission", "discharge",
    ],
    "financial": [
        "account", "transaction", "ledger", "portfolio", "trade", "ticker", "cusip", "isin", "naics", "sic", "balance", "payment", "invoice", "revenue", "expense", "asset", "liability", "equity", "dividend", "interest", "loan", "credit", "debit", "settlement", "clearing",
    ],
    "real_estate": [
        "property", "listing", "parcel", "lease", "tenant", "unit", "building", "address", "zoning", "mls", "appraisal", "mortgage", "deed", "escrow", "closing", "sqft", "bedroom", "bathroom", "lot", "assessment", "landlord", "rental", "vacancy", "occupancy",
    ],
    "logistics": [
        "shipment", "carrier", "tracking", "warehouse", "inventory", "order", "delivery", "route", "fleet", "freight", "container", "manifest", "customs", "dispatch", "dock", "pallet", "sku", "fulfillment", "transit",
    ],
    "general": [
        "user", "customer", "product", "order", "category", "session", "event", "log", "metric", "config",
    ],
}
#: Fixed values of the tiers of foreign keys: confidence by values, by counts, by name only; and the coverage that values need.
TIER_CONFIDENCE = (0.95, 0.80, 0.70)
COVERAGE = 0.80


def columns_of(tables: dict[str, DataFrame], schema: str) -> DataFrame:
    """(schema, table, column, type, position, comment) for every column of ``tables`` (SRC-04)."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(schema, t, f.name, f.dataType.simpleString(), i, f.metadata.get("comment")) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "schema string, table string, column string, type string, position int, comment string")


def profile(table: DataFrame, name: str) -> DataFrame:
    """(table, column, n_rows, n_nulls, n_distinct) for every column (AGG-01, AGG-02, AGG-05).

    Exact distinct counts of all columns in one aggregate would multiply the rows by the columns. So each column is counted on its own: its scan
    reads that column only, equal values are added up before the shuffle, and the values' counts give all three numbers.
    """
    found = []
    for c in table.columns:
        counted = table.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("n"))
        found.append(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"), F.count("v").alias("n_distinct")).withColumn("column", F.lit(c)))
    return reduce(DataFrame.unionByName, found).select(F.lit(name).alias("table"), "column", "n_rows", "n_nulls", "n_distinct")


def approx_profile(table: DataFrame, name: str, error: float = 0.02) -> DataFrame:
    """(table, column, n_distinct) by sketches, in one pass (AGG-03)."""
    stats = [F.struct(F.lit(c).alias("column"), F.approx_count_distinct(c, error).alias("n_distinct")) for c in table.columns]
    return table.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select(F.lit(name).alias("table"), "s.column", "s.n_distinct")


def top_values(table: DataFrame, column: str, k: int) -> DataFrame:
    """(value, frequency): the k most frequent values, ties to the smaller value; null is a value (AGG-04)."""
    return table.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("frequency")).orderBy(F.desc("frequency"), F.asc_nulls_first("value")).limit(k)


def distinct_keys(table: DataFrame, column: str) -> DataFrame:
    """The distinct values that are not blank, sorted (SRC-26, SRC-27)."""
    return table.where(~keys.is_blank(F.col(column).cast("string"))).select(F.col(column)).distinct()


def key_candidates(columns: DataFrame) -> DataFrame:
    """Pairs of columns where one's name speaks of the other's table, inside a schema, types fitting (JOIN-19)."""
    child = columns.select("schema", F.col("table").alias("child_table"), F.col("column").alias("child_column"), F.col("type").alias("child_type"), keys.key_root(F.col("column")).alias("root"))
    parent = columns.select("schema", F.col("table").alias("parent_table"), F.col("column").alias("parent_column"), F.col("type").alias("parent_type"), F.lower("table").alias("root"))
    met = child.where("root <> '' and lower(child_table) <> root").join(parent, ["schema", "root"])
    return met.where((F.col("child_table") != F.col("parent_table")) & keys.same_type_family(F.col("parent_type"), F.col("child_type"))).drop("root")


def shared_columns(columns: DataFrame) -> DataFrame:
    """(from_table, to_table, column, confidence): columns of one name in two tables (JOIN-20)."""
    a = columns.select(F.col("table").alias("from_table"), "column")
    b = columns.select(F.col("table").alias("to_table"), "column")
    low = F.lower("column")
    confidence = F.when(low.isin(keys.GENERIC_COLUMNS), 0.4).when(low.endswith("_id"), 0.8).otherwise(0.7)
    return a.join(b, "column").where("from_table < to_table").select("from_table", "to_table", "column", confidence.alias("confidence"))


def key_evidence(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """One row: n_child, n_met, n_parent, n_parent_rows: distinct values of both columns and how many of the child's the parent has (AGG-30, AGG-31)."""
    own = child.select(F.col(child_column).cast("string").alias("v")).where("v is not null").distinct().withColumn("c", F.lit(1))
    theirs = parent.select(F.col(parent_column).cast("string").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    met = own.join(theirs, "v", "full_outer")
    return met.agg(F.count("c").alias("n_child"), F.count(F.when(F.col("n").isNotNull(), F.col("c"))).alias("n_met"), F.count("n").alias("n_parent"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_parent_rows"))


def key_tier(evidence: DataFrame) -> DataFrame:
    """``evidence`` with coverage, tier and confidence (AGG-30 to AGG-32)."""
    coverage = F.coalesce(F.try_divide("n_met", "n_child"), F.lit(0.0))
    unique = (F.col("n_parent") > 0) & (F.col("n_parent") == F.col("n_parent_rows")) & (F.col("n_child") <= F.col("n_parent"))
    tier = F.when((F.col("n_child") > 0) & (coverage >= COVERAGE), 1).when(unique, 2).otherwise(3)
    confidence = F.when(tier == 1, TIER_CONFIDENCE[0]).when(tier == 2, TIER_CONFIDENCE[1]).otherwise(TIER_CONFIDENCE[2])
    return evidence.withColumns({"coverage": coverage, "tier": tier, "confidence": confidence})


def domain_words(spark) -> DataFrame:
    return spark.createDataFrame([(d, w) for d, ws in DOMAIN_WORDS.items() for w in ws], "domain string, word string")


def domain_weights(columns: DataFrame) -> DataFrame:
    """(domain, n, weight) from the words in the names of tables and columns (AGG-33, FN-14)."""
    tables = columns.select("table").distinct().select(F.col("table").alias("name"))
    names = tables.unionAll(columns.select(F.col("column").alias("name"))).unionAll(columns.select("table"))
    words = names.select(F.explode(keys.name_tokens(F.col("name"))).alias("word"))
    counts = words.join(F.broadcast(domain_words(columns.sparkSession)), "word").groupBy("domain").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over one row for each domain
    return counts.select("domain", "n", F.round(F.col("n") / total, 2).alias("weight"))


def domain_confidence(top: Column) -> Column:
    """From the largest weight; null for none."""
    return F.when(top.isNull(), 0.2).when(top >= 0.6, 0.85).when(top >= 0.4, 0.6).otherwise(0.4)


def metadata_tier(columns: DataFrame, tables: DataFrame, floor: float = 0.6) -> DataFrame:
    """(table, coverage, tier): how well a table is documented (AGG-34).

    columns: table, comment, has_values; tables: table, comment, has_samples.
    """
    share = columns.groupBy("table").agg(F.avg((~keys.is_blank(F.col("comment"))).cast("int")).alias("coverage"), F.avg(F.col("has_values").cast("int")).alias("valued"))
    rows = tables.join(share, "table", "left").select("table", "has_samples", (~keys.is_blank(F.col("comment"))).alias("told"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("coverage", "valued")))
    support = F.col("told") | (F.col("valued") >= 0.5) | F.col("has_samples")
    any_ = (F.col("coverage") > 0) | F.col("told") | (F.col("valued") > 0) | F.col("has_samples")
    return rows.select("table", F.round("coverage", 4).alias("coverage"), F.when((F.col("coverage") >= floor) & support, "rich").when(any_, "sparse").otherwise("name_only").alias("tier"))
