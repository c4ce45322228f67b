"""Plan objects of all kinds in one table of versions: payloads are VARIANT values that are filtered and read back typed; equal contents are one version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of plan objects, and the lists of each that have no order.
KINDS = ["mapping_assertion", "plan", "resolution", "pin", "obligation", "risk", "field_map"]
SETS = {"plan": ["risks", "steps"], "field_map": ["sources"], "obligation": ["fields"]}


def canonical(kind: Column, payload: Column) -> Column:
    """The payload's JSON with keys in order at every level, and lists that have no order sorted. ``payload``: VARIANT."""
    plain = F.to_json(payload)
    pairs = F.map_entries(payload.cast("map<string,variant>"))

    def value(entry: Column) -> Column:
        out = F.to_json(entry["value"])
        in_order = F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(entry["value"].cast("array<variant>"), lambda x: F.to_json(x))), ","), F.lit("]"))
        for k, fields in SETS.items():
            out = F.when((kind == k) & entry["key"].isin(fields) & out.startswith("["), in_order).otherwise(out)
        return F.concat(F.substring(F.to_json(F.array(entry["key"])), F.lit(2), F.length(F.to_json(F.array(entry["key"]))) - 2), F.lit(":"), out)

    # map entries of a VARIANT are sorted by key, as its fields are: only kinds with such lists have to be taken apart
    whole = F.concat(F.lit("{"), F.array_join(F.transform(pairs, value), ","), F.lit("}"))
    return F.when(kind.isin(list(SETS)) & plain.startswith("{"), whole).otherwise(plain)


def digest(kind: Column, payload: Column) -> Column:
    return F.sha2(canonical(kind, payload), 256)


def read(spark: SparkSession, name: str) -> DataFrame:
    """(kind, id, version, digest, payload) of all versions."""
    spark.catalog.refreshTable(name)
    return spark.read.table(name).select("kind", "id", "version", "digest", "payload")


def current(versions: DataFrame) -> DataFrame:
    """The last version of each object."""
    last = versions.groupBy("kind", "id").agg(F.max_by(F.struct("version", "digest", "payload"), "version").alias("last"))
    return last.select("kind", "id", "last.*")


def typed(objects: DataFrame, kind: str, schema: str) -> DataFrame:
    """(id, version, and the fields of ``schema``) of one kind; a field that is missing or of another type is null."""
    fields = [f.strip().partition(" ")[::2] for f in schema.split(",")]
    own = objects.where(F.col("kind") == kind)
    return own.select("id", "version", *(F.try_variant_get("payload", f"$.{name}", of.strip()).alias(name) for name, of in fields))


def persist(spark: SparkSession, name: str, objects: DataFrame, path: str | None = None) -> None:
    """Append objects (kind, id, json) whose content is not that of their last version (GRF-15). Doing it twice appends nothing.

    Of rows that share kind and id, the one with the largest canonical text counts. Rows without an id, of an unknown kind or with a text that is no JSON are left out.
    """
    texts = objects.where("id is not null").where(F.col("kind").isin(KINDS)).select("kind", F.col("id").cast("string").alias("id"), "json").distinct()  # texts are parsed once each, by as many tasks as there are partitions, not by those of the source's few files
    made = texts.select("kind", "id", F.try_parse_json("json").alias("payload")).where("payload is not null")
    named = made.withColumn("text", canonical(F.col("kind"), F.col("payload")))
    best = named.groupBy("kind", "id").agg(F.max_by("payload", "text").alias("payload"), F.sha2(F.max("text"), 256).alias("digest"))
    if not spark.catalog.tableExists(name):
        fresh = best.withColumn("version", F.lit(1).cast("long"))
    else:
        old = read(spark, name).groupBy("kind", "id").agg(F.max("version").alias("last"), F.max_by("digest", "version").alias("known"))  # payloads are not read
        met = best.join(old, ["kind", "id"], "left").where("known is null or known <> digest")
        fresh = met.withColumn("version", F.coalesce("last", F.lit(0)).cast("long") + 1)
    out = fresh.select("id", "version", "digest", "payload", "kind").write.mode("append").partitionBy("kind")
    (out.option("path", path) if path else out).saveAsTable(name)
