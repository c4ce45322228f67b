"""Target models: what the ends of edges add to their properties, and which stages have to run again after a change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranked import number
from weftline.sources.staging import Steps

#: Stages that may stand after one another; more are a circle, which is an error.
MOST_LEVELS = 1000


def properties(declared: DataFrame, ends: DataFrame) -> DataFrame:
    """(entity, place, name, type, nullable, kind, target, cardinality): declared properties and one for each end of an edge, by name (TGT-02, SRT-08).

    declared: entity, name, type, nullable. ends: entity, role, target, cardinality, nullable; an end's property has the name of its role. A declared property of that name stays beside it, after it.
    """
    own = declared.select("entity", "name", "type", "nullable", F.lit("DECLARED").alias("kind"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("cardinality"))
    made = ends.where("role is not null").select("entity", F.col("role").alias("name"), F.lit("endpoint").alias("type"), "nullable", F.lit("ENDPOINT").alias("kind"), "target", "cardinality")
    both = own.unionByName(made).distinct()
    return number(both, ["entity"], [F.asc("name"), F.desc("kind"), F.asc("type"), F.asc("target"), F.asc("nullable")], "place").select("entity", "place", "name", "type", "nullable", "kind", "target", "cardinality")


def content_digests(rows: DataFrame, stage: str) -> DataFrame:
    """(stage, own): a digest of all rows of each stage, whatever their order, repeats included.

    Rows are digested on their own; the digests' quarters are added up, so a stage of any size costs a task four sums.
    """
    line = F.sha2(F.to_json(F.struct(*(F.col(c) for c in rows.columns if c != stage)), {"ignoreNullFields": "false"}), 256)
    quarter = lambda k: F.sum(F.conv(F.substring("_line", 16 * k + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    summed = rows.select(F.col(stage).alias("stage"), line.alias("_line")).groupBy("stage").agg(F.concat_ws(":", F.count("*").cast("string"), *(quarter(k) for k in range(4))).alias("_sums"))
    return summed.select("stage", F.sha2("_sums", 256).alias("own"))


def chained(own: DataFrame, needs: DataFrame) -> DataFrame:
    """(stage, digest): of each stage's own digest and those of all stages it needs, so a change reaches every stage after it (TGT-04).

    own: stage, own. needs: stage, needed. Stages are settled level by level, those without needs first; a stage that needs itself in the end, or one that is not there, is an error.
    """
    steps = Steps(own.sparkSession)
    stages = steps.cut(own.where("stage is not null").groupBy("stage").agg(F.max("own").alias("own")), "stages")
    needs = steps.cut(needs.where("stage is not null and needed is not null").distinct().join(stages.select("stage"), "stage", "left_semi"), "needs")
    waits = needs.groupBy("stage").agg(F.count("*").alias("open"))
    left = steps.cut(stages.join(waits, "stage", "left").select("stage", "own", F.coalesce("open", F.lit(0)).alias("open")), "left")
    done: list[DataFrame] = []
    for _ in range(MOST_LEVELS):
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done) if done else left.select("stage", F.col("own").alias("digest"))
        if done:
            known = reduce(DataFrame.unionByName, done).withColumnsRenamed({"stage": "needed", "digest": "theirs"})
            met = needs.join(known, "needed").groupBy("stage").agg(F.count("*").alias("met"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "needed", "theirs"))), "|").alias("given"))
            ready = left.join(met, "stage").where("met = open").select("stage", F.sha2(F.concat_ws("|", "own", "given"), 256).alias("digest"))
        else:
            ready = left.where("open = 0").select("stage", F.sha2("own", 256).alias("digest"))
        ready = steps.cut(ready, "level")
        if ready.isEmpty():
            raise ValueError("stages need each other in a circle, or one that is not there")
        done.append(ready)
        left = steps.cut(left.join(ready, "stage", "left_anti"), "left")
    raise ValueError(f"more than {MOST_LEVELS} stages after one another")


def stages_to_run(now: DataFrame, stored: DataFrame) -> DataFrame:
    """(stage, state): ``run`` for stages whose digest is not the stored one, ``skip`` for the others, ``drop`` for stored ones that are gone. Both: stage, digest."""
    met = now.join(stored.select("stage", F.col("digest").alias("before"), F.lit(True).alias("was")), "stage", "full_outer")
    state = F.when(F.col("digest").isNull(), "drop").when(F.col("digest").eqNullSafe(F.col("before")), "skip").otherwise("run")
    return met.select("stage", state.alias("state"))
