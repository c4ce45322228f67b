"""Strategies that tell which records are one entity (MAP-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import keys
from weftline.operators.connect import components


def by_hash(records: DataFrame, parts: list[str]) -> DataFrame:
    """Records with ``entity``, a digest of their key parts; records that lack a part have none."""
    whole = F.lit(True)
    for p in parts:
        whole = whole & ~keys.is_blank(F.col(p).cast("string"))
    return records.withColumn("entity", F.when(whole, F.sha2(F.concat_ws(keys.UNIT, *(keys.strip(F.col(p).cast("string")) for p in parts)), 256)))


def by_score(records: DataFrame, key: str, block: Column, text: str, least: float) -> DataFrame:
    """(a, b, score): pairs of records of one block whose texts are alike by edits (FUZZY_BLOCK_AND_SCORE).

    Equal texts are compared once: pairs are made between distinct texts of a block, and each other record links to the first of its text.
    Only texts that share one of their rarest two-letter pieces are compared: an edit changes two pieces at most, so alike texts must share
    some, and the first 2 * edits + 1 of each in any one order hold a shared one. Texts so short that edits may change all their pieces are all compared.
    """
    named = records.select(F.col(key).alias("id"), block.alias("block"), F.lower(F.col(text)).alias("t")).where("block is not null and t is not null")
    heads = named.groupBy("block", "t").agg(F.min("id").alias("head"))
    same = named.join(heads, ["block", "t"]).where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))
    x, y = heads.select("block", F.col("head").alias("a"), F.col("t").alias("ta")), heads.select("block", F.col("head").alias("b"), F.col("t").alias("tb"))
    longest = F.greatest(F.length("ta"), F.length("tb"))
    score = 1.0 - F.levenshtein("ta", "tb") / longest
    pieces = F.expr("array_sort(transform(sequence(1, length(t) - 1), i -> substring(t, i, 2)))")
    # equal pieces of a text are told apart by their number
    numbered = F.transform(pieces, lambda p, i: F.concat_ws("#", p, (i + 1 - F.array_position(pieces, p)).cast("string")))
    held = heads.where(F.length("t") > 1).select("block", "head", F.length("t").alias("n"), F.explode(numbered).alias("piece"))
    seen = Window.partitionBy("block", "piece")
    ranked = held.withColumn("seen", F.count("*").over(seen))
    edits = F.floor(F.col("n") * (1 - least) / least + 1e-9)
    order = F.row_number().over(Window.partitionBy("block", "head").orderBy("seen", "piece"))
    first = ranked.withColumn("place", order).where(F.col("place") <= 2 * edits + 1).select("block", "piece", "head")
    met = first.select("block", "piece", F.col("head").alias("a")).join(first.select("block", "piece", F.col("head").alias("b")), ["block", "piece"]).where("a < b").select("block", "a", "b").distinct()
    shorter = F.lit(float("inf")) if least <= 0.5 else F.lit(2 / (2 * least - 1))
    short = heads.where(F.length("t") < shorter + 1e-9).select("block", "head")
    small = short.select("block", F.col("head").alias("a")).join(short.select("block", F.col("head").alias("b")), "block").where("a < b")
    candidates = met.unionByName(small.select("block", "a", "b")).distinct()
    near = candidates.join(x, ["block", "a"]).join(y, ["block", "b"]).where(F.abs(F.length("ta") - F.length("tb")) <= longest * (1 - least) + 1e-9)
    pairs = near.withColumn("score", score).where(F.col("score") >= least).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score")
    return same.unionByName(pairs)


def shared_key_links(records: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """(a, b): records that share any of several keys, each linked to the first with that key (MULTI_KEY_UNION). A star for each value, never all pairs."""
    values = records.select(F.col(key).alias("b"), F.explode(F.array(*(F.struct(F.lit(p).alias("k"), F.col(p).cast("string").alias("v")) for p in parts))).alias("x"))
    named = values.select("b", "x.k", keys.strip(F.col("x.v")).alias("v")).where("v is not null and v <> ''")
    first = named.groupBy("k", "v").agg(F.min("b").alias("a"))
    return named.join(first, ["k", "v"]).where("a <> b").select("a", "b").distinct()


def closure(links: DataFrame) -> DataFrame:
    """(id, entity): the least id that links (a, b) reach, for ids with a link (GRAPH_CLOSURE, MULTI_KEY_UNION)."""
    return components(links).withColumnRenamed("component", "entity")
