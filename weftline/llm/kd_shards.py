"""Shards of near-equal size by a k-d tree over metadata, with DataFrame operations only.

The root holds all rows and the wanted number of leaves. A node with more than one leaf is cut across its widest
dimension at a weighted quantile, so that each side holds the bytes of its leaves. All nodes of a level are cut
together: grouped sums over ever finer cells of the node's ordering find the row at which the cut falls, so the driver
sees a few numbers for each node and rows are never gathered or sorted whole.

A dimension is an expression with values in [0, 2**20); ties are parted by a hash of the key and of the row's text, so
that any number of equal values can be cut. Widest: the largest weighted spread (standard deviation) in the node,
relative to the spread in the whole table; a node without any spread is cut by the hash alone.

Groups of equal texts are not kept together: ``tie`` hashes key and text, so documents with one text are parted wherever a cut
falls among them, and a group of any size is dealt to as many shards as its bytes need.

Defined cases: a null or empty text has 8 bytes of size; rows without a key are dealt by their text; null metadata counts as 0; rows that are equal in all columns
stay apart only by slot and may be cut together, so a shard misses its size by at most the largest group of equal rows;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, cut

LEAF_ROWS = 100_000  # rows that one task numbers together
_STEP = 10  # bits of the ordering that one pass looks at
_BITS = 50  # of the ordering: 20 of a dimension, 30 of the hash


def _of(values: list, node: Column) -> Column:
    """``values[node]``, as an array literal."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), node + 1)


def _cut_nodes(coded: DataFrame, goals: list[float]) -> list[int]:
    """For each node (0 to len(goals) - 1) the code at which its right side begins, so that the left one has about ``goals[node]`` bytes."""
    prefix, before, at = [0] * len(goals), [0] * len(goals), [0] * len(goals)
    for shift in range(_BITS - _STEP, -1, -_STEP):
        within = coded.where(F.shiftright("code", shift + _STEP) == _of(prefix, F.col("node")).cast("long"))
        cells = within.groupBy("node", F.shiftright("code", shift).alias("cell")).agg(F.sum("size").alias("size"))
        sums: list[list[tuple[int, int]]] = [[] for _ in goals]
        for r in cells.collect():  # at most 2**_STEP cells for each of the nodes
            sums[r["node"]].append((r["cell"], r["size"]))
        for node, goal in enumerate(goals):
            have = before[node]
            for cell, size in sorted(sums[node]):
                prefix[node], before[node] = cell, have
                have += size
                at[node] = cell if goal - before[node] <= have - goal else cell + 1
                if have > goal:
                    break
    return at


def kd_shards(docs: DataFrame, dimensions: list[Column], *, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot) for each row: sizes of the shards near equal, slots from 0 without gaps."""
    content = F.coalesce(F.col(text), F.lit(""))
    names = [f"d{i}" for i in range(len(dimensions))]
    table = docs.select(
        F.col(key).alias("key"), (F.octet_length(content) + 8).cast("long").alias("size"), F.crc32(content).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(11), content), 34).alias("tie"),
        *(F.coalesce(d.cast("long"), F.lit(0)).alias(n) for d, n in zip(dimensions, names)),
    )
    # node: its number among those of the level that are not leaves yet; leaves have -1 - shard
    steps = Steps(docs.sparkSession)
    stored = steps.cut(table, "metadata")
    rows = stored.withColumn("node", F.lit(0 if shards > 1 else -1))
    leaves, done = ([shards], 0) if shards > 1 else ([], 1)
    spread: list[float] | None = None
    while leaves:
        weight = F.col("size").cast("double")
        moments = [f for n in names for f in (F.sum(weight * F.col(n)).alias(f"m_{n}"), F.sum(weight * F.col(n) * F.col(n)).alias(f"s_{n}"))]
        found = {r["node"]: r for r in rows.where("node >= 0").groupBy("node").agg(F.sum("size").alias("size"), *moments).collect()}
        widest, goals = [0] * len(leaves), [0.0] * len(leaves)
        for node, r in sorted(found.items()):
            own = [max(0.0, r[f"s_{n}"] / r["size"] - (r[f"m_{n}"] / r["size"]) ** 2) ** 0.5 for n in names]
            spread = spread or own
            relative = [a / b if b else 0.0 for a, b in zip(own, spread)]
            widest[node] = relative.index(max(relative))
            goals[node] = r["size"] * (leaves[node] // 2) / leaves[node]
        dimension = F.element_at(F.array(*names), _of(widest, F.col("node")) + 1)
        code = F.when(F.col("node") >= 0, F.shiftleft(dimension, 30).bitwiseOR(F.col("tie")))
        coded = rows.select("*", code.alias("code"))
        at = _cut_nodes(coded.where("node >= 0").select("node", "size", "code"), goals)
        sides: list[list[int]] = [[], []]
        following: list[int] = []
        for k in leaves:
            for side, part in enumerate((k // 2, k - k // 2)):
                if part == 1:
                    done += 1
                    sides[side].append(-done)
                else:
                    sides[side].append(len(following))
                    following.append(part)
        split = F.when(F.col("code") < _of(at, F.col("node")).cast("long"), _of(sides[0], F.col("node"))).otherwise(_of(sides[1], F.col("node")))
        rows = steps.cut(coded.withColumn("node", F.when(F.col("node") >= 0, split).otherwise(F.col("node"))).drop("code"), "kd_level")
        steps.drop(stored)
        stored = rows
        leaves = following
    out = numbered(rows.select("key", "size", "text_crc32", "tie", (-1 - F.col("node")).cast("int").alias("shard"))).withColumnRenamed("key", key)
    steps.finish()
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """Slots within shards. Each shard is numbered in parts of about ``LEAF_ROWS`` rows, after the rows of the parts before."""
    rows = cut(rows, "sharded")
    parts = max(1, rows.count() // LEAF_ROWS)
    part = F.floor(F.col("tie") * parts / (1 << 30)).cast("long")
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("tie", "key")) - 1
    return rows.withColumn("own", own).join(before, ["shard", "part"]).select("key", "size", "text_crc32", "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"))
