"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sources.staging import Steps

#: Arcs of one node that a task should get at most. Larger tables are dealt out so that a node with very many arcs is many keys.
ARCS = 1_000_000

#: Arcs that one task settles at once (16 bytes each); larger tables go in rounds.
SMALL = 100_000

#: Far more than alternating stars need for any graph (they grow with the logarithm of its longest chain); reaching it is an error.
MOST_ROUNDS = 200


def _least_joined(arcs: DataFrame, n: int) -> DataFrame:
    """Arcs (u, v) with ``m``: for each node u the least of its neighbours and itself.

    A table of more than ``ARCS`` arcs is dealt by u and some bits of v, so that the centre of a large star is no hot key: least
    values are taken for each part, then over a node's parts, and go back to these parts.
    """
    parts = min(4096, -(-n // ARCS))
    if parts == 1:
        return arcs.join(arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "u")
    dealt = arcs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(parts)).cast("int"))
    each = dealt.groupBy("u", "part").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    whole = each.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("part").alias("ps"))  # at most ``parts`` rows a node
    return dealt.join(whole.select("u", "m", F.explode("ps").alias("part")), ["u", "part"]).select("u", "v", "m")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, component) of a small table of arcs."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            if a != b:
                root[max(a, b)] = min(a, b)
    if kind is not None:
        ids = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([find(x) for x in ids], kind)], ["id", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", steps: Steps | None = None) -> DataFrame:
    """(id, component) for each node with an edge to another one; component: the least id that can be reached.

    Alternating stars: first each node links its larger neighbours, then its smaller ones and itself, to the least id among its
    neighbours and its own. Roots are hooked too, so rounds grow with the logarithm of the longest chain. They end when only stars
    are left. Each round is a few joins and grouped minima on the edge table and ends in a table in the shared folder. At most ``SMALL``
    arcs are settled by one task instead.
    Null ends and loops are left out; an empty table gives none. ``steps``: of the job that this is a part of, which removes the tables at its end.
    """
    steps = steps or Steps(edges.sparkSession)
    arcs = steps.cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "arcs")
    if arcs.count() <= SMALL:
        kind = arcs.schema["u"].dataType.simpleString()
        return arcs.coalesce(1).mapInArrow(_settled, f"id {kind}, component {kind}")
    for _ in range(MOST_ROUNDS):
        ends = arcs.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(arcs.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        n, left = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 1 or (up > 0 and down > 0)"))).first()
        if not left:
            break
        large = _least_joined(arcs.union(arcs.select("v", "u")), 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = _least_joined(large, n)
        small = steps.cut(low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct(), "arcs")
        steps.drop(arcs)
        arcs = small
    else:
        raise RuntimeError(f"the components are not settled after {MOST_ROUNDS} rounds")
    return arcs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(arcs.select("v", "v").distinct())
