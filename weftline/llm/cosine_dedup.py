"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside them, one representative of each group.

Vectors are compared only inside a partition (the label). A partition of more than ``CELL`` vectors gets cells by spherical k-means, fitted on a
bounded sample of it; every vector is then placed. Cells that are still large are divided in the same way, so the number of cells grows with the vectors.
A pair may lie on two sides of a border, so a vector is also a guest in those cells of lower number where a partner can be: with the cosine s, partners are at most sqrt(2 - 2 s) apart, so a
guest must be that near to the border between its own cell and the visited one, and its angle to the visited centre at
most acos(s) more than that cell's widest. Guests of a cell that is divided are guests of its parts by the same bounds. No pair is missed, then, whatever the cells are; how many visits there are
depends on how far the vectors form clusters.

Vectors meet the centres of their partition in tasks of about ``CHUNK`` vectors, so nothing is sent to all tasks or gathered on the driver.
Cells are parted into blocks of about ``BLOCK`` vectors and a task sees two blocks, so hot cells are many tasks. A pair of
blocks gives one row for each vector with links: how many, and the least vector that it reaches there. Pairs are never
written out. Equal vectors are one, with a count.

Defined cases: null labels and vectors that are null, zero or hold null or non-finite components link with nothing, and
are kept; vectors of unequal length are compared as if filled up with zeros; each row counts as one vector, and rows of one id share
their links; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.connect import components

from .common import Steps
from .vectors import matrix, packed, unpacked

SIMILARITY = 0.93
CELL = 2048  # vectors of a partition for one cell
SPLIT = 256  # cells that a partition is divided into at once
LEVELS = 4  # divisions, one after the other; whatever is still large then is compared block by block
SAMPLE = 32  # vectors for each cell that k-means is fitted on
ROUNDS = 8
BLOCK = 1024
CHUNK = 8192  # vectors that meet their centres in one task

_UNIT = 1e-9  # slack of the bounds against rounding


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, part, vec): the vectors that can link, scaled to length 1."""
    for batch in batches:
        x, good = matrix(batch.column(2))
        top = np.abs(x).max(1) if x.shape[1] else np.zeros(len(x))
        good &= (top > 0) & np.asarray(batch.column(1).is_valid()) & np.asarray(batch.column(0).is_valid())
        x = x[good] / top[good][:, None]
        x /= np.sqrt((x * x).sum(1))[:, None]
        keep = pa.array(good)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), packed(x)], ["id", "part", "vec"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centres of length 1 for the unit rows of ``x``; the rows' order decides the first ones."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = (x @ centres.T).argmax(1)
        order = np.argsort(home, kind="stable")
        first = np.flatnonzero(np.diff(home[order], prepend=-1))
        sums = np.add.reduceat(x[order], first, axis=0)
        size = np.sqrt((sums * sums).sum(1))
        full = home[order][first][size > 0]
        centres[full] = (sums / np.where(size, size, 1)[:, None])[size > 0]
    return np.unique(centres, axis=0)


def _fit(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("order", "ascending"), ("node", "ascending")])
    x = unpacked(rows.column("vec"))
    k = min(rows.column("cells")[0].as_py(), len(x))
    centres = spherical_kmeans(np.ascontiguousarray(x), k)
    part = rows.column("part").slice(0, 1).combine_chunks()
    return pa.table({"part": part.take(pa.array(np.zeros(len(centres), np.int64))), "cell": pa.array(np.arange(len(centres)), pa.int32()), "centre": packed(centres)})


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


_ROW = "node long, part string, times long, vec binary"


def _columns(rows: pa.Table, centres: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, centres of the same width, their radii), cells in order."""
    centres = centres.sort_by("cell")
    x, c = unpacked(rows.column("vec")), unpacked(centres.column("centre"))
    width = max(x.shape[1], c.shape[1])
    return _wide(x, width), _wide(c, width), np.asarray(centres.column("radius"))


def _place(_, rows: pa.Table, centres: pa.Table) -> pa.Table:
    """(node, part, times, vec, home, angle) of hosts."""
    rows = rows.select(["node", "part", "times", "vec"])
    home, angle = np.zeros(rows.num_rows, np.int32), np.zeros(rows.num_rows)
    if rows.num_rows:
        x, c, _ = _columns(rows, centres)
        near = x @ c.T
        home, angle = near.argmax(1).astype(np.int32), np.arccos(np.clip(near.max(1), -1, 1))
    return rows.append_column("home", pa.array(home)).append_column("angle", pa.array(angle))


def _visit(similarity: float):
    reach, theta = math.sqrt(2 - 2 * similarity) + _UNIT, math.acos(similarity) + 1e-7

    def run(_, rows: pa.Table, centres: pa.Table) -> pa.Table:
        """(node, part, times, vec, cell) for each cell in which a row is a guest; rows with a home are hosts of that cell."""
        at, cell = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if rows.num_rows and centres.num_rows:
            x, c, radius = _columns(rows, centres)
            home = np.asarray(rows.column("home"))
            near = x @ c.T
            own = np.where(home < 0, near.argmax(1), home)
            gap = near[np.arange(len(x)), own][:, None] - near
            between = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))[own]
            may = (gap <= reach * between + _UNIT) & (np.arccos(np.clip(near, -1, 1)) <= radius[None, :] + theta)
            may &= (home < 0)[:, None] | (np.arange(len(c)) < own[:, None])
            at, cell = np.nonzero(may)
        return rows.select(["node", "part", "times", "vec"]).take(pa.array(at)).append_column("cell", pa.array(cell.astype(np.int32)))

    return run


def _least(links: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name that each row reaches over the links (a square of booleans)."""
    low = names.copy()
    while True:
        new = np.minimum(low, np.where(links, low[None, :], np.iinfo(np.int64).max).min(1))
        if (new == low).all():
            return low
        low = new


def _compare(similarity: float):
    def run(rows: pa.Table) -> pa.Table:
        """(node, links, least) for the vectors with links between the two blocks of a group (or in its one block)."""
        second = np.asarray(rows.column("second"))
        node, times = np.asarray(rows.column("node")), np.asarray(rows.column("times"))
        alone = rows.column("i")[0] == rows.column("j")[0]
        if not alone and (second.all() or not second.any()):  # the other block has no rows
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
        x = unpacked(rows.column("vec"))
        if alone:
            square, names = x @ x.T >= similarity, node
            np.fill_diagonal(square, False)
        else:
            one, two = np.flatnonzero(~second), np.flatnonzero(second)
            near = x[one] @ x[two].T >= similarity
            names, times = node[np.concatenate((one, two))], times[np.concatenate((one, two))]
            square = np.zeros((len(names), len(names)), bool)
            square[: len(one), len(one) :] = near
            square[len(one) :, : len(one)] = near.T
        has = square.any(1)
        counts = square[has].astype(np.float64) @ times
        names, square = names[has], square[np.ix_(has, has)]
        least = _least(square, names) if len(names) else names
        return pa.table({"node": pa.array(names, pa.int64()), "links": pa.array(counts.astype(np.int64)), "least": pa.array(least, pa.int64())})

    return run


def _block(count, n: int = BLOCK):
    return F.pmod(F.xxhash64("node", F.lit(5)), F.greatest(F.lit(1), F.ceil(count / n))).cast("int")


def _divided(steps: Steps, rows: DataFrame, large: DataFrame, similarity: float) -> DataFrame:
    """The rows (node, part, times, vec, guest) of the parts in ``large`` (part, n, chunks, cells), in the cells of these parts."""
    columns = ["node", "part", "times", "vec"]
    dealt = rows.join(large, "part").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(4)), "chunks").cast("int"))
    odds = F.lit(float(SAMPLE)) * F.col("cells") / F.col("n") * (1 << 20)
    sample = dealt.where("not guest").withColumn("order", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 20))).where(F.col("order") < odds + 1)
    fitted = sample.select("node", "part", "vec", "cells", "order").groupBy("part").applyInArrow(_fit, "part string, cell int, centre binary")
    centres = steps.cut(fitted, "centres")

    def met(some: DataFrame, table: DataFrame, f, schema: str) -> DataFrame:
        each = table.join(large.select("part", "chunks"), "part").select("part", "cell", "centre", "radius", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        return some.groupBy("part", "chunk").cogroup(each.groupBy("part", "chunk")).applyInArrow(f, schema)

    placed = steps.cut(met(dealt.where("not guest"), centres.withColumn("radius", F.lit(0.0)), _place, f"{_ROW}, home int, angle double"), "placed")
    cells = placed.groupBy("part", F.col("home").alias("cell")).agg(F.max("angle").alias("radius"))
    bounded = steps.cut(centres.join(cells, ["part", "cell"], "left").withColumn("radius", F.coalesce("radius", F.lit(float("-inf")))), "bounded")
    chunk = F.pmod(F.xxhash64("node", F.lit(4)), "chunks").cast("int").alias("chunk")
    hosts = placed.join(large.select("part", "chunks"), "part").select(*columns, chunk, "home")
    guests = dealt.where("guest").select(*columns, "chunk", F.lit(-1).alias("home"))
    visits = met(hosts.unionByName(guests), bounded, _visit(similarity), f"{_ROW}, cell int")
    inner = lambda cell: F.concat_ws("/", "part", cell).alias("part")
    stay = placed.select("node", inner("home"), "times", "vec", F.lit(False).alias("guest"))
    return steps.cut(stay.unionByName(visits.select("node", inner("cell"), "times", "vec", F.lit(True).alias("guest"))), "divided")


def near_links(steps: Steps, units: DataFrame, similarity: float) -> DataFrame:
    """(node, links, least) rows from all pairs of blocks; ``units``: node, part, times, vec."""
    rows, done = units.withColumn("guest", F.lit(False)), None
    for _ in range(LEVELS):
        sizes = rows.groupBy("part").agg(F.count_if(~F.col("guest")).alias("n"), F.count("*").alias("all")).where(F.col("n") > CELL)
        cells = F.least(F.lit(SPLIT), F.ceil(F.col("n") / CELL)).cast("int").alias("cells")
        large = steps.cut(sizes.select("part", "n", F.ceil(F.col("all") / CHUNK).cast("int").alias("chunks"), cells), "large_parts")
        if large.isEmpty():
            break
        small = rows.join(large.select("part"), "part", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = _divided(steps, rows, large, similarity)
    rows = rows if done is None else done.unionByName(rows)

    sizes = steps.cut(rows.groupBy("part").agg(F.count_if(~F.col("guest")).alias("n"), F.count_if("guest").alias("guests")), "sizes")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    home = rows.where("not guest").join(sizes, "part").withColumn("block", _block(F.col("n")))
    key = ["part", "i", "j"]
    taken = [*key, "second", "node", "times", "vec"]
    upto, below = F.sequence(F.col("block"), blocks - 1), F.when(F.col("block") > 0, F.sequence(F.lit(0), F.col("block") - 1)).otherwise(F.array().cast("array<int>"))
    first = home.select("*", F.explode(upto).alias("j")).withColumn("i", F.col("block")).withColumn("second", F.lit(False)).select(*taken)
    other = home.select("*", F.explode(below).alias("i")).withColumn("j", F.col("block")).withColumn("second", F.lit(True)).select(*taken)
    sides = first.unionByName(other)
    if done is not None:
        came = rows.where("guest").join(sizes, "part").withColumn("block", _block(F.col("guests")))
        came = came.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i")).withColumn("j", -1 - F.col("block")).withColumn("second", F.lit(True)).select(*taken)
        hosts = home.where("guests > 0").withColumn("i", F.col("block"))
        hosts = hosts.select("*", F.explode(F.sequence(F.lit(1), F.ceil(F.col("guests") / BLOCK).cast("int"))).alias("g")).withColumn("j", -F.col("g")).withColumn("second", F.lit(False)).select(*taken)
        sides = sides.unionByName(came).unionByName(hosts)
    return sides.groupBy(*key).applyInArrow(_compare(similarity), "node long, links long, least long")


def cosine_components(table: DataFrame, *, key: str = "vec_id", vector: str = "embedding", partition: str = "label", similarity: float = SIMILARITY) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``table``."""
    steps = Steps(table.sparkSession)
    part = F.col(partition)
    part = (part + 0.0 if table.schema[partition].dataType.simpleString() in ("float", "double") else part).cast("string")  # 0.0 and -0.0 are equal
    rows = table.select(F.col(key).cast("long").alias("id"), part.alias("part"), F.col(vector).alias("vec"))
    units = steps.cut(rows.mapInArrow(_units, "id long, part string, vec binary"), "units")
    same = units.groupBy("part", "vec").agg(F.min("id").alias("node"), F.count("*").alias("times"))
    same = steps.cut(same, "distinct_vectors")
    found = steps.cut(near_links(steps, same.select("node", "part", "times", "vec"), similarity), "links")

    members = units.join(same.where("times > 1"), ["part", "vec"]).select("id", "node", "times")
    counts = found.select("node", F.col("links").alias("n")).unionByName(same.where("times > 1").select("node", (F.col("times") - 1).alias("n")))
    counts = counts.groupBy("node").agg(F.sum("n").alias("links"))
    pairs = found.select(F.col("node").alias("a"), F.col("least").alias("b")).unionByName(members.select(F.col("id").alias("a"), F.col("node").alias("b")))
    groups = steps.cut(components(pairs, steps=steps), "groups")
    # what each id gets: its node's links; ids without any row here have none
    own = members.select("id", "node").distinct()
    ids = counts.select(F.col("node").alias("id"), "node").unionByName(own).distinct()
    linked = steps.cut(ids.join(counts, "node").groupBy("id").agg(F.max("links").alias("links")), "linked")
    steps.finish(linked, groups)
    out = table.select(F.col(key)).join(linked, F.col(key).cast("long") == linked.id, "left").drop("id").join(groups, F.col(key).cast("long") == groups.id, "left")
    component = F.coalesce("component", F.col(key).cast("long"))
    return out.select(key, F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (component == F.col(key)).alias("kept"))
