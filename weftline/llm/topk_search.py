"""Exact top-k search by inner product: columnar branch and bound.

Candidates lie in groups of rows, vertically: one row of a matrix for each dimension. For a query, inner products are
added up block by block of dimensions. After each block, a candidate can gain at most |q'| * |x'| from the dimensions left
(their remaining mass, by Cauchy and Schwarz); candidates that cannot reach the best k so far are dropped, and the others are
compacted. The order of the dimensions is by their mass over the whole group, largest first, so that bounds get tight early.

Queries meet candidates in tasks of one group of queries and one group of candidates. Before, all queries search one first
group of candidates; their k-th scores there are lower bounds that go with them, so the other groups return few rows.
No task holds more than one group of either side, and nothing is collected.

Components are whole numbers (floor of ``scale`` times the value), and scores are exact. Sums beyond 2**52 are rounded in float64, so the sums have more bits,
bounds are widened by the rounding, and the candidates that are left are scored again with whole numbers of any size.

Defined cases: vectors that are null or hold null or non-finite components, also after scaling, take no part, nor do rows without an id; missing components of shorter
vectors count as 0; each row is a query or candidate of its own, also where rows share an id; scores beyond a long are given as its largest value, or that with a minus, and
rank as such; ties go to the smaller id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import matrix, packed, unpacked

GROUP = 8192  # candidates that are searched together
QUERIES = 2048  # queries of a task
DIMENSIONS = 8  # of a block
_SAFE = 1 << 52  # sums below are exact in float64
_MOST = (1 << 63) - 1  # of a long


def _whole(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, asks, vec): floor(scale * x) as bytes of float64, which holds these whole numbers exactly."""
        for batch in batches:
            x, good = matrix(batch.column(2))
            good &= np.asarray(batch.column(0).is_valid())
            with np.errstate(over="ignore"):
                whole = np.floor(scale * x)
            good &= np.isfinite(whole).all(1)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), packed(whole[good])], ["id", "asks", "vec"])

    return run


def best_products(queries: np.ndarray, candidates: np.ndarray, k: int, own: np.ndarray, floor: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``queries`` the (positions, scores) of its best k rows of ``candidates``, best first, ties to smaller ``ids``.

    own: the row (of ``rows``, or of ``ids``) that a query must not return; floor: a score that its results must reach (-inf for none).
    """
    rows = ids if rows is None else rows
    width = max(queries.shape[1], candidates.shape[1])
    exact_q = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    exact_x = np.pad(candidates, ((0, 0), (0, width - candidates.shape[1])))
    with np.errstate(over="ignore"):
        safe = np.abs(exact_q).max(initial=0) * np.abs(exact_x).max(initial=0) * max(1, width) < _SAFE
    q, x = (exact_q, exact_x) if safe else (exact_q.astype(np.longdouble), exact_x.astype(np.longdouble))  # whose squares stay in range
    mass = (x * x).sum(0)
    order = np.argsort(-mass, kind="stable")
    vertical = np.ascontiguousarray(x.T[order])
    q = q[:, order]
    starts = [*range(0, width, DIMENSIONS)]
    steps = [0, *starts[1:], width] if width else [0]
    left_x = np.sqrt(np.array([(vertical[s:] ** 2).sum(0) for s in steps]))
    left_q = np.sqrt(np.array([(q[:, s:] ** 2).sum(1) for s in steps]))
    rounding = 0.0 if safe else (width + 2) * 2.0**-50
    most = np.inf if safe else 0.99 * 2.0**63  # beyond this scores may be given as one
    out = []
    for lo in range(0, len(q), 256):
        some = q[lo : lo + 256]
        head = some[:, :DIMENSIONS] @ vertical[:DIMENSIONS] if width else np.zeros((len(some), len(x)))
        for i in range(len(some)):
            lowest = floor[lo + i] if abs(floor[lo + i]) < 1 << 53 else np.nextafter(floor[lo + i], -np.inf)
            alive = np.flatnonzero(rows != own[lo + i])
            score, limit = head[i][alive], lowest

            def pruned(room, limit, score, alive, tighten):
                """The candidates that can still be among the best, and the score that these must reach."""
                room = room + rounding * left_x[0][alive] * left_q[0, lo + i]
                if tighten and len(score) > k:  # what k of them reach at least
                    limit = max(limit, np.partition(score - room, len(score) - k)[len(score) - k])
                limit = -np.inf if limit <= -most else min(limit, most)
                keep = score + room >= limit - 1e-6 * (1 + abs(limit)) if np.isfinite(limit) else np.ones(len(score), bool)
                return limit, score[keep], alive[keep]

            for b, s in enumerate(starts):
                if b:
                    score = score + some[i, s : s + DIMENSIONS] @ vertical[s : s + DIMENSIONS, alive]
                if b < len(starts) - 1:
                    limit, score, alive = pruned(left_x[b + 1][alive] * left_q[b + 1, lo + i], limit, score, alive, b % 2 == 0)
            if not safe:
                _, score, alive = pruned(0.0, limit, score, alive, True)
                mine = [int(v) for v in exact_q[lo + i]]
                score = np.array([max(-_MOST, min(_MOST, sum(a * int(b) for a, b in zip(mine, exact_x[j])))) for j in alive], np.int64)
            out.append(_ranked(score, alive, k, lowest, ids, rows))
    return out


def _ranked(score: np.ndarray, alive: np.ndarray, k: int, floor: float, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = score >= floor
    score, alive = score[keep], alive[keep]
    if len(score) > k:
        near = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, alive = score[near], alive[near]
    best = np.lexsort((rows[alive], ids[alive], -score))[:k]
    return alive[best], score[best]


_HITS = ["query", "query_id", "row", "id", "score"]


def _search(k: int):
    def run(_, queries: pa.Table, candidates: pa.Table) -> pa.Table:
        hits = {c: np.zeros(0, np.int64) for c in _HITS}
        if queries.num_rows and candidates.num_rows:
            query, row, ids = np.asarray(queries.column("query")), np.asarray(candidates.column("row")), np.asarray(candidates.column("id"))
            floor = np.asarray(queries.column("floor").combine_chunks().cast(pa.float64()).fill_null(-np.inf))
            found = best_products(unpacked(queries.column("asked")), unpacked(candidates.column("vec")), k, query, floor, ids, row)
            at, each = np.concatenate([a for a, _ in found]), [len(a) for a, _ in found]
            hits = {"query": np.repeat(query, each), "query_id": np.repeat(np.asarray(queries.column("query_id")), each), "row": row[at], "id": ids[at]}
            hits["score"] = np.concatenate([s for _, s in found]).astype(np.int64)
        return pa.table(hits)

    return run


def top_products(table: DataFrame, is_query: Column, *, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, key, score): the k rows with the highest scores for each row of ``table`` where ``is_query`` holds."""
    rows = table.select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector).alias("vec"))
    whole = cut(rows.mapInArrow(_whole(scale), "id long, asks boolean, vec binary").withColumn("row", F.monotonically_increasing_id()), "whole")
    n, asked = whole.agg(F.count("*"), F.count_if("asks")).first()
    groups, parts = max(1, -(-n // GROUP)), max(1, -(-asked // QUERIES))
    part = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int")
    queries = whole.where("asks").select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("vec").alias("asked"), part.alias("part"))
    found = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(groups)).cast("int")
    candidates = whole.select("row", "id", "vec", found.alias("group")).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def hits(q: DataFrame, c: DataFrame) -> DataFrame:
        return q.groupBy("group", "part").cogroup(c.groupBy("group", "part")).applyInArrow(_search(k), ", ".join(f"{c} long" for c in _HITS))

    first = cut(hits(queries.select("*", F.lit(0).alias("group"), F.lit(None).cast("double").alias("floor")), candidates.where("group = 0")), "first_hits")
    results = first
    if groups > 1:
        bound = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
        bounded = queries.join(bound, "query", "left").select("query", "query_id", "asked", "part", F.col("least").cast("double").alias("floor"))
        more = bounded.select("*", F.explode(F.sequence(F.lit(1), F.lit(groups - 1))).alias("group"))
        results = results.unionByName(hits(more, candidates.where("group > 0")))
    ranked = results.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
