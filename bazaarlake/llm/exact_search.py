"""Exact top-k by integer inner product: columnar branch and bound.

Vectors become integers. Candidates lie in blocks, each a matrix with one row
for each dimension (vertical layout), dimensions of much mass first. For one
query the products of a few dimensions at a time are added up; a candidate
whose sum and the most that its remaining mass may still bring, by
Cauchy-Schwarz, stay below what the query's k-th best has reached is dropped,
and the columns that survive are compacted before the next dimensions.

Queries meet the blocks in rounds of 1, 8, 64, ... blocks, so that each round
begins with the k-th best score of all blocks before it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, stored

_EXACT = 2.0**53
_LONG = (-(2**63), 2**63 - 1)


@dataclass(frozen=True)
class Settings:
    """``block_rows`` candidates and ``side_rows`` queries meet in one task; ``step`` dimensions are added at a time."""

    block_rows: int = 2048
    side_rows: int = 2048
    step: int = 8
    growth: int = 8


def integers(column: pa.Array, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, a row for each vector; vectors shorter than ``width`` go on with zeros.

    Doubles where each is exact, else Python integers.
    """
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if len(flat) and np.abs(flat).max() * scale >= _EXACT:
        out = np.zeros((len(sizes), width), dtype=object)
        out[row, at] = np.array([math.floor(x * scale) if abs(x) * scale < _EXACT else int(x) * int(scale) for x in flat.tolist()], dtype=object)
        return out
    out = np.zeros((len(sizes), width))
    out[row, at] = np.floor(flat * scale)
    return out


def survivors(query: np.ndarray, block: np.ndarray, query_rest: np.ndarray, block_rest: np.ndarray, steps: list[slice], begun: np.ndarray, floor: float, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, scores) of one query: all that may be among its ``keep`` best, and none below ``floor``.

    ``block`` has a row for each dimension; ``begun`` are the products of the
    first step. ``block_rest[s]`` and ``query_rest[s]`` are the lengths of what
    remains after step ``s``.
    """
    alive, acc = None, begun
    for s in range(len(steps)):
        if s:
            acc = acc + query[steps[s]] @ block[steps[s]]
        if s + 1 == len(steps):
            break
        rest = query_rest[s] * (block_rest[s] if alive is None else block_rest[s][alive])
        if len(acc) > keep:  # what these are sure to reach raises the floor
            floor = max(floor, math.floor(np.partition(acc - rest, len(acc) - keep)[len(acc) - keep]))
        hit = np.flatnonzero(acc + rest > floor - 0.5)
        if len(hit) < 0.7 * len(acc):  # compact: later steps read the surviving columns only
            alive = hit if alive is None else alive[hit]
            acc, block = acc[hit], block[:, hit]
    alive = np.arange(len(acc)) if alive is None else alive
    hit = np.flatnonzero(acc >= floor)
    return alive[hit], acc[hit]


def _block_best(names, queries, floors, ids, vectors, order, step: int, keep: int):
    """(query, id, score) of each query's ``keep`` best in a block, equal scores by the smaller id; scores below its floor are left out."""
    out: list[list] = [[], [], []]

    def put(q: int, found: np.ndarray, scores: np.ndarray) -> None:
        best = np.lexsort((ids[found], -scores))
        best = best[ids[found][best] != names[q]][:keep]
        out[0].append(np.full(len(best), names[q]))
        out[1].append(ids[found][best])
        out[2].append(scores[best].astype(np.int64))

    largest = np.abs(queries).max(initial=1) * np.abs(vectors).max(initial=1) * max(queries.shape[1], 1)
    if queries.dtype == object or vectors.dtype == object or largest >= _EXACT:
        whole = vectors.astype(object).T if vectors.dtype == object else np.array([[int(v) for v in row] for row in vectors.tolist()], dtype=object).T
        for q in range(len(queries)):
            scores = np.array([min(max(int(v), _LONG[0]), _LONG[1]) for v in np.array([int(v) for v in queries[q]], dtype=object) @ whole], dtype=np.int64)
            found = np.flatnonzero(scores >= floors[q])
            best = found[np.lexsort((ids[found], ~scores[found]))]  # ~x falls as x rises and, unlike -x, never overflows
            put_ids = best[ids[best] != names[q]][:keep]
            out[0].append(np.full(len(put_ids), names[q]))
            out[1].append(ids[put_ids])
            out[2].append(scores[put_ids])
        return [np.concatenate(c) for c in out]
    block, queries = np.ascontiguousarray(vectors[:, order].T), np.ascontiguousarray(queries[:, order])
    width = len(order)
    steps = [slice(a, min(a + step, width)) for a in range(0, width, step)] or [slice(0, 0)]
    ends = [s.stop for s in steps]
    # Lengths of what remains after each step, a little above so that rounding never drops a candidate.
    block_rest = [np.sqrt((block[e:] ** 2).sum(axis=0)) * (1 + 1e-9) for e in ends]
    query_rest = np.stack([np.sqrt((queries[:, e:] ** 2).sum(axis=1)) * (1 + 1e-9) for e in ends], axis=1)
    for a in range(0, len(queries), 128):
        begun = queries[a : a + 128, steps[0]] @ block[steps[0]]
        for q in range(a, min(a + 128, len(queries))):
            # One more than asked for: the query's own row may be among them.
            put(q, *survivors(queries[q], block, query_rest[q], block_rest, steps, begun[q - a], floors[q], keep + 1))
    return [np.concatenate(c) for c in out]


def exact_top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, top: int = 20, scale: int = 64, settings: Settings | None = None) -> DataFrame:
    """The ``top`` highest scores of each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id ``every`` divides; candidates are all rows but
    the query's own. A score is the inner product of floor(``scale`` * x) of
    the components, ties go to the smaller id; scores beyond the range of a
    long are cut to it. Vectors that are null or hold a null or non-finite
    component take no part, nor do rows without an id. A shorter vector goes on
    with zeros, an empty one scores 0. Rows that repeat an id are one row, with
    its smallest vector. With fewer candidates than ``top`` all are returned;
    an empty table gives an empty result. Other columns are ignored.
    """
    s = settings or Settings()
    spark, kind = vectors.sparkSession, "query_id long, vec_id long, score long"
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    src = stored(src.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine).groupBy("id").agg(F.min("v").alias("v")), "exact-vectors")
    sized = src.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("q"), F.max(F.size("v")).alias("width")).first()
    if not sized.q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks, sides, width = -(-sized.n // s.block_rows), -(-sized.q // s.side_rows), sized.width
    mass = src.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x") * F.col("x")).alias("mass"))
    order = np.array([r.at for r in mass.orderBy(F.desc("mass"), "at").collect()], dtype=np.int64)  # as many as dimensions

    hashed = F.xxhash64("id")
    filed = src.withColumn("block", F.pmod(hashed, F.lit(blocks)).cast("int"))
    asked = src.where(F.col("id") % every == 0).withColumn("side", F.pmod(hashed, F.lit(sides)).cast("int"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def meet(left, right):
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            names, floors = (left.column(c).to_numpy() for c in ("asked", "floor"))
            asking, held = (integers(t.column(c).combine_chunks(), width, scale) for t, c in ((left, "query"), (right, "v")))
            out = _block_best(names, asking, floors, right.column("id").to_numpy(), held, order, s.step, top)
            give_back()
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out)})

    best, begin, many = spark.createDataFrame([], kind), 0, 1
    while begin < blocks:
        end = min(blocks, begin + many)
        floors = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        floors = floors.select("query_id", F.when(F.col("n") >= top, F.col("least")).alias("floor"))
        queries = asked.join(floors, F.col("id") == F.col("query_id"), "left").select("side", F.col("id").alias("asked"), F.col("v").alias("query"), F.coalesce("floor", F.lit(_LONG[0])).alias("floor"))
        queries = queries.withColumn("block", F.explode(F.sequence(F.lit(begin), F.lit(end - 1))))
        some = filed.where(F.col("block").between(begin, end - 1)).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
        found = queries.groupBy("side", "block").cogroup(some.groupBy("side", "block")).applyInArrow(meet, kind)
        ranked = best.unionByName(found).withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)
        best = stored(ranked.drop("rank"), "exact-best")
        begin, many = end, many * s.growth
    return best.withColumn("rank", F.row_number().over(last)).select("query_id", "rank", "vec_id", "score")
