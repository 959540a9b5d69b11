"""Approximate nearest neighbours by learned partitions.

A bounded sample of vectors gives a neighbour graph. The graph is cut into
balanced parts, and a softmax classifier learns to tell a vector's part. It
then files every vector under its few most probable parts, and sends a query to
its several most probable parts, whose vectors are ranked by exact inner
product. How many parts a query visits is chosen on the sample, where the true
neighbours are known. Equal vectors are one entry with their smallest ids.

Where the sample cannot tell as many parts as the vectors need, each part is
cut in the same way once more, by a sample of its own.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, sampled, stored, trimmed


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the vectors that a graph and its classifier are fitted on; every vector is indexed.

    A vector is filed under at most ``copies`` parts, as many as leave queries
    the fewest vectors to rank; ``recall`` is what the visits of a query must
    reach on the sample.
    """

    sample: int = 4000
    part_rows: int = 600
    most_parts: int = 200
    copies: int = 3
    neighbours: int = 12
    recall: float = 0.9
    block_rows: int = 4000
    seed: int = 11


@dataclass(frozen=True)
class Router:
    """The classifier of one level; ``children`` by part, where parts are cut again."""

    weights: np.ndarray
    bias: np.ndarray
    probes: int
    copies: int = 1
    children: tuple[Router | None, ...] = ()

    @property
    def parts(self) -> int:
        return len(self.bias)

    @property
    def share(self) -> float:
        """About which share of the vectors a query ranks."""
        below = [c.share for c in self.children if c]
        return min(1.0, self.copies * self.probes / self.parts) * (sum(below) / len(below) if below else 1.0)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first."""
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        return np.argsort(-(unit @ self.weights + self.bias), axis=1, kind="stable")

    def leaves(self, x: np.ndarray, visits: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, turn) of where each vector is filed, or of what a query visits; turn 0 is its most probable leaf."""
        order = self.ranked(x)[:, : self.probes if visits else self.copies]
        row, part = np.repeat(np.arange(len(x)), order.shape[1]), order.ravel()
        turn = np.tile(np.arange(order.shape[1]), len(x))
        if not self.children:
            return row, part, turn
        width = max(c.parts for c in self.children if c) + 1
        out = []
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            child = self.children[p]
            r, leaf, t = child.leaves(x[row[at]], visits) if child else (np.arange(len(at)), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64))
            out.append((row[at[r]], p * width + leaf, turn[at[r]] * width + t))
        return tuple(np.concatenate(c) for c in zip(*out))


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """A part for each node: balanced k-means gives a start, then nodes move to where most of their neighbours are.

    No part exceeds its fair share by more than a tenth.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    room = math.ceil(1.1 * n / parts)
    centres = x[rng.choice(n, parts, replace=False)]
    for _ in range(8):
        likes = x @ centres.T
        part, sizes = np.full(n, -1), np.zeros(parts, dtype=np.int64)
        for i in np.argsort(-likes.max(axis=1)):
            for p in np.argsort(-likes[i]):
                if sizes[p] < room:
                    part[i], sizes[p] = p, sizes[p] + 1
                    break
        for p in range(parts):
            if sizes[p]:
                c = x[part == p].sum(axis=0)
                centres[p] = c / max(np.linalg.norm(c), 1e-30)
    for _ in range(6):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[graph[i]], minlength=parts)
            p = int(votes.argmax())
            if votes[p] > votes[part[i]] and sizes[p] < room:
                sizes[part[i]] -= 1
                sizes[p] += 1
                part[i] = p
                moved += 1
        if not moved:
            break
    return part


def train_router(sample: np.ndarray, total: int, top: int, s: Settings) -> Router:
    """Neighbour graph, balanced parts, classifier, and the number of parts to visit for ``s.recall`` on the sample."""
    n = len(sample)
    x = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-30)
    parts = int(min(s.most_parts, max(1, total // s.part_rows), max(1, n // 20)))
    if parts == 1:
        return Router(np.zeros((sample.shape[1], 1)), np.zeros(1), 1)
    k = min(s.neighbours, n - 1)
    graph = np.empty((n, k), dtype=np.int64)
    for a in range(0, n, 500):
        likes = x[a : a + 500] @ x.T
        likes[np.arange(len(likes)), np.arange(a, a + len(likes))] = -np.inf
        graph[a : a + 500] = np.argpartition(-likes, k - 1, axis=1)[:, :k]
    part = balanced_parts(graph, x, parts, s.seed)
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    target = np.eye(parts)[part]
    mw, mb, vw, vb = np.zeros_like(w), np.zeros_like(b), np.zeros_like(w), np.zeros_like(b)
    for step in range(1, 301):  # Adam on the full sample
        z = x @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - target) / n
        gw, gb = x.T @ g + 1e-5 * w, g.sum(axis=0)
        mw, mb, vw, vb = 0.9 * mw + 0.1 * gw, 0.9 * mb + 0.1 * gb, 0.99 * vw + 0.01 * gw**2, 0.99 * vb + 0.01 * gb**2
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.3 * (mw / c1) / (np.sqrt(vw / c2) + 1e-9)
        b -= 0.3 * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    order = Router(w, b, parts).ranked(sample)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(n, axis=0), axis=1)
    # Visits needed until a vector's sample neighbours are found: judged on as many neighbours as the search returns.
    asked = np.random.default_rng(s.seed).choice(n, min(n, 1000), replace=False)
    likes = sample[asked] @ sample.T
    likes[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-likes, min(top, n - 1) - 1, axis=1)[:, : min(top, n - 1)]
    # Neighbours among all vectors are nearer than those in a sample and found sooner; the larger the sample's share, the more is asked.
    aim = min(1.0, s.recall + 0.04 * min(1.0, n / total))
    ways = []
    for copies in range(1, min(s.copies, parts) + 1):
        need = np.min([place[asked[:, None], order[near, c]] for c in range(copies)], axis=0)
        found = np.cumsum(np.bincount(need.ravel(), minlength=parts)) / need.size
        probes = int(np.argmax(found >= aim - 1e-12)) + 1
        ways.append((copies * probes, copies, probes))
    _, copies, probes = min(ways)
    return Router(w, b, probes, copies)


def _matrix(column) -> np.ndarray:
    """A list column of equally long vectors as rows of a matrix."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _drawn(rows: DataFrame) -> np.ndarray:
    return _matrix(rows.orderBy("entry").toArrow().column("v"))


def fit_router(entries: DataFrame, total: int, top: int, s: Settings) -> Router:
    """A router of one level, or of two where parts of ``s.part_rows`` would be more than the sample can tell."""
    router = train_router(_drawn(sampled(entries, "entry", s.sample, total)), total, top, s)
    if router.parts == 1 or total <= 2 * router.parts * s.part_rows:
        return router
    held = entries.sparkSession.sparkContext.broadcast(router)

    def home(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            part = held.value.ranked(x)[:, 0] if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32))], ["entry", "v", "part"])

    def fit(key, table):
        child = train_router(_matrix(table.column("v")), int(table.column("n")[0].as_py()) * router.copies, top, s)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "router": pa.array([pickle.dumps(child)], pa.binary())})

    filed = stored(entries.mapInArrow(trimmed(home), "entry long, v array<double>, part int"), "ann-homes")
    sizes = filed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    some = filed.join(F.broadcast(sizes), "part").where(F.pmod(F.xxhash64("entry"), F.lit(1 << 32)) < F.least(F.lit(1.0), s.sample / F.col("n")) * float(1 << 32))
    found = {r.part: pickle.loads(r.router) for r in some.groupBy("part").applyInArrow(fit, "part int, router binary").collect()}
    return Router(router.weights, router.bias, router.probes, router.copies, tuple(found.get(p) for p in range(router.parts)))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, top: int = 20, settings: Settings | None = None) -> DataFrame:
    """The ``top`` nearest rows of each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id ``every`` divides; candidates are all rows but
    the query's own. Nearness is the inner product in double precision, ties to
    the smaller id. Vectors that are null, zero or hold a null or non-finite
    component take no part, nor do rows without an id. A shorter vector goes on
    with zeros. Rows that repeat an id are one row, with its smallest vector.
    With fewer candidates
    than ``top``, all that were found are returned; an empty table gives an
    empty result. Other columns are ignored.
    """
    s = settings or Settings()
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    src = src.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine).groupBy("vec_id").agg(F.min("v").alias("v"))
    src = stored(src, "ann-vectors")
    width = src.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    src = src.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    # Equal vectors: only the top + 1 smallest ids can be among a query's nearest. Very many of them are cut in several tasks first.
    same = Window.partitionBy("v", "salt").orderBy("vec_id")
    few = src.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)).cast("int")).withColumn("k", F.row_number().over(same)).where(F.col("k") <= top + 1)
    few = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # at most 64 times top + 1
    entries = stored(few.select("v", F.element_at("ids", 1).alias("entry"), F.slice("ids", 1, top + 1).alias("ids")), "ann-entries")
    held = spark.sparkContext.broadcast(fit_router(entries.select("entry", "v"), entries.count(), top, s))

    def file(visits):
        def run(batches):
            for batch in batches:
                if len(batch):
                    row, leaf, turn = held.value.leaves(_matrix(batch.column(1)), visits)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(leaf.astype(np.int64)), pa.array(turn.astype(np.int64))], ["id", "v", "part", "visit"])

        return trimmed(run)

    kind = "id long, v array<double>, part long, visit long"
    filed = stored(entries.select("entry", "v").mapInArrow(file(False), kind), "ann-filed")
    asked = stored(src.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInArrow(file(True), kind), "ann-asked")

    # A part and the queries that visit it may both be many: each is cut into blocks of about ``block_rows``, and each two blocks meet.
    def cut(rows, name):
        return rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / s.block_rows).cast("int").alias(name))

    sizes = F.broadcast(stored(cut(filed, "blocks").join(cut(asked, "sides"), "part"), "ann-sizes"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocked = filed.join(sizes, "part").withColumn("block", own("blocks")).withColumn("side", all_of("sides")).select("part", "block", "side", "id", "v")
    visits = asked.join(sizes, "part").withColumn("side", own("sides")).withColumn("block", all_of("blocks")).select("part", "block", "side", "id", "v", "visit")

    def rank(left, right):
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            x, queries = _matrix(right.column("v")), _matrix(left.column("v"))
            ids, names, floor = (t.column(c).to_numpy() for t, c in ((right, "id"), (left, "id"), (left, "floor")))
            keep = min(top + 1, len(ids))
            # What rounding may have changed in a product of these lengths.
            slack = 1e-12 * np.linalg.norm(queries, axis=1) * np.linalg.norm(x, axis=1).max()
            for a in range(0, len(queries), 256):
                likes = queries[a : a + 256] @ x.T
                best = -np.partition(-likes, keep - 1, axis=1)[:, keep - 1]
                q, c = np.nonzero(likes >= (np.maximum(best, floor[a : a + 256]) - slack[a : a + 256])[:, None])
                # Summed in the same way for every pair, so that equal vectors score alike wherever they stand.
                for column, found in zip(out, (names[a + q], ids[c], (queries[a + q] * x[c]).sum(axis=1))):
                    column.append(found)
            give_back()
        return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("query_id", "entry", "score"), out)})

    def ranked(some):
        keys = ("part", "block", "side")
        return some.groupBy(*keys).cogroup(blocked.groupBy(*keys)).applyInArrow(rank, "query_id long, entry long, score double")

    # The first part visited gives each query a score that its nearest reach; from other parts only better entries are sent.
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")
    home = ranked(visits.where("visit = 0").withColumn("floor", F.lit(float("-inf")))).withColumn("k", F.row_number().over(first)).where(F.col("k") <= top + 1)
    home = stored(home.drop("k"), "ann-home")
    floors = home.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).select("query_id", F.when(F.col("n") > top, F.col("least")).alias("least"))
    other = visits.where("visit > 0").join(floors, F.col("id") == F.col("query_id"), "left").withColumn("floor", F.coalesce("least", F.lit(float("-inf"))))
    # An entry filed under several parts is found several times.
    found = home.unionByName(ranked(other.select("part", "block", "side", "id", "v", "floor"))).groupBy("query_id", "entry").agg(F.max("score").alias("score"))
    # Entries are cut to the top + 1 best before their copies are listed: each brings at least one id.
    found = found.withColumn("k", F.row_number().over(first)).where(F.col("k") <= top + 1).drop("k")
    listed = found.join(entries.select("entry", "ids"), "entry").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return listed.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
