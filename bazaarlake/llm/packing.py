"""Best-two-fit packing of documents into fixed-length token sequences.

How many pieces fit together depends on their lengths alone, and there are at
most ``capacity`` lengths. So the packing is planned on the histogram of
lengths: each *pattern* (a list of lengths that share a sequence) is found by
best-two-fit and repeated as often as the counts allow. Spark then numbers the
pieces within each length, and the n-th piece of a length takes the n-th slot
of that length in the plan. Nothing but the histogram reaches the driver, and
the plan is as good as one made with all pieces in one place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, partitions, stored, trimmed
from .tokens import word_encoder


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Patterns and how often each is used. ``counts[n]`` pieces have length n; lengths are 1 to capacity.

    A pattern is filled greedily: the largest length left, then again and
    again the largest that fits. Then its smallest piece is taken out if two
    unpacked pieces fill the expanded gap more tightly than it did.
    """
    left = np.asarray(counts, dtype=np.int64).copy()
    left[0] = 0
    sizes = np.arange(capacity + 1)
    plan: list[tuple[list[int], int]] = []
    while True:
        upto = np.maximum.accumulate(np.where(left > 0, sizes, 0))  # largest length in stock that is <= n
        if upto[capacity] == 0:
            return plan
        used: dict[int, int] = {}
        gap, pattern = capacity, []

        def take(n: int) -> None:
            used[n] = used.get(n, 0) + 1
            pattern.append(n)

        def fitting(room: int) -> int:
            n = int(upto[room])
            while n and left[n] <= used.get(n, 0):
                n = int(upto[n - 1])
            return n

        while gap and (n := fitting(gap)):
            take(n)
            gap -= n
        if gap and len(pattern) > 1:
            small = min(pattern)
            room = gap + small
            free = left.copy()
            for n, k in used.items():
                free[n] -= k
            stock = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            first = np.flatnonzero(free[: room + 1] > 0)
            first = first[first > 0]
            second = stock[room - first]
            alone = (second == first) & (free[first] < 2)  # the same single piece cannot be used twice
            second = np.where(alone, stock[np.maximum(second - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > small:
                k = int(total.argmax())
                pattern.remove(small)
                used[small] -= 1
                take(int(first[k]))
                take(int(second[k]))
        need = {n: k for n, k in used.items() if k}
        times = min(int(left[n]) // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
        plan.append((pattern, times))


def slots(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan by length: slot k covers ranks from ``rank[k]`` of ``length[k]``, sorted by both."""
    rows, used, sequence = [], {}, 0
    for pattern, times in plan:
        offset = 0
        for n in pattern:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def token_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = False
) -> DataFrame:
    """Encode whole texts, append ``end_id`` and cut into pieces of at most ``capacity`` ids.

    Returns ``doc_id, piece, start, length, ids_crc32`` and, with ``with_ids``,
    ``ids`` (array of int). A null or empty text gives one piece holding only
    ``end_id``. Rows that repeat an id each give their own pieces. The id column
    is returned as ``doc_id`` (long, may be null). Other columns are ignored.
    """

    def encode(batches):
        encoder = word_encoder(tokenizer_path)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.concatenate([encoder.encode(text.as_py()), end])
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for c, v in zip(cols, (doc_id, k, start, len(part), zlib.crc32(part.tobytes()), part if with_ids else None)):
                        c.append(v)
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in cols[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(encode), schema)


def pack(pieces: DataFrame, length_col: str = "length", order_cols: tuple[str, ...] = ("doc_id", "piece"), capacity: int = 2048) -> DataFrame:
    """Give each piece a ``sequence_id`` and an ``offset``; pieces of one sequence do not overlap and leave no gap.

    Lengths must be from 1 to ``capacity``; null or other lengths raise an
    error. All input columns are returned; columns named ``sequence_id`` or
    ``offset`` are replaced. Rows may repeat; ties in ``order_cols`` are broken
    arbitrarily, which never changes how many sequences are used. An empty
    table gives an empty result. ``pieces`` should be a stored table, as it is
    read twice.
    """
    spark = pieces.sparkSession
    pieces = pieces.select(*[c for c in pieces.columns if c not in ("sequence_id", "offset")])
    # Ranks within a length, counted by part so that a common length is not one task: parts are cut by hash.
    parts = max(partitions(spark), 1)
    part, size, base, rank, spot = (fresh(pieces.columns, c) for c in ("_part", "_len", "_base", "_rank", "_place"))
    keyed = pieces.withColumn(part, F.pmod(F.xxhash64(*order_cols), F.lit(parts)).cast("int")).withColumn(size, F.col(length_col))
    sizes = stored(keyed.groupBy(part, size).agg(F.count(F.lit(1)).alias("n")), "pack-sizes")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for row in sizes.groupBy(size).agg(F.sum("n").alias("n")).collect():
        if row[0] is None or not 1 <= row[0] <= capacity:
            raise ValueError(f"a piece has length {row[0]}, not 1 to {capacity}")
        histogram[row[0]] = row.n
    table = spark.sparkContext.broadcast(slots(best_two_fit(histogram, capacity)))

    before = Window.partitionBy(size).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, size, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy(part, size).orderBy(*order_cols)
    ranked = keyed.withColumn(rank, F.row_number().over(within) - 1).join(starts, [part, size]).withColumn(rank, F.col(rank) + F.col(base))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        t = table.value
        width = np.int64(1) << np.int64(44)
        key = t["length"] * width + t["rank"]
        at = np.searchsorted(key, length.to_numpy(np.int64) * width + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": t["sequence"][at] + rank.to_numpy() - t["rank"][at], "offset": t["offset"][at]})

    placed = ranked.withColumn(spot, place(size, rank))
    return placed.select(*pieces.columns, F.col(f"{spot}.sequence_id").alias("sequence_id"), F.col(f"{spot}.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenize and pack: the pieces of ``token_pieces`` with ``sequence_id`` and ``offset``."""
    return pack(stored(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, with_ids=with_ids), "pack-pieces"), capacity=capacity)
