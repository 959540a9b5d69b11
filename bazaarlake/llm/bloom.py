"""A pair of Bloom filters, built in parallel: hashes seen at least once, and at least twice."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, trimmed

PROBES = 4
BLOCK_BYTES = 1 << 16
FAN = 64


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each hash, shape (n, PROBES); ``bits`` is a power of two."""
    h = hashes.astype(np.uint64, copy=False)
    step = (h >> np.uint64(32)) | np.uint64(1)
    probe = np.arange(PROBES, dtype=np.uint64)
    return ((h[:, None] + step[:, None] * probe) & np.uint64(bits - 1)).astype(np.int64)


class OnceTwice:
    """Filters of one builder, a bit for a bit. ``once`` holds every hash, ``twice`` those that may have come before."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once = np.zeros(bits // 8, dtype=np.uint8)
        self.twice = np.zeros(bits // 8, dtype=np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Add hashes; equal hashes in one call count as one occurrence each."""
        if not len(hashes):
            return
        distinct, counts = np.unique(hashes, return_counts=True)
        pos = positions(distinct, self.bits)
        before = _held(self.once, pos) | (counts > 1)
        for packed, at in ((self.twice, pos[before].ravel()), (self.once, pos.ravel())):
            np.bitwise_or.at(packed, at >> 3, np.left_shift(1, 7 - (at & 7)).astype(np.uint8))

    def seen(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may have been added before."""
        return _held(self.once, positions(hashes, self.bits))

    def blocks(self):
        """(block number, once bytes, twice bytes) of blocks that are not empty."""
        size = min(BLOCK_BYTES, len(self.once))
        for k in range(len(self.once) // size):
            a, b = self.once[k * size : (k + 1) * size], self.twice[k * size : (k + 1) * size]
            if a.any():
                yield k, a.tobytes(), b.tobytes()


def _held(packed: np.ndarray, pos: np.ndarray) -> np.ndarray:
    return ((packed[pos >> 3] >> (7 - (pos & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def merge(once_parts: list[bytes], twice_parts: list[bytes]) -> tuple[bytes, bytes]:
    """Once-seen and twice-seen bits of one block: seen twice in a builder, or once in each of two builders."""
    once = np.zeros(len(once_parts[0]), dtype=np.uint8)
    twice = once.copy()
    for a, b in zip(once_parts, twice_parts):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        twice |= b | (once & a)
        once |= a
    return once.tobytes(), twice.tobytes()


def hits(packed: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Whether each hash may have been seen twice; ``packed`` is the whole twice filter."""
    if not len(hashes):
        return np.zeros(0, dtype=bool)
    return _held(packed, positions(hashes, bits))


def bits_for(items: int, most_log2: int = 27) -> int:
    """Filter size for ``items`` hashes: about 8 to 16 bits each, at most ``2 ** most_log2`` (16 MB) in all."""
    return 1 << min(most_log2, max(16, int(8 * items).bit_length()))


def gathered(source: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], bits: int, twice: bool) -> bytes:
    """The merged once-seen or twice-seen filter of all hashes in ``source``: ``bits // 8`` bytes, whatever the input."""

    def build(batches):
        pair = OnceTwice(bits)
        for batch in batches:
            pair.add(hashes_of(batch))
        rows = list(pair.blocks())
        for k in range(0, len(rows), 64):
            part = rows[k : k + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary()), pa.array([r[2] for r in part], pa.binary())],
                ["block", "once", "twice"],
            )

    def fold(key, table):
        once, again = merge(table.column("once").to_pylist(), table.column("twice").to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "once": pa.array([once], pa.binary()), "twice": pa.array([again], pa.binary())})

    kind = "block int, once binary, twice binary"
    builders = max(1, source.sparkSession.sparkContext.defaultParallelism)
    parts = source.coalesce(builders).mapInArrow(trimmed(build), kind)
    # A tree: at most FAN filters of a block meet in a task, whatever the number of builders.
    while builders > FAN:
        group = F.pmod(F.xxhash64("once", "twice"), F.lit(-(-builders // FAN))).alias("g")
        parts = stored(parts.groupBy("block", group).applyInArrow(fold, kind), "bloom-parts")
        builders = -(-builders // FAN)
    size = min(BLOCK_BYTES, bits // 8)
    whole = bytearray(bits // 8)
    for row in parts.groupBy("block").applyInArrow(fold, kind).select("block", "twice" if twice else "once").collect():
        whole[row[0] * size : (row[0] + 1) * size] = row[1]
    return bytes(whole)
