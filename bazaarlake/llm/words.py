"""Words and word shingles of Arrow text columns, computed batch-wise with numpy.

A word is a run of letters or digits: ASCII letters (lower-cased), ASCII
digits and all bytes of non-ASCII characters. Everything else separates words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

_BYTE = np.zeros(256, dtype=np.uint8)  # 0: separates words
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _BYTE[_c] = _c
_BYTE[65:91] = np.arange(97, 123)

_PRIME = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
SHINGLE = 5
_LONG_WORD = 48


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a run of texts. ``first[i]`` to ``first[i + 1]`` are those of text i."""

    hashes: np.ndarray
    start: np.ndarray  # byte offsets in the text that the word is in
    end: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(column, limit: int = 1_000_000, rows: int = 1000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text and at most ``rows`` rows, at least one row each, so that work arrays stay small."""
    offsets = _buffers(column)[0]
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(n, row + rows, max(stop, row + 1))
        yield row, stop
        row = stop


def _buffers(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    text = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, data


def words(column) -> Words:
    """All words of a text column; null counts as empty."""
    offsets, data = _buffers(column)
    base = int(offsets[0])
    low = _BYTE[data[base : int(offsets[-1])]]
    begins = offsets - base
    inside = low != 0
    edge = np.zeros(len(low) + 1, dtype=bool)  # a word starts here
    edge[1:-1] = inside[1:] & ~inside[:-1]
    stop = np.zeros(len(low) + 1, dtype=bool)  # a word ends before here
    stop[1:-1] = inside[:-1] & ~inside[1:]
    if len(low):
        edge[0], stop[-1] = inside[0], inside[-1]
        cuts = begins[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(low))]
        both = cuts[inside[cuts] & inside[cuts - 1]]  # a text ends and the next begins inside a run
        edge[both] = True
        stop[both] = True
    start, end = np.flatnonzero(edge), np.flatnonzero(stop)
    hashes = _hash(low, start, end - start)
    first = np.searchsorted(start, begins)
    home = begins[:-1][np.repeat(np.arange(len(first) - 1), np.diff(first))]
    return Words(hashes, start - home, end - home, first)


def _hash(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    order = np.argsort(-np.minimum(length, 255).astype(np.int16), kind="stable")
    begin, size = start[order], length[order]
    h = np.full(len(order), 0xCBF29CE484222325, dtype=np.uint64)
    for j in range(min(int(size[0]) if len(size) else 0, _LONG_WORD)):
        n = int(np.searchsorted(-size, -j, side="left"))  # words longer than j
        h[:n] = (h[:n] ^ low[begin[:n] + j]) * _PRIME
    for k in range(int(np.searchsorted(-size, -_LONG_WORD, side="left"))):
        h[k] = xxhash.xxh3_64_intdigest(low[begin[k] : begin[k] + size[k]].tobytes())
    out = np.empty_like(h)
    out[order] = mix(h)
    return out


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of ``size`` words. A shorter text with any word is one shingle."""
    n = len(w.hashes)
    counts = np.diff(w.first)
    text_of = w.text_of
    roll = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    for j in range(size):
        roll = roll * _MIX + w.hashes[j : j + len(roll)]
    at = np.arange(len(roll))
    whole = at + size <= w.first[1:][text_of[: len(roll)]]
    owner, value = text_of[: len(roll)][whole], mix(roll[whole])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.array([int.from_bytes(xxhash.xxh3_64_digest(w.hashes[w.first[i] : w.first[i + 1]].tobytes()), "big") for i in short], dtype=np.uint64)
        owner, value = np.concatenate([owner, short]), np.concatenate([value, extra])
    return owner, value


def weighted_sets(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 48-bit shingle, number of times) sorted by text and shingle; each shingle once a text. At most 65,536 texts."""
    if len(w.first) - 1 > 1 << 16:
        raise ValueError("at most 65,536 texts at a time")
    owner, value = shingles(w)
    key = np.sort((owner.astype(np.uint64) << np.uint64(48)) | (value >> np.uint64(16)))
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(fresh)
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count


def units(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text number, unit): a shingle that occurs n times is n units, which makes the weighted similarity a plain one."""
    owner, element, count = weighted_sets(w)
    at = np.repeat(np.arange(len(owner)), count)
    layer = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    return owner[at], mix(element[at] * _MIX + layer.astype(np.uint64))


def weighted_jaccard(left, right) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts: sum of smaller counts over sum of larger counts.

    0 where either text has no word.
    """
    n = len(left)
    sides = []
    for column in (left, right):
        owner, value, count = weighted_sets(words(column))
        sides.append(((owner.astype(np.uint64) << np.uint64(48)) | value, count, np.bincount(owner, count, n)))
    (ka, ca, wa), (kb, cb, wb) = sides
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    shared = np.bincount((ka[ia] >> np.uint64(48)).astype(np.int64), np.minimum(ca[ia], cb[ib]), n)
    union = wa + wb - shared
    return np.divide(shared, union, out=np.zeros(n), where=(union > 0) & (shared > 0))
