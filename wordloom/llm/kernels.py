"""Small numpy helpers used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; text i is ``bytes[offsets[i]:offsets[i + 1]]``."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, target: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts, each of at most ``target`` bytes unless a single text is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (in place)."""
    h ^= h >> U64(33)
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def windows64(data: np.ndarray) -> np.ndarray:
    """The little-endian 64-bit number that starts at each byte but the last seven."""
    return np.ndarray((max(0, len(data) - 7),), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,)) if len(data) > 7 else np.zeros(0, U64)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time: what is held as Python strings stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
