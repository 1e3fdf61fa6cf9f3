"""Sorted runs of fingerprints as compact blobs, and how they are dealt by ranges in levels.

A run is cut into at most FAN ranges at a time. Where an input needs more ranges than that, the rows of a coarse range are merged in
groups of about one range's size and cut finer, level by level. So the number of rows grows in proportion to the input, not with its square."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

#: Ranges that one run is cut into at most.
FAN = 256
_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(a: np.ndarray) -> bytes:
    """An integer array, by byte planes: the high bytes of sorted or small numbers shrink to almost nothing."""
    return _pack.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")


def unpacked(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(_unpack.decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind) if len(raw) else np.zeros(0, kind)


def joined(blobs: list[bytes], kind: type) -> np.ndarray:
    """The arrays of several blobs, one after the other."""
    return np.concatenate([np.zeros(0, kind), *(unpacked(b, kind) for b in blobs)])


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit hash: n ranges of equal width, so a sorted run falls into consecutive slices."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cuts(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that a sorted run touches, and where each begins (and the end)."""
    b = bucket_of(h, n)
    at = np.flatnonzero(np.diff(b, prepend=-1))
    return b[at], np.append(at, len(h))


def widths(buckets: int, fan: int = FAN) -> list[int]:
    """Number of ranges at each level, `buckets` at the last."""
    n = 1
    while fan**n < buckets:
        n += 1
    return [*(-int(-(buckets ** (k / n)) // 1) for k in range(1, n)), buckets]


def salted(df: DataFrame, key: str, blob: str, buckets: int, width: int) -> GroupedData:
    """Rows of each of `width` coarse ranges in groups of about the size of one of `buckets` ranges (by the hash of a blob, so that
    running a task again gives the same groups)."""
    return df.groupBy(key, F.pmod(F.xxhash64(blob), F.lit(-(-buckets // width))).alias("__salt"))
