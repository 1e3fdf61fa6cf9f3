"""Words of a whole Arrow batch as numpy arrays: where they start and end, and their 64-bit hashes.

A word's hash is the polynomial sum(c[byte] * P^i) mod 2^64 (c random, P odd), taken from a running sum so that no loop over words
is needed, then mixed. A window's hash is a polynomial over its words' hashes, mixed again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Word separators: space and 0x09 to 0x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
CHUNK = 1 << 18
BASE, STEP = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
_rng = np.random.default_rng(20240229)
CASED = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWERED = CASED.copy()
LOWERED[65:91] = CASED[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0, base^1, ... mod 2^64, n at least."""
    if base not in _powers or len(_powers[base]) < n:
        p = np.full(max(n, CHUNK), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p)
    return _powers[base]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ U(salt)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and the offsets of each; null counts as empty."""
    arr = arr.fill_null("") if arr.null_count else arr
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None and off[-1] > 0 else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


class Words:
    """starts, ends: byte offsets of each word; first: the first word of each document, and the count at last."""

    def __init__(self, arr: pa.Array, separators: np.ndarray = SPACES):
        self.data, self.offsets = buffers(arr)
        inside = ~separators[self.data]
        begin, end = inside.copy(), inside.copy()
        if len(inside):
            begin[1:] &= ~inside[:-1]
            end[:-1] &= ~inside[1:]
            at = self.offsets[:-1][self.offsets[:-1] < len(inside)]
            begin[at] = inside[at]
            at = self.offsets[1:][self.offsets[1:] > 0] - 1
            end[at] = inside[at]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, table: np.ndarray = CASED) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        inverse = pow(BASE, -1, 1 << 64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + CHUNK)))
            low = self.starts[i]
            part = self.data[low : self.ends[j - 1]]
            run = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(table[part] * powers(BASE, len(part))[: len(part)], out=run[1:])
            a, b = self.starts[i:j] - low, self.ends[i:j] - low
            out[i:j] = mix((run[b] - run[a]) * powers(inverse, len(part) + 1)[a] + (b - a).astype(np.uint64) * U(STEP))
            i = j
        return out

    def windows(self, h: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of k words that lies in one document, and the index of its first word. short: a document with fewer
        words (one at least) counts as one window."""
        n = len(h)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        inverse = pow(STEP, -1, 1 << 64)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(h * powers(STEP, n)[:n], out=run[1:])
        last = np.repeat(self.first[1:], self.counts())  # the end of each word's document
        at = np.arange(n)
        to = at + k
        ok = to <= last
        if short:
            brief = self.first[:-1][(self.counts() > 0) & (self.counts() < k)]
            ok[brief] = True
            to = np.minimum(to, last)
        at, to = at[ok], to[ok]
        return mix((run[to] - run[at]) * powers(inverse, n + 1)[at] + (to - at).astype(np.uint64) * U(BASE)), at
