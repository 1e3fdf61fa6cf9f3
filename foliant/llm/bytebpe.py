"""Byte-level BPE encoding and decoding (operator 13) by a rank queue.

A pre-token's parts form a linked list. Each rank of a merge has a bucket of the places where that merge can be made; a bitmap in levels
of 64-bit words tells which buckets hold any, so the lowest rank is found by one find-first-set a level. Entries whose pair has changed
since are skipped when their bucket is taken. A pre-token of n bytes takes n steps times the number of levels, whatever its length.

The pre-tokens of a text that aren't known yet share one list and one queue, so a bucket holds the places of all of them and is merged
as arrays; very long pre-tokens have the queue to themselves, place by place."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, release, slices

#: Pre-tokens kept with their ids in a Python worker, in each of two generations, and the longest (in characters) that is kept.
CACHE_WORDS, CACHE_CHARS = 250_000, 128
#: Bytes up to which pre-tokens share a list.
SHORT = 1024
#: Characters of a text that are divided into pre-tokens at once (more only where no place to cut comes).
CHUNK = 1 << 20
#: A space after something that isn't white space: a pre-token always begins there.
CUT = regex.compile(r"(?<=\S) ")
#: Stands for no token.
GONE = 1 << 31


class RankQueue:
    """Places by rank. first() is the lowest rank that has any."""

    def __init__(self, ranks: int):
        self.maps: list[list[int]] = []
        while not self.maps or len(self.maps[-1]) > 1:
            ranks = (ranks + 63) >> 6
            self.maps.append([0] * max(1, ranks))
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(place)
            return
        self.buckets[rank] = [place]
        for words in self.maps:
            at = rank >> 6
            old = words[at]
            words[at] = old | 1 << (rank & 63)
            if old:
                break
            rank = at

    def push_all(self, rank: int, places: list[int]) -> None:
        self.push(rank, places[0])
        self.buckets[rank] += places[1:]

    def first(self) -> int:
        """The lowest rank with a place, -1 if there is none."""
        at = 0
        for words in reversed(self.maps):
            w = words[at]
            if not w:
                return -1
            at = at << 6 | (w & -w).bit_length() - 1
        return at

    def take(self, rank: int) -> list[int]:
        """Empties the bucket: its places, from left to right."""
        places = self.buckets.pop(rank)
        for words in self.maps:
            at = rank >> 6
            words[at] ^= 1 << (rank & 63)
            if words[at]:
                break
            rank = at
        places.sort()
        return places


class ByteBPE:
    """Encoder and decoder for a file of ranks (base64 of a token's bytes, a space, its rank); a merge's rank is that of the bytes it
    makes. Special tokens aren't known: their strings are ordinary text."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        lacking = [x for x in range(256) if bytes([x]) not in self.ranks]
        if lacking:
            raise ValueError(f"no rank for the bytes {lacking}")
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.token[r] = t
        self.longest = max(map(len, self.ranks))
        get, ranks = self.ranks.get, self.ranks
        pairs = np.array([(a << 32 | b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := get(t[:i], -1)) >= 0 <= (b := get(t[i:], -1))], np.int64)
        self.pair, self.pair_rank = pairs[np.argsort(pairs[:, 0])].T.copy()
        self.byte = np.array([ranks[bytes([x])] for x in range(256)])
        # ranks whose token makes a pair of lower rank with some neighbour
        self.wild = np.zeros(len(self.token), bool)
        for part in (self.pair >> 32, self.pair & 0xFFFFFFFF):
            self.wild[part[self.pair_rank < part]] = True
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(len(self.token))
        self.known = Recent(CACHE_WORDS)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank is merged, the leftmost first, until no pair has a rank."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n, longest, get, q = len(piece), self.longest, self.ranks.get, self.queue
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        of = [get(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]  # rank of the pair that begins at a part
        for i, r in enumerate(of):
            if r >= 0:
                q.push(r, i)
        while (r := q.first()) >= 0:
            places = q.take(r)
            for k, i in enumerate(places):
                if of[i] != r:
                    continue  # the pair has changed since
                gone = after[i]
                end = after[i] = after[gone]
                of[gone] = of[i] = -1
                low = r
                if end < n:
                    before[end] = i
                    to = after[end]
                    if to - i <= longest and (new := get(piece[i:to], -1)) >= 0:
                        of[i] = new
                        q.push(new, i)
                        low = min(low, new)
                if (left := before[i]) >= 0:
                    of[left] = -1
                    if end - left <= longest and (new := get(piece[left:end], -1)) >= 0:
                        of[left] = new
                        q.push(new, left)
                        low = min(low, new)
                if low < r:  # that comes first; the others wait
                    for x in places[k + 1 :]:
                        q.push(r, x)
                    break
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of tokens a, b; -1 where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], -1)

    def merged_all(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of short pre-tokens. All lie in one list, parted by slots that pair with nothing, and share the
        queue: pre-tokens don't touch each other, so each bucket is merged at once. Where that could change what comes first within
        a pre-token (the new token makes a pair of lower rank), only the leftmost place of each is merged and the others wait."""
        q, sizes = self.queue, np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        slots = np.append(0, np.cumsum(sizes + 1))
        token = self.byte[raw]
        token[slots] = GONE
        n = len(token)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        of = np.append(self.ranked(token[:-1], token[1:]), -1)
        has = np.flatnonzero(of >= 0)
        has = has[np.argsort(of[has], kind="stable")]
        edge = [0, *(np.flatnonzero(np.diff(of[has])) + 1).tolist(), len(has)] if len(has) else [0]
        for x, y in zip(edge, edge[1:], strict=False):
            q.push_all(int(of[has[x]]), has[x:y].tolist())
        while (r := q.first()) >= 0:
            at = np.unique(np.array(q.take(r)))
            at = at[of[at] == r]  # the pairs of the others have changed since
            if len(at) > 1:
                if self.wild[r]:
                    own = np.searchsorted(slots, at)
                    first = np.diff(own, prepend=-1) > 0
                    if not first.all():
                        q.push_all(r, at[~first].tolist())
                        at = at[first]
                else:
                    tied = after[at[:-1]] == at[1:]  # runs of places that overlap: every other one from the left
                    if tied.any():
                        i = np.arange(len(at))
                        head = np.maximum.accumulate(np.where(np.append(True, ~tied), i, 0))
                        at = at[(i - head) % 2 == 0]
            elif not len(at):
                continue
            gone = after[at]
            end = after[gone]
            after[at], before[end], token[at] = end, at, r
            token[gone], of[gone] = GONE, -1
            left = before[at]
            of[at] = new = self.ranked(token[at], token[end])
            of[left] = old = self.ranked(token[left], token[at])
            for x, ranks in ((at, new), (left, old)):
                for i, y in zip(x[ranks >= 0].tolist(), ranks[ranks >= 0].tolist(), strict=True):
                    q.push(y, i)
        keep = token != GONE
        count = np.append(0, np.cumsum(keep))[slots].tolist()
        out = token[keep].astype("<u4").tobytes()
        return [out[4 * x : 4 * y] for x, y in zip(count, count[1:], strict=False)]

    def learn(self, words: list[str], own: dict[str, bytes]) -> None:
        """Encodes pre-tokens: those up to CACHE_CHARS characters are kept in `known`, the others put into own."""
        short: list[str] = []
        raw: list[bytes] = []
        for w in words:
            piece = w.encode()
            if (whole := self.ranks.get(piece)) is not None:
                self.known.new[w] = whole.to_bytes(4, "little")
            elif len(piece) <= SHORT:
                short.append(w)
                raw.append(piece)
            else:
                own[w] = np.array(self.merged(piece), "<u4").tobytes()
        for w, ids in zip(short, self.merged_all(raw) if raw else (), strict=True):
            (self.known.new if len(w) <= CACHE_CHARS else own)[w] = ids

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text, in parts of about CHUNK characters."""
        at = 0
        while at < len(text):
            cut = CUT.search(text, at + CHUNK) if len(text) - at > CHUNK else None
            end = cut.start() if cut else len(text)
            yield self.encode_all([text if end - at == len(text) else text[at:end]])[0]
            at = end

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each of several texts; the pre-tokens that are new in them are encoded together."""
        split, own = list(map(self.split, texts)), {}
        self.learn(self.known.lacks(dict.fromkeys(chain.from_iterable(split))), own)
        get = self.known.new.__getitem__
        return [np.frombuffer(b"".join([own[p] if p in own else get(p) for p in w] if own else map(get, w)), "<u4") for w in split]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


@lru_cache(1)
def coder(path: str, pattern: str) -> ByteBPE:
    """One per Python worker."""
    return ByteBPE(path, pattern)


def texts(arr: pa.Array) -> list[str]:
    """Null is empty; bytes that aren't UTF-8 become U+FFFD."""
    return [t.decode("utf-8", "replace") for t in arr.cast(pa.binary()).fill_null(b"").to_pylist()]


def grouped(c: ByteBPE, arr: pa.Array) -> Iterator[Iterator[np.ndarray]]:
    """For each text the parts of its ids. Texts up to CHUNK characters are encoded together, longer ones part by part."""
    all_ = texts(arr)
    short = iter(c.encode_all([t for t in all_ if len(t) <= CHUNK]))
    for t in all_:
        yield iter([next(short)]) if len(t) <= CHUNK else c.encode(t)


def kind(df: DataFrame, name: str) -> str:
    return f"`{name}` {df.schema[name].dataType.simpleString()}"


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int> of every row, in its order within a partition. Null and empty texts have no ids; rows that repeat are encoded
    each; very long texts are encoded whole, a part after the other; other columns are ignored, whatever their names; an empty table
    gives no rows. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in slices(batches, "__text"):
            ids = [np.concatenate([np.zeros(0, np.uint32), *parts]).astype(np.int32) for parts in grouped(c, b.column("__text"))]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])
            release()

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text")).mapInArrow(run, f"{kind(docs, key)}, ids array<int>")


def decoded(rows: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, bytes (binary) that the ids of every row stand for; null ids stand for none. An id that the vocabulary lacks is an error. No
    shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([c.decode(np.array(x or [], np.int64)) for x in b.column("__ids").to_pylist()], pa.binary())], [key, "bytes"])

    return rows.select(F.col(f"`{key}`"), F.col(f"`{ids}`").alias("__ids")).mapInArrow(run, f"{kind(rows, key)}, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every row and decodes its ids: key, n_tokens, ids_sha256 (of little-endian unsigned 32-bit ids), decoded_sha256. A text
    is hashed part by part, so a very long one needs no more memory than its parts. Rows as in encoded(). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in slices(batches, "__text"):
            rows = []
            for parts in grouped(c, b.column("__text")):
                n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                for ids in parts:
                    n += len(ids)
                    of_ids.update(ids.tobytes())
                    of_bytes.update(c.decode(ids))
                rows.append((n, of_ids.hexdigest(), of_bytes.hexdigest()))
            n, ids, raw = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64()), pa.array(ids), pa.array(raw)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
            release()

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text")).mapInArrow(run, f"{kind(docs, key)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
