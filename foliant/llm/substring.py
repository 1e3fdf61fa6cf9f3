"""Substring dedup (operator 8): a log-structured fingerprint index of word windows.

Every slice of documents becomes one sorted immutable run of window fingerprints (the earliest owner of each; later owners in the same
slice are known to repeat already, which is also the pre-aggregation that keeps a hot passage at one entry a slice). Runs are dealt by
ranges of the fingerprint; within a range, runs are merge-joined level by level as in a log-structured tree: of two equal fingerprints
the check values are compared (verification), the later owner is a repeat, and the earlier one stays in the compacted run. Repeats go
back to their documents, where the words that they cover are removed.

Incremental use: runs() of earlier documents, compacted() when there are many, are passed to repeats() as history and take precedence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, n_buckets, release, slices, stored
from .runs import FAN, cuts, joined, packed, salted, unpacked, widths
from .wordstream import CASED, Words, mix

WINDOW = 20
#: Text bytes a slice and a range of fingerprints stand for.
SLICE, RANGE = 3 << 20, 6 << 20
BLOBS = ["docs", "fingerprint", "checked", "doc", "at"]
RUN = "bucket long, old boolean, " + ", ".join(f"{k} binary" for k in BLOBS)
RUN_ROWS = pa.schema([("bucket", pa.int64()), ("old", pa.bool_()), *((k, pa.binary()) for k in BLOBS)])
FOUND = pa.schema([("part", pa.int64()), ("doc", pa.binary()), ("at", pa.binary())])
NULL_ID = -(1 << 63)


def with_ids(doc: np.ndarray) -> tuple[bytes, bytes]:
    """Ids as a blob of distinct ones and one of which it is."""
    used, back = np.unique(doc, return_inverse=True)
    return packed(used), packed(back.astype(np.uint32))


def run_rows(run: tuple, width: int, old: bool) -> pa.Table:
    """A sorted run (fingerprint, check, -, doc, at) as a row for each of the `width` ranges that it touches."""
    f, check, _, doc, at = run
    bucket, cut = cuts(f, width)
    rows = []
    for i in range(len(bucket)):
        s = slice(cut[i], cut[i + 1])
        docs, back = with_ids(doc[s])
        rows.append((docs, packed(f[s]), packed(check[s]), back, packed(at[s].astype(np.uint32))))
    return pa.Table.from_arrays([pa.array(bucket), pa.array([old] * len(bucket), pa.bool_()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(5))], schema=RUN_ROWS)


def repeat_rows(doc: np.ndarray, at: np.ndarray, width: int) -> pa.Table:
    """Repeats that are already known, dealt by document (buckets below 0), without fingerprints: however many a hot passage has, they
    don't meet in its range."""
    part, doc, at, edge = by_part(doc, at, width)
    none, rows = packed(np.zeros(0, np.uint64)), []
    for i in range(len(part)):
        docs, back = with_ids(doc[edge[i] : edge[i + 1]])
        rows.append((docs, none, none, back, packed(at[edge[i] : edge[i + 1]].astype(np.uint32))))
    return pa.Table.from_arrays([pa.array(-1 - part), pa.array([False] * len(part), pa.bool_()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(5))], schema=RUN_ROWS)


def by_part(doc: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Windows (doc, at) sorted by the hash of the document, the ranges that they touch, and where each begins (and the end)."""
    h = mix(doc.astype(np.int64).view(np.uint64), 3)
    o = np.argsort(h, kind="stable")
    part, edge = cuts(h[o], width)
    return part, doc[o], at[o], edge


def runs(docs: DataFrame, width: int, window: int = WINDOW, old: bool = False) -> DataFrame:
    """One sorted run of every slice of docs (doc_id, text), cut into `width` fingerprint ranges. Null ids count as the smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            ids = b.column("doc_id").fill_null(NULL_ID).to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            w = Words(b.column("text").take(pa.array(order)) if (np.diff(order) != 1).any() else b.column("text"))
            h = w.hashes(CASED)
            g, at = w.windows(h, window)
            if not len(g):
                continue
            check, _ = w.windows(mix(h, 77), window)
            o = np.argsort(g)
            g, at, check = g[o], at[o], (check[o] >> np.uint64(48)).astype(np.uint16)
            new = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            lead = np.minimum.reduceat(at, new)  # word order is (id, position) order
            later = np.ones(len(g), bool)
            later[np.flatnonzero(at == np.repeat(lead, np.diff(np.append(new, len(g)))))] = False
            # one document twice (repeated rows): what starts at the same place of the same id isn't earlier
            doc = np.searchsorted(w.first, at, "right") - 1
            pos = at - w.first[doc]
            lead_doc = np.searchsorted(w.first, lead, "right") - 1
            size = np.diff(np.append(new, len(g)))
            later &= (ids[doc] != np.repeat(ids[lead_doc], size)) | (pos != np.repeat(lead - w.first[lead_doc], size))
            rows = run_rows((g[new], check[new], None, ids[lead_doc], lead - w.first[lead_doc]), width, old)
            if not old and later.any():
                rows = pa.concat_tables([rows, repeat_rows(ids[doc[later]], pos[later], width)])
            yield from rows.to_batches()
            release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RUN)


class Levels:
    """The runs of one fingerprint range, kept in levels; two runs of a level are merged into one of the next."""

    def __init__(self) -> None:
        self.levels: dict[int, tuple[np.ndarray, ...]] = {}
        self.repeats: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, run: tuple[np.ndarray, ...], level: int = 0) -> None:
        while level in self.levels:
            run, level = self.merge(self.levels.pop(level), run), level + 1
        self.levels[level] = run

    def merge(self, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Runs are (fingerprint, check, new, doc, at), by fingerprint. The earlier owner of an equal fingerprint stays; the later one
        is noted as a repeat unless it belongs to history or is the same place."""
        both = [np.concatenate(x) for x in zip(a, b, strict=True)]
        o = np.argsort(both[0], kind="stable")
        f, check, new, doc, at = (x[o] for x in both)
        i = np.flatnonzero((f[1:] == f[:-1]) & (check[1:] == check[:-1]))
        j = i + 1
        first = (new[i] < new[j]) | ((new[i] == new[j]) & ((doc[i] < doc[j]) | ((doc[i] == doc[j]) & (at[i] <= at[j]))))
        lose = np.where(first, j, i)
        real = new[lose] & ((doc[i] != doc[j]) | (at[i] != at[j]) | (new[i] != new[j]))
        self.repeats.append((doc[lose][real], at[lose][real]))
        keep = np.ones(len(f), bool)
        keep[lose] = False
        return f[keep], check[keep], new[keep], doc[keep], at[keep]

    def whole(self) -> tuple[np.ndarray, ...] | None:
        """All levels compacted into one run."""
        out = None
        for level in sorted(self.levels):
            out = self.levels[level] if out is None else self.merge(out, self.levels[level])
        self.levels = {} if out is None else {99: out}
        return out


def gathered(table: pa.Table) -> Levels:
    index = Levels()
    blobs = {k: table.column(k) for k in BLOBS}
    for i, old in enumerate(table.column("old").to_pylist()):
        r = {k: c[i].as_py() for k, c in blobs.items()}
        doc, at = unpacked(r["docs"], np.int64)[unpacked(r["doc"], np.uint32)], unpacked(r["at"], np.uint32)
        f = unpacked(r["fingerprint"], np.uint64)
        if len(f):
            index.add((f, unpacked(r["checked"], np.uint16), np.full(len(f), not old), doc, at))
        else:
            index.repeats.append((doc, at))
    return index


def repeated(index: Levels) -> tuple[np.ndarray, np.ndarray]:
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return tuple(np.concatenate(x) for x in zip(empty, *index.repeats, strict=True))


def repeats(new: DataFrame, history: DataFrame | None = None, buckets: int = 1, fan: int = FAN) -> DataFrame:
    """doc_id and at (packed unsigned 32-bit starts) of the windows that repeat an earlier one, a row for each document that has any. new
    and history: runs() of widths(buckets, fan)[0] ranges. The repeats that a range finds are dealt by document in as many parts."""
    wide = widths(buckets, fan)
    kinds = "part long, doc binary, at binary"

    def finer(width: int) -> Callable:
        def run(table: pa.Table) -> pa.Table:
            index = gathered(table)
            whole, out = index.whole(), []
            if whole is not None:  # history and new runs stay apart, as new ones alone lose to an equal place
                for old in (False, True):
                    use = whole[2] != old
                    if use.any():
                        out.append(run_rows(tuple(x[use] for x in whole), width, old))
            doc, at = repeated(index)
            release()
            return pa.concat_tables([*out, repeat_rows(doc, at, width)])

        return run

    def found_rows(doc: np.ndarray, at: np.ndarray, width: int) -> pa.Table:
        part, doc, at, edge = by_part(doc, at.astype(np.uint32), width)
        rows = [[packed(x[edge[i] : edge[i + 1]]) for i in range(len(part))] for x in (doc, at)]
        release()
        return pa.Table.from_arrays([pa.array(part), *(pa.array(x, pa.binary()) for x in rows)], schema=FOUND)

    def find(table: pa.Table) -> pa.Table:
        index = gathered(table)
        index.whole()
        return found_rows(*repeated(index), wide[0])

    def windows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return joined(table.column("doc").to_pylist(), np.int64), joined(table.column("at").to_pylist(), np.uint32)

    def finer_parts(width: int) -> Callable:
        return lambda table: found_rows(*windows(table), width)

    def by_document(table: pa.Table) -> pa.Table:
        doc, at = windows(table)
        o = np.lexsort((at, doc))
        doc, at = doc[o], at[o]
        edge = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
        out = pa.table({"doc_id": doc[edge[:-1]], "at": pa.array([packed(at[edge[i] : edge[i + 1]]) for i in range(len(edge) - 1)], pa.binary())})
        release()
        return out

    every = new if history is None else new.unionByName(history)
    for before, width in zip(wide, wide[1:], strict=False):
        every = salted(every, "bucket", "at", buckets, before).applyInArrow(finer(width), RUN)
    found = every.groupBy("bucket").applyInArrow(find, kinds)
    for before, width in zip(wide, wide[1:], strict=False):
        found = salted(found, "part", "doc", buckets, before).applyInArrow(finer_parts(width), kinds)
    return found.groupBy("part").applyInArrow(by_document, "doc_id long, at binary")


def compacted(history: DataFrame) -> DataFrame:
    """Runs merged into one for each range."""

    def reduce(table: pa.Table) -> pa.Table:
        whole = run_rows(gathered(table).whole(), 1, True)
        return whole.set_column(0, "bucket", table.column("bucket").slice(0, 1))

    return history.where("bucket >= 0").groupBy("bucket").applyInArrow(reduce, RUN)


def kept_words(t: bytes, at: np.ndarray, window: int = WINDOW) -> tuple[int, int, bytes]:
    """Words, words removed, and the words that no window starting at `at` covers, joined by single spaces."""
    words = t.split()
    n = len(words)
    if not len(at):
        return n, 0, b" ".join(words)
    edge = np.zeros(n + window + 1, np.int64)
    at = np.unique(at[at < n])
    edge[at] += 1
    edge[at + window] -= 1
    stay = np.cumsum(edge[:n]) == 0
    return n, n - int(stay.sum()), b" ".join([words[i] for i in np.flatnonzero(stay)])


def removed(docs: DataFrame, digest: bool = False, window: int = WINDOW, history: DataFrame | None = None, buckets: int | None = None, counts: bool = True) -> DataFrame:
    """The columns of docs with n_words and n_removed (docs' own columns of these names give way; without counts: the columns of docs
    alone), and text without repeated words where any was removed (digest: kept_sha256 in place of text, for each row). docs: doc_id
    (integer), text, others as they come. Null and empty texts have no words and stay as they are; very long ones are a slice of their own; null ids count as one smallest id; rows that share an id are one document to each other: what starts at the same place
    isn't earlier, and a word goes if it repeats in any of them. Empty table: no rows. Other columns are carried along.

    docs is scanned three times; only documents with repeats are dealt to be joined with them."""
    spark = docs.sparkSession
    spark_docs = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    buckets = buckets or n_buckets(docs, RANGE)
    found = stored(repeats(runs(docs, widths(buckets)[0], window), history, buckets), "repeats").select(F.col("doc_id").alias("__id"), F.col("at").alias("__at"))
    extra = [("n_words", pa.int64()), ("n_removed", pa.int64()), *([("kept_sha256", pa.string())] if digest else [])] if counts else []
    names = [c for c in docs.columns if not (digest and c == "text") and c not in dict(extra)]
    kinds = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names] + [f"{k} {'string' if t == pa.string() else 'long'}" for k, t in extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            has = "__at" in b.schema.names
            rows, texts = [], []
            lists = b.column("__at").to_pylist() if has else [None] * len(b)
            raw = b.column("text").to_pylist()
            for t, x in zip(raw, lists, strict=True):
                n, gone, kept = kept_words((t or "").encode(), unpacked(x, np.uint32).astype(np.int64) if x else np.zeros(0, np.int64), window)
                rows.append((n, gone, hashlib.sha256(kept).hexdigest() if digest else None))
                texts.append(kept.decode() if gone else t)
            c = list(zip(*rows, strict=True))
            cols = [pa.array(texts, pa.string()) if k == "text" else b.column(k) for k in names]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, t) for x, (_, t) in zip(c, extra, strict=False))], [*names, *(k for k, _ in extra)])
            release()

    n = found.count()
    if n > BROADCAST_IDS:
        return spark_docs.join(found, "__id", "left").drop("__id").mapInArrow(run, kinds)
    ids = F.broadcast(found.select("__id"))
    clean = spark_docs.join(ids, "__id", "left_anti").drop("__id").mapInArrow(run, kinds)
    hit = spark_docs.join(ids, "__id", "left_semi").join(found.hint("shuffle_hash"), "__id").drop("__id").mapInArrow(run, kinds)
    return clean.unionByName(hit)
