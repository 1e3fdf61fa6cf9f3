"""What the operators share: reading a table, shared storage, Arrow slices, connected components."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that are worked on at once in a Python worker.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Chosen columns of the documents table (all rows, whole texts)."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(cols or ("doc_id", "text")))


#: Bytes of an Arrow batch that goes to a Python worker (one row at least).
BATCH_BYTES = 4 << 20


def slim(spark: SparkSession) -> None:
    """Lets Arrow batches hold BATCH_BYTES at most where the session allows more: both the JVM and the worker hold whole batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)([bkmg]?)b?", spark.conf.get(key, "64m").lower())
    size = int(now[1]) << {"k": 10, "m": 20, "g": 30}.get(now[2], 0) if now and int(now[1]) > 0 else 0
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all machines share, spark.checkpoint.dir. Where that is unset, a local one is set in
    local mode (as in tests); elsewhere it is an error, as executors would write to disks of their own. The folder goes when the
    application ends."""
    slim(spark)
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        d = "file://" + os.path.join(tempfile.gettempdir(), "foliant-shared")
        spark.conf.set("spark.checkpoint.dir", d)
    folder = f"{d.rstrip('/')}/foliant-{spark.sparkContext.applicationId}"
    if folder not in _temporary:
        _temporary.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


_temporary: set[str] = set()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, survives the loss of executors."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """stored(), and the path, for discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a stored table that no later step reads, and has the driver's JVM collect what it no longer needs: only then does Spark
    remove the shuffle files of the jobs that are done, on all machines."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    spark._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that each holds about `most` bytes of text at most (one row at least)."""
    for b in batches:
        arr = b.column(text)
        if arr.null_count == len(arr) or len(b) < 2:
            if len(b):
                yield b
            continue
        off = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
        i = 0
        while i < len(b):
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


_libc = ctypes.CDLL(None)


def release() -> None:
    """Gives memory that a slice no longer needs back to the system, so that a reused Python worker doesn't keep the peak of each stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def byte_texts(arr: pa.Array) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return arr.cast(pa.binary()).fill_null(b"").to_pylist()


class Recent:
    """Values by key in two generations: a full one becomes the old one, and what is used from the old one moves over."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def lacks(self, keys: Iterable) -> list:
        """Keys without a value; the others are in `new` from now on."""
        out = []
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        for k in keys:
            if k not in new:
                if (v := old.get(k)) is None:
                    out.append(k)
                else:
                    new[k] = v
        return out


def n_buckets(docs: DataFrame, each: int, text: str = "text") -> int:
    """How many buckets of about `each` text bytes the column fills: grows with the input, one at least."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return int(total // each) + 1


#: Ids are broadcast up to this many (8 bytes each); beyond it the join is dealt.
BROADCAST_IDS = 1_000_000


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in ids (rows of a null key stay). ids are written first and broadcast only if they are few."""
    ids = stored(ids, "ids")
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_anti")


#: Edges that one task takes at once when it contracts them (16 bytes each).
EDGES = 1_000_000


def forests(edges: DataFrame) -> DataFrame:
    """Edges (a, b) contracted within each partition, EDGES at a time, to stars (a, b): b is the smallest id that they reach from a. They
    connect what edges connect; equal edges and loops vanish."""

    def contracted(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b, top = at[: len(a)], at[len(a) :], np.arange(len(ids))
        while len(a):
            x, y = top[a], top[b]
            np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
            while (top[top] != top).any():
                top = top[top]
            open_ = top[a] != top[b]
            a, b = a[open_], b[open_]
        low = np.flatnonzero(top != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[low]), pa.array(ids[top[low]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append((b.column("a").to_numpy(), b.column("b").to_numpy()))
            n += len(b)
            if n >= EDGES:
                yield contracted(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if held:
            yield contracted(*map(np.concatenate, zip(*held, strict=True)))

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), as (id, label), label the smallest id that links reach; smallest ids themselves and ids
    without edges aren't listed. Partitions contract their edges to stars, and as long as that at least halves them they are contracted
    again in fewer partitions of EDGES each. If one is enough, its stars are the components. Else large-star and small-star rounds follow,
    by minimum aggregates and equi-joins, so a hot vertex is pre-aggregated and its join can be split. The edge table is written to the
    shared folder after each round; nothing is collected."""

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        j = both.join(least, both.a == least.k)
        if small:  # e has a > b: neighbours below a, and a itself, point to the least of them
            out = j.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        else:  # neighbours above a point to the least
            out = j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where("a <> b").distinct()

    e, before = stored(forests(edges), "edges"), None
    n = e.count()
    while before is None or 2 * n <= before:
        parts = n // EDGES + 1
        e, before = stored(forests(e.coalesce(parts)), "edges"), n
        if parts == 1:
            return e.select(F.col("a").alias("id"), F.col("b").alias("label"))
        n = e.count()
    mark = None
    for _ in range(rounds):
        e = stored(star(star(e, False), True), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    return e.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("id"), "label")
