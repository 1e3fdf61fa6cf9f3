"""Artefacts of which each key is there once, whoever writes and however often.

A writer puts its rows into a folder of its own and then adds that folder to the manifest: numbered entries, each a file that only one
writer can create. Who finds the next number taken reads what came between, leaves out the keys that are there now, and tries again. What
isn't in the manifest doesn't count, so a writer that stops midway leaves nothing behind but a folder that sweep() removes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Manifest:
    """The artefacts under `folder` (storage that all machines share, on which a file can be created without overwriting), told apart by
    `keys`."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, sub: str) -> list[str]:
        p = self.path(f"{self.folder}/{sub}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def entries(self) -> list[dict]:
        """The entries in order. Entries are few (one a commit) and small."""
        out = []
        for name in self._names("manifest"):
            if name.endswith(".json"):
                f = self.fs.open(self.path(f"{self.folder}/manifest/{name}"))
                try:
                    out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")))
                finally:
                    f.close()
        return out

    def _create(self, number: int, entry: dict) -> bool:
        """Creates the entry of that number; False where another writer has it."""
        to, draft = self.path(f"{self.folder}/manifest/{number:010d}.json"), self.path(f"{self.folder}/drafts/{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        self.fs.mkdirs(to.getParent())
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration())
        try:  # whole or not at all; never over what is there
            context.rename(context.makeQualified(draft), context.makeQualified(to), self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self.fs.delete(draft, False)
            return False
        return True

    def _read(self, entries: list[dict]) -> DataFrame | None:
        """Rows of the entries. A file is read as it was written, whatever columns came later."""
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.folder}/{e['data']}" for e in entries)) if entries else None

    def read(self) -> DataFrame | None:
        """All artefacts that count; None where nothing has been committed."""
        return self._read(self.entries())

    def lacking(self, work: DataFrame) -> DataFrame:
        """Rows of work whose keys (null ones too) aren't committed."""
        done = self.read()
        return work if done is None else self._without(work, done)

    def _without(self, rows: DataFrame, done: DataFrame) -> DataFrame:
        names = [f"__{k}" for k in self.keys]
        done = done.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(self.keys, names, strict=True)]).distinct()
        alike = [F.col(f"`{k}`").eqNullSafe(F.col(f"`{n}`")) for k, n in zip(self.keys, names, strict=True)]
        return rows.join(done, alike, "left_anti")

    def commit(self, rows: DataFrame, staged: Callable[[], None] = lambda: None) -> int:
        """Writes the rows whose keys aren't there yet; their number. Of rows that share a key the smallest stays. staged is called once the
        files are there and before they count (for tests)."""
        every = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        once = rows.groupBy(*[F.col(f"`{k}`") for k in self.keys]).agg(F.min_by(every, F.to_json(every)).alias("__row")).select("__row.*")
        seen = self.entries()
        fresh = once if not seen else self._without(once, self._read(seen))
        while True:
            data = f"data/{uuid.uuid4().hex}"
            fresh.write.parquet(f"{self.folder}/{data}")
            mine = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{data}")
            n = mine.count()
            staged()
            if not n:
                self.fs.delete(self.path(f"{self.folder}/{data}"), True)
                return 0
            while not self._create(len(seen), {"data": data, "rows": n}):
                new = self.entries()[len(seen) :]
                seen += new
                fresh = self._without(mine, self._read(new))
                if fresh.count() < n:
                    break  # another writer has some of the keys: the rest goes into a folder of its own
            else:
                return n

    def sweep(self) -> int:
        """Removes the folders that no entry names; how many. Not while others write."""
        named = {e["data"].rpartition("/")[2] for e in self.entries()}
        lost = [x for x in self._names("data") if x not in named]
        for x in lost:
            self.fs.delete(self.path(f"{self.folder}/data/{x}"), True)
        return len(lost)
