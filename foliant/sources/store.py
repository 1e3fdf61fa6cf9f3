"""Artefacts of a stage: sections written once, work that isn't stored yet, and the JSON state of a rolling summary."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

STATE = "rolling_summary string, covered_topics array<string>"


def state_json(summary: Column, topics: Column) -> Column:
    return F.to_json(F.struct(summary.alias("rolling_summary"), topics.alias("covered_topics")))


def state_of(json: Column) -> Column:
    """The struct (rolling_summary, covered_topics) that state_json wrote."""
    return F.from_json(json, STATE)


def run_name(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")


def stored_keys(spark: SparkSession, path: str, keys: list[str]) -> DataFrame | None:
    """The keys that path holds; None where nothing has been written yet."""
    try:
        return spark.read.parquet(path).select(*keys).distinct()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def uncached(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of work whose keys done doesn't have."""
    return work.join(done, keys, "left_anti")


def resume(work: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Rows of work whose keys path doesn't hold."""
    done = stored_keys(work.sparkSession, path, keys)
    return work if done is None else uncached(work, done, keys)


def append(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Writes what isn't stored yet. A task that is run again leaves no second copy, as Parquet output is committed by job."""
    resume(rows, path, keys).write.mode("append").parquet(path)


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all machines share (spark.checkpoint.dir). Where that is unset, one is made in local mode; elsewhere it
    is an error, as executors would write to disks of their own. It goes when the application ends."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        d = f"file://{tempfile.gettempdir()}/foliant-work"
    folder = f"{d.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder
