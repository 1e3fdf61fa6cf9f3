"""Stored artefacts: what isn't stored yet, and what is written twice."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import assembly
from foliant.sources import store


def test_resume_and_append(spark, tmp_path):
    path = str(tmp_path / "sections")
    work = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "doc_id long, section_idx long, content string")
    keys = ["doc_id", "section_idx"]
    assert store.stored_keys(spark, path, keys) is None
    assert store.resume(work, path, keys).count() == 3
    store.append(work.where("doc_id = 1"), path, keys)
    assert [r.content for r in store.resume(work, path, keys).collect()] == ["c"]
    store.append(work, path, keys)
    store.append(work, path, keys)
    assert sorted(r.content for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_state_of_nulls(spark):
    t = spark.createDataFrame([(None, None), ("s", ["x", "y"])], "a string, b array<string>")
    back = t.select(store.state_of(store.state_json(F.col("a"), F.col("b"))).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in back] == [(None, None), ("s", ["x", "y"])]


def test_unknown_language(spark):
    t = spark.createDataFrame([("xx",)], "lang string")
    with pytest.raises(Exception, match="no voice preset for xx"):
        t.select(*[c.alias(k) for k, c in assembly.voices(F.col("lang"), F.lit(1.0)).items()]).collect()


def test_assembly_has_no_silence_at_the_end(spark):
    t = spark.createDataFrame([(1, 0, 10), (1, 1, 20), (2, 0, 5)], "k long, i long, samples long")
    assert sorted((r.k, r.begins) for r in assembly.assembled(t, "k", "i").collect()) == [(1, 0), (1, 48010), (2, 0)]
    assert sorted((r.k, r.samples) for r in assembly.lengths(t, "k").collect()) == [(1, 48030), (2, 5)]
