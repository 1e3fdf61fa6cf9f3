"""Commits of artefacts: reruns, two writers, and one that stops midway."""

import pytest

from foliant.sources.manifest import Manifest

SCHEMA = "doc_id long, idx int, body string"


def rows(spark, *some):
    return spark.createDataFrame(list(some), SCHEMA)


def held(m):
    out = m.read()
    return [] if out is None else sorted(map(tuple, out.select("doc_id", "idx", "body").collect()), key=str)


@pytest.fixture
def manifest(spark, tmp_path):
    return Manifest(spark, f"file://{tmp_path}/artefacts", ["doc_id", "idx"])


def test_rerun(spark, manifest):
    some = [(1, 0, "a"), (1, 1, "b"), (None, 0, "c"), (1, 0, "z")]
    assert manifest.read() is None and manifest.lacking(rows(spark, *some)).count() == 4
    assert manifest.commit(rows(spark, *some)) == 3
    assert held(manifest) == sorted([(1, 0, "a"), (1, 1, "b"), (None, 0, "c")], key=str)
    assert manifest.commit(rows(spark, *some)) == 0 and len(manifest.entries()) == 1
    assert manifest.commit(rows(spark, *some, (2, 0, "d"))) == 1
    assert manifest.lacking(rows(spark, (2, 0, "x"), (None, 0, "x"), (3, 0, "new"))).collect()[0].body == "new"
    assert manifest.commit(rows(spark, *some).limit(0)) == 0


def test_stopped_writer(spark, manifest):
    def stop():
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError, match="stopped"):
        manifest.commit(rows(spark, (1, 0, "half"), (2, 0, "half")), stop)
    assert manifest.read() is None  # staged files don't count
    assert manifest.commit(rows(spark, (1, 0, "whole"))) == 1 and held(manifest) == [(1, 0, "whole")]
    assert manifest.sweep() == 1 and held(manifest) == [(1, 0, "whole")]


def test_two_writers(spark, manifest):
    other = Manifest(spark, manifest.folder, manifest.keys)
    came = []

    def between():
        if not came:  # the other writer is through while the first one's files wait
            came.append(other.commit(rows(spark, (1, 0, "theirs"), (9, 9, "theirs"))))

    assert manifest.commit(rows(spark, (1, 0, "ours"), (1, 1, "ours"), (2, 0, "ours")), between) == 2 and came == [2]
    assert held(manifest) == [(1, 0, "theirs"), (1, 1, "ours"), (2, 0, "ours"), (9, 9, "theirs")]
    came.clear()

    def apart():
        if not came:
            came.append(other.commit(rows(spark, (5, 0, "theirs"))))

    assert manifest.commit(rows(spark, (6, 0, "ours")), apart) == 1  # nothing in common: the files stay as they are
    assert len(manifest.entries()) == 4 and manifest.sweep() == 1
    came.clear()
    assert manifest.commit(rows(spark, (7, 0, "ours")), lambda: came or came.append(other.commit(rows(spark, (7, 0, "theirs"))))) == 0
    assert (7, 0, "theirs") in held(manifest) and (7, 0, "ours") not in held(manifest)
