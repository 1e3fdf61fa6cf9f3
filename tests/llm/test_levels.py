"""Dealing in levels, hot tokens, memory of stored tables, and names that clash."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("foliant.llm.entry")
from test_operators import brute_windows, corpus  # noqa: E402

from foliant.llm import jaccard, pii, quality, runs, substring  # noqa: E402


def test_widths():
    assert runs.widths(5) == [5] and runs.widths(256) == [256]
    for buckets in (257, 5000, 70_000, 10**7):
        w = runs.widths(buckets)
        assert w[-1] == buckets and w[0] <= 257 and all(b <= 257 * a for a, b in zip(w, w[1:], strict=False))


def classes_by_levels(rows, spark, buckets, fan):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = jaccard.shared(jaccard.postings(docs, runs.widths(buckets, fan)[0]), buckets, fan)
    out = set()
    for r in index.collect():
        out |= set(zip(*(runs.unpacked(r[k], t).tolist() for k, t in (("sign", np.uint64), ("token", np.uint64), ("freq", np.uint32))), strict=True))
    return out


@pytest.mark.parametrize("hot", [3, 10**9])
def test_shared_tokens_by_levels(spark, monkeypatch, hot):
    """Whatever the levels: every token of two sets or more comes with all its sets and one number (MANY for a hot one)."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "SLICE", 2000)
    rows = corpus(4)
    sets = {}
    for _, t in rows:
        s = jaccard.Sets(spark_array(t))
        if s.size[0]:
            sets[int(s.sign[0])] = set(s.tokens.tolist())
    count = {}
    for s in sets.values():
        for x in s:
            count[x] = count.get(x, 0) + 1
    want = {(k, x) for k, s in sets.items() for x in s if count[x] > 1}
    for buckets, fan in ((4, 256), (30, 4)):
        got = classes_by_levels(rows, spark, buckets, fan)
        assert {(k, x) for k, x, _ in got} == want
        freq = {}
        for _, x, f in got:
            assert freq.setdefault(x, f) == f
        assert all(f == (count[x] if f != jaccard.MANY else f) for x, f in freq.items())
        assert (jaccard.MANY in freq.values()) == (hot == 3)


def spark_array(t):
    import pyarrow as pa

    return pa.array([t], pa.string())


def test_windows_by_levels(spark, monkeypatch):
    monkeypatch.setattr(substring, "SLICE", 2000)
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = None
    for buckets, fan in ((4, 256), (30, 4)):
        wide = runs.widths(buckets, fan)
        found = {r["doc_id"]: set(runs.unpacked(r["at"], np.uint32).tolist()) for r in substring.repeats(substring.runs(docs, wide[0]), None, buckets, fan).collect()}
        want = want or found
        assert found == want
    brute = brute_windows(rows)
    for d, t in rows:
        gone = substring.kept_words((t or "").encode(), np.array(sorted(want.get(d, ())), np.int64))[1]
        assert gone == brute[d][1]


CLASH = "doc_id long, text string, n_words string, kept string, spans string, n_removed string, quality_score string"


def test_clashing_names(spark):
    import corpus_pipeline

    rows = [(i, f"{'plain words of a text ' * 8} {i}", "a", "b", "c", "d", "e") for i in range(6)] + [(None, "x", "a", "b", "c", "d", "e"), (1, None, "a", "b", "c", "d", "e"), (2, "mail a@b.co now please do it today my dear old friend", "a", "b", "c", "d", "e")]
    docs = spark.createDataFrame(rows, CLASH)
    assert len(quality.judge(docs, None, keys=tuple(docs.columns)).collect()) == len(rows)
    for docs_ in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:4]:
            out = stage(spark, docs_, "/root/testdata/sf0.001")
            assert out.columns == docs.columns
            assert all(r["n_words"] == "a" and r["spans"] == "c" for r in out.collect())
        out = quality.passed(docs_, None)
        assert out.columns == docs.columns
        out.collect()
    for df in (pii.personal(docs), substring.removed(docs), substring.removed(docs, digest=True)):
        assert len(set(df.columns)) == len(df.columns)
        assert df.count() == len(rows)


def test_nothing_but_documents_without_windows(spark):
    docs = spark.createDataFrame([(1, None), (2, "a b"), (None, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["kept_sha256"] for r in substring.removed(docs, digest=True).collect()}
    assert got == {1: hashlib.sha256(b"").hexdigest(), 2: hashlib.sha256(b"a b").hexdigest(), None: hashlib.sha256(b"").hexdigest()}
