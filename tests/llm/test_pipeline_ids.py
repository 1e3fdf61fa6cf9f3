"""Stages of the pipeline on rows whose ids are null or repeat."""

import random

import pytest

pytest.importorskip("foliant.llm.entry")
import corpus_pipeline  # noqa: E402


def text(seed, n=60):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def near(t):
    return t + " end"


def test_copies_go_by_row(spark):
    a, b, c, d, e, f, g = map(text, range(7))
    rows = [
        (1, a), (2, near(a)), (2, b), (3, c), (3, d), (4, e), (4, e), (4, near(e)),  # 2 is a copy and a document of its own
        (None, f), (None, g), (None, near(g)), (None, near(a)), (None, None), (None, ""), (5, ""), (5, None), (5, a.upper()),
    ]
    docs = spark.createDataFrame([(*x, "l") for x in rows], "doc_id long, text string, lang string").repartition(3)
    out = corpus_pipeline.jaccard_join(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    of_e, of_g = [x for x in got if x[1] in (e, near(e))], [x for x in got if x[1] in (g, near(g))]
    assert [x[0] for x in of_e] == [4] and [x[0] for x in of_g] == [None]
    rest = [x for x in got if x not in of_e + of_g]
    assert sorted(rest, key=repr) == sorted([(1, a), (2, b), (3, c), (3, d), (None, f), (None, None), (None, ""), (5, ""), (5, None)], key=repr)


def test_passages_go_by_row(spark):
    a, b, c, d, shared = map(text, range(10, 15))
    rows = [(None, a), (None, shared + " " + b), (7, c), (7, shared + " " + d), (8, "x " + shared), (None, None), (9, "short")]
    out = corpus_pipeline.substring_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    assert len(got) == len(rows) and sum(shared in (t or "") for _, t in got) == 1
    assert sorted(i is None for i, _ in got) == sorted(i is None for i, _ in rows)
    for whole in ((None, a), (7, c), (None, None), (9, "short")):  # texts that repeat nothing lose nothing
        assert whole in got
    for i, t in ((None, b), (7, d), (8, "x")):
        assert (i, t) in got or any(k == i and s and shared in s and s.replace(shared, "").strip() == t for k, s in got)
