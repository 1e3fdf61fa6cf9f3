"""Work that grows with the input and no faster, bounds that drop nothing, and clashing names."""

import time
from itertools import pairwise

import numpy as np
import pytest

pytest.importorskip("foliant.llm.entry")
import public_tokenizers as P  # noqa: E402

from foliant.llm import jaccard, language, licenses, packing, pii, quality, tokens  # noqa: E402


def seconds(f):
    t = time.process_time()
    out = f()
    return time.process_time() - t, out


def test_white_space_is_linear():
    from tokenizers import Tokenizer

    c, lib = tokens.PrefixCounter(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    size = lambda x: len(lib.encode(x, add_special_tokens=False).ids)
    for t in (" " * 90 + "a  b\n\n \t c", "x \n" * 20, "   é 　\n", "it's   \n'll  "):
        assert c.prefix_counts(t).tolist() == [size(t[:i]) for i in range(len(t) + 1)]
    c.prefix_counts(" " * 300)
    took, counts = seconds(lambda: c.prefix_counts(" " * 1_000_000))
    assert took < 6 and counts[-1] == size(" " * 1_000_000)  # some two seconds on a machine of its own


def test_licence_expressions_are_linear():
    tag = "SPDX-License-Identifier: "
    for joint in (" OR ", " AND "):
        took, f = seconds(lambda joint=joint: licenses.scan((tag + joint.join(f"l{i}" for i in range(20_000))).encode()))
        assert took < 4 and len(f["labels"].split(",")) == 20_000
    took, f = seconds(lambda: licenses.scan((tag + " AND ".join("(" + " OR ".join(f"a{g}x{i}" for i in range(256)) + ")" for g in range(8))).encode()))
    assert took < 2 and f["expressions"].startswith("(a0x0 | a0x1 | ") and f["expressions"].count(" & ") == 7
    assert licenses.evaluated("( a or b ) and c or ( d and ( e or f with g ) )".split()) == "(a | b) & c | d & (e | f with g)"
    assert licenses.evaluated("a or ( b or ( c and d ) )".split()) == "a | b | c & d"
    took, _ = seconds(lambda: pytest.raises(licenses.BadExpression, licenses.alternatives, " AND ".join("(" + " OR ".join(f"a{g}x{i}" for i in range(250)) + ")" for g in range(3))))
    assert took < 1


def test_personal_spans_are_walked():
    t = " ".join(f"mail a{i}@example.com phone 555 {i % 900 + 100:03d} {i % 9000 + 1000:04d}" for i in range(8000))
    trees, base = pii.model(), pii.base_spans(t)
    took, spans = seconds(lambda: pii.chosen(t, trees, base))
    assert set(base) <= set(spans) and len(base) >= 8000
    extra = sorted((a, b) for k, a, b in spans if (k, a, b) not in set(base))
    assert all(x[1] <= y[0] for x, y in pairwise(extra))
    again, _ = seconds(lambda: pii.chosen(t[: len(t) // 2], trees, pii.base_spans(t[: len(t) // 2])))
    assert took < 4 * again + 0.5  # twice the text, about twice the time


def test_meets():
    begins, ends = [2, 10], [5, 12]
    assert [pii._meets(begins, ends, a, b) for a, b in ((0, 2), (0, 3), (4, 9), (5, 10), (11, 12), (12, 20), (1, 20))] == [False, True, True, False, True, False, True]


def test_recall_of_planted_spans():
    """Of spans that the method adds, planted among ordinary words, nine of ten are found."""
    rows = [r for r in pii.invented(600, 77) if r[4]]  # another seed than the one that trains
    trees = pii.model()
    found = sum(any(x < b and a < y for _, x, y in pii.chosen(t, trees, pii.base_spans(t))) for t, _, a, b, _ in rows)
    assert found >= 0.9 * len(rows) > 0


def test_labels_of_other_documents(spark):
    good = "the quick brown fox jumps over a lazy dog and then it sleeps for a while in the sun"
    docs = spark.createDataFrame([(i, f"{good} {i}" if i % 2 else f"buy $$$ now {i} " * 3) for i in range(1000, 1040)], "doc_id long, text string")
    # labels of documents that aren't there come first by hash: they don't use up the sample
    labels = spark.createDataFrame([(i, i % 2) for i in range(1040)], "doc_id long, quality int")
    m = quality.train(docs, labels, sample=10)
    assert m is not None
    kept = {r.doc_id for r in quality.judge(docs, m).where("kept").collect()}
    assert {i for i in range(1000, 1040) if i % 2} == kept
    with pytest.raises(ValueError, match="no labelled document"):
        quality.train(docs, labels.where("quality = 1"))
    with pytest.raises(ValueError, match="no labelled document"):
        quality.train(docs, labels, most_bytes=60)  # one class has only long texts
    assert quality.train(docs.limit(0), labels) is None


def test_features_see_pairs_and_characters():
    a, b = (quality.features(t, t.split()) for t in (b"one two three", b"two one three"))
    assert sorted(a[0].tolist()) == sorted(b[0].tolist()) and sorted(a[1].tolist()) != sorted(b[1].tolist())
    assert [len(x) for x in quality.features("日本語é x".encode(), "日本語é x".encode().split())] == [2, 1, 4, 2]


def test_all_languages_are_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for n in range(210):
        word = letters[n % 26] * 2 + letters[n // 26] * 3 + letters[(n * 7) % 26]
        rows += [(n * 10 + i, f"{word} " * 6, f"l{n:03d}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert len(model["langs"]) >= 205  # of some, all rows are held out


def test_packing_keeps_names(spark):
    pieces = spark.createDataFrame([(1, 0, 3, "s", "r", 7, "b"), (1, 1, 2045, None, "q", 8, "c"), (2, 0, 2048, "s", "q", 9, "d")], "`doc id` long, piece int, length long, salt string, r string, n int, before string")
    out = packing.packed(pieces, key="doc id")
    assert out.columns == [*pieces.columns, "sequence_id", "offset"]
    rows = {(r["doc id"], r["piece"]): r for r in out.collect()}
    assert len({r["sequence_id"] for r in rows.values()}) == 2 and (rows[1, 0]["salt"], rows[1, 0]["r"], rows[1, 0]["n"]) == ("s", "r", 7)


def test_survivor_is_the_smallest_text(spark):
    rows = [(1, "B a b c d e f", 2), (1, "A a b c d e f", 1), (1, "a a b c d e f", 3), (1, "A a b c d e f", 0), (9, "a a b c d e f", 1), (None, "other words", 1)]
    rows[0] = (1, "a A b c d e f", 2)
    for order in (rows, rows[::-1]):
        got = jaccard.one_of_each(spark.createDataFrame(order, "doc_id long, text string, n int").repartition(3)).collect()
        assert sorted(map(tuple, got), key=str) == sorted([(1, "A a b c d e f", 0), (None, "other words", 1)], key=str)


def test_mean_of_a_long_text_is_scored():
    t = ("word " * 100_000).encode()
    model = {"weights": np.zeros((4, 1 << quality.BITS), np.float32), "bias": 1.0}
    assert quality.verdicts([t], model, 0.5)[0][0] == 100_000
