"""Candidates of personal data: secrets without digits, key=value, hex letters, and the spans that training uses."""

import numpy as np
import pytest

pytest.importorskip("foliant.llm.entry")
from foliant.llm import pii  # noqa: E402


@pytest.mark.parametrize(
    ("text", "to"),
    [
        ('password: "CorrectHorseBatteryStaple"', 'password: "<SECRET>"'), ('password: "correct horse battery staple"', 'password: "<SECRET>"'), ("x password=abc123def456ghi789jkl0 y", "x password=<SECRET> y"),
        ("api_key=sk9f8e7d6c5b4a39281706f5e4d3c2b1", "api_key=<SECRET>"), ("user password=hunter2secret99 ok", "user password=<SECRET> ok"), ("mac aa:bb:cc:dd:ee:ff up", "mac <MAC> up"), ("secret=ZmFrZXNlY3JldHZhbHVl==", "secret=<SECRET>"),
        ("the key internationalization of things", None), ("see https://x.org/secret/administrative-documents/page", None), ("commit 3f786850e387550fdab836ed7e6dc881de23001b", None), ("nothing of the kind", None),
    ],
)
def test_redacted(spark, text, to):
    got = pii.personal(spark.createDataFrame([(1, text)], "doc_id long, text string"), replace=True).first()["text"]
    assert got == (to or text)


def test_training_spans_are_proposed():
    rows = pii.invented(600, 5)
    assert all((k, a, b) in pii.proposals(t) for t, k, a, b, _ in rows)
    p = pii.model().predict(np.array([pii.features(*x[:4]) for x in rows]))
    assert ((p > 0.7) == np.array([x[4] for x in rows])).mean() > 0.95
