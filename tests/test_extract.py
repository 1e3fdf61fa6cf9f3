"""Extraction by kind, with the cache of section files."""

import pytest

from foliant.operators.extract import extract_content, kinds
from foliant.sources.manifest import Manifest


@pytest.fixture
def inputs(spark):
    sources = spark.createDataFrame([("w", "https://a.org/x", "text/html"), ("p", "/in/b.PDF", None), ("l", "https://a.org/get", "application/pdf; x"), ("r", None, None), ("gone", None, None), ("w", "https://a.org/x", "text/html")], "doc_id string, value string, content_type string")
    web = spark.createDataFrame([("w", "intro\n# One\nfirst\n# Two\nsecond"), ("other", "# Not asked for\nx")], "doc_id string, text string")
    docs = spark.createDataFrame([("p", 0, "A/B c", " body "), ("l", 0, "Full Document", "all"), ("w", 0, "wrong mode", "x")], "doc_id string, section_idx long, title string, content string")
    return sources, web, docs


def test_kinds(inputs):
    assert {r.doc_id: r["mode"] for r in kinds(inputs[0]).collect()} == {"w": "url", "p": "pdf", "l": "pdf", "r": "resume", "gone": "resume"}


def test_extraction(spark, tmp_path, inputs):
    cache = Manifest(spark, f"file://{tmp_path}/sections", ["doc_id", "file_name"])
    files = "doc_id string, file_name string, body string"
    cache.commit(spark.createDataFrame([("r", "01_b.md", "no title"), ("r", "00_a.md", "# Old\n\nkept "), ("w", "01_One.md", "# One\n\nedited by hand"), ("r", "x.txt", "no section")], files))
    want = {
        ("w", 0, "Introduction", "intro", "url"), ("w", 1, "One", "edited by hand", "url"), ("w", 2, "Two", "second", "url"), ("p", 0, "A/B c", " body ", "pdf"), ("l", 0, "Full Document", "all", "pdf"),
        ("r", 0, "Old", "kept", "resume"), ("r", 1, "01_b", "no title", "resume"),
    }
    first = extract_content(*inputs, cache).collect()
    assert {tuple(r)[:5] for r in first} == want and len(first) == len(want)
    assert {(r.doc_id, r.section_idx) for r in first if r.cached} == {("w", 1), ("r", 0), ("r", 1)}
    stored = {(r.doc_id, r.file_name): r.body for r in cache.read().collect()}
    assert stored["p", "00_A-B_c.md"] == "# A/B c\n\n body " and len(stored) == 8
    again = extract_content(*inputs, cache).collect()
    assert {tuple(r)[:5] for r in again} == want and all(r.cached for r in again) and cache.read().count() == 8


def test_nothing(spark, tmp_path, inputs):
    cache = Manifest(spark, f"file://{tmp_path}/sections", ["doc_id", "file_name"])
    assert extract_content(*(x.limit(0) for x in inputs), cache).collect() == [] and cache.read() is None
