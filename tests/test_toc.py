"""Sections of documents in which nothing is eligible."""

from foliant.operators import toc
from foliant.plans import registry


def test_full_document(spark):
    entries = spark.createDataFrame([(1, 1, 1, "Methods", 2), (1, 2, 3, "Deep", 4), (2, 1, 1, "Cover", 0), (2, 2, 1, "Index", 7), (3, 1, 3, "Deep", 1)], "doc_id long, ord long, level long, title string, page long")
    totals = spark.createDataFrame([(1, 10), (2, 9), (3, 5), (4, 6)], "doc_id long, total_pages long")  # 4 has no entries
    got = toc.sections(entries, toc.ranges(entries, totals)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "Methods", 1, 2, 9), (2, 0, "Full Document", 1, 0, 6), (3, 0, "Full Document", 1, 0, 4), (4, 0, "Full Document", 1, 0, 5)]


def test_every_document_has_sections(spark):
    sf = "/root/testdata/sf0.001"
    ids = {r[0] for r in registry.entries(spark, sf).select("doc_id").distinct().collect()}
    for name in ("toc_whole_sections", "toc_whole_tokens"):
        assert {r["doc_id"] for r in registry.queries()[name](spark, sf).collect()} == ids


def test_kinds_of_titles(spark):
    from pyspark.sql import functions as F

    kinds = {
        "front": ["Cover", " COPYRIGHT ", "Half Title", "TitlePage", "Table of Contents", "Contents", "List of Tables", "Dedications", "Epigraph", "Praise for us", "Endorsement", "Also by Ann", "About the cover art"],
        "back": ["Index", "Glossary", "Bibliography", "References", "About the Authors", "Colophon", "Appendix B", "The appendix", "Acknowledgments", "Acknowledgements and thanks"],
        "preamble": ["Foreword by Bo", "Preface", "introduction"],
        "content": ["Covering ground", "Contents of a box", "Index funds", "Introduction to rivers", "Praised be", "Acknowledgement letters", ""],
    }
    rows = [(t, k) for k, ts in kinds.items() for t in ts]
    got = spark.createDataFrame(rows, "title string, want string").withColumn("kind", toc.kind(F.col("title"))).where("kind <> want").collect()
    assert got == []


def test_tokens_of_sections(spark):
    import random

    r = random.Random(2)
    pages = [(d, p, r.randrange(4000)) for d in (1, 2, None) for p in range(0, 60, r.choice([1, 2])) if r.random() < 0.9] + [(1, 5, 100)]
    secs = [(d, i, f"s{i}", *sorted((r.randrange(-2, 70), r.randrange(-2, 70)))) for d in (1, 2, 3) for i in range(9)] + [(1, 0, "back", 9, 3)] + [(2, 1, "twice", 0, 9)] * 2
    df = spark.createDataFrame(secs, "doc_id long, section_idx long, title string, start_page long, end_page long")
    got = toc.page_tokens(df, spark.createDataFrame(pages, "doc_id long, page long, chars int")).collect()
    want = [(*s, sum(c for d, p, c in pages if d == s[0] and s[3] <= p <= s[4]) // 4) for s in secs]
    assert sorted(map(tuple, got)) == sorted(want)


def test_headings_of_texts_that_hold_the_marks(spark):
    from foliant.operators import articles

    odd = "a\ue000\ue001\ue000b\ue000\ue002"
    text = f"{odd} before\n# One {odd}\n{odd} first\n#\n# Two\nsecond {odd}"
    got = articles.split_by_headings(spark.createDataFrame([(1, text), (2, odd)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, "Introduction", f"{odd} before"), (1, 1, f"One {odd}", f"{odd} first"), (1, 2, "# Two", f"second {odd}"), (2, 0, "Full article", odd)]
