"""TOC sources and division, overlap trim, articles, stored sections."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import articles, blocks, toc


def test_raw_entries(spark):
    raw = spark.createDataFrame([(1, " A ", 1), (2, "B", 0), (1, "C", 12)], "level int, title string, page int")
    assert [tuple(r) for r in toc.raw_entries(raw).collect()] == [(1, "A", 0), (1, "C", 11)]
    assert toc.raw_entries(raw.where("false")).count() == 0


def test_toc_source(spark):
    pages = {1: 50, 2: 15, 3: 29, 4: 30}
    embedded = spark.createDataFrame([(d, 1, 1, "E", p) for d, p in pages.items()], "doc_id long, ord long, level long, title string, page long")
    inferred = spark.createDataFrame([(d, 1, 1, "I", 0) for d in range(1, 6)], embedded.schema)
    totals = spark.createDataFrame([(d, 100) for d in range(1, 7)], "doc_id long, total_pages long")
    got = {r.doc_id: r.title for r in toc.chosen_entries(embedded, inferred, totals).collect()}
    assert got == {1: "E", 2: "I", 3: "I", 4: "E", 5: "I"}  # 30 of 100 is enough; 6 has neither


def passes(secs, entries, chars, budget, strict):
    """Division by plain passes over lists, looking pages up one by one."""
    deepest = max(e[1] for e in entries)
    size = lambda a, b: sum(chars[a : b + 1]) // 4
    while True:
        new, last, some = [], None, False
        for t, lv, a, b in secs:
            if size(a, b) <= budget:
                new.append((t, lv, a, b))
                continue
            kids = [e for e in entries if e[1] == lv + 1 and a <= e[2] <= b and e[3]]
            if kids:
                if kids[0][2] > a:
                    new.append((t, lv, a, kids[0][2] - 1))
                for i, k in enumerate(kids):
                    new.append((k[0], k[1], k[2], max(k[2], kids[i + 1][2] - 1) if i + 1 < len(kids) else b))
                last = some = True
            elif lv >= deepest:
                cut, first = [], a
                for p in range(a, b + 1):
                    if size(first, p) > budget and p > first:
                        cut.append((first, p - 1))
                        first = p
                cut.append((first, b))
                new += [(f"{t} (part {i + 1})" if len(cut) > 1 else t, lv, *c) for i, c in enumerate(cut)]
                last = len(cut) > 1
                some = some or last
            else:
                new.append((t, lv, a, b))
        secs = new
        if not (some if strict else last):
            return secs


def test_division_by_brute_force():
    rng = random.Random(3)
    differ = 0
    for _ in range(300):
        n = rng.randint(1, 40)
        chars = [rng.choice((0, 7, 400, 3000)) for _ in range(n)]
        pages = sorted(rng.randrange(n) for _ in range(rng.randint(1, 12)))
        entries = [(f"t{i}", rng.randint(1, rng.randint(2, 3)), p, rng.random() < 0.9) for i, p in enumerate(pages)]
        secs = [(f"t{i}", lv, p, min(n - 1, p + rng.randint(0, 20))) for i, (_, lv, p, _) in enumerate(entries) if lv <= 2] or [("x", 1, 0, n - 1)]
        ours = [(t, lv, p) for t, lv, p, ok in entries if ok] + [(None, max(e[1] for e in entries), None)]
        run = np.append(0, np.cumsum(chars))
        found = [toc.subdivided_one(secs, ours, run, 600, strict) for strict in (True, False)]
        assert found == [passes(secs, entries, chars, 600, strict) for strict in (True, False)]
        differ += found[0] != found[1]
    assert differ  # the last section looked into decides, without strict


def test_division_keeps_whole_documents(spark):
    entries = spark.createDataFrame([(1, 1, 2, "Deep", 0), (2, 1, 1, "A", 0), (2, 2, 2, "B", 99)], "doc_id long, ord long, level long, title string, page long")
    pages = spark.createDataFrame([(d, p, 4000) for d in (1, 2) for p in range(4)], "doc_id long, page long, chars long")
    totals = spark.createDataFrame([(1, 4), (2, 4)], "doc_id long, total_pages long")
    got = sorted(map(tuple, toc.budget_sections(entries, toc.ranges(entries, totals), pages, 1500, max_level=1).collect()))
    assert got[0] == (1, 0, "Full Document", 1, 0, 3)  # nothing is eligible: as it is, however large
    assert got[1:] == [(2, 0, "A", 1, 0, 3)]  # no entry of the next level lies in its pages, but there is one


def test_page_packing_counts_characters(spark):
    pages = spark.createDataFrame([(1, p, 7) for p in range(8)], "doc_id long, page long, chars long")
    assert [tuple(r)[1:] for r in toc.packed_pages(pages, 4).orderBy("part").collect()] == [(0, 0, 1), (1, 2, 3), (2, 4, 5), (3, 6, 7)]  # 21 // 4 = 5


def trimmed(spark, md, title, following):
    row = spark.createDataFrame([(md, title, following)], "m string, t string, n string")
    return row.select(toc.trimmed(F.col("m"), F.col("t"), F.col("n"))).first()[0]


def test_trim(spark):
    assert trimmed(spark, "old\n## Own title here\nmine\n\n## Next one\nother", "Own title here", "Next one") == "mine"
    assert trimmed(spark, "old\n**2.1** **Own** title\n**goes on**\nmine", "2.1 Own title", None) == "old\n**2.1** **Own** title\n**goes on**\nmine"  # bold inside
    assert trimmed(spark, "old\n**2.1** **Own title**\n**goes on**\n\nmine", "2.1 Own title", None) == "mine"
    assert trimmed(spark, "## Own\nmine", "Own", None) == "## Own\nmine"  # at the very beginning
    assert trimmed(spark, "nothing of it", "Own", "Next") == "nothing of it"
    assert trimmed(spark, "x\n# Own", "Own", None) == ""
    assert trimmed(spark, "x\n# What (is) C++?\ny", "What (is) C++?", None) == "y"
    assert trimmed(spark, "## Next\nx", "Own", "Next") == ""
    assert trimmed(spark, None, "Own", "Next") is None


def test_article_sections(spark):
    split = lambda t, n=2: [tuple(r)[2:] for r in articles.split_by_headings(spark.createDataFrame([(1, t)], "doc_id long, text string"), n).orderBy("section_idx").collect()]
    assert split("") == split(None) == [("Full article", "")]
    assert split("plain\ntext ") == [("Full article", "plain\ntext")]
    assert split("##no space\nx") == [("Full article", "##no space\nx")]
    assert split("a\n# B\nb\n## C\n\n### D\nd\n# E\n") == [("Introduction", "a"), ("B", "b"), ("C", "### D\nd")]
    assert split("# A\na\n## B\nb", 1) == [("A", "a\n## B\nb")]
    assert split("# \nText\nbody") == [("Text", "body")]


def test_stored_sections(spark):
    files = spark.createDataFrame([(1, "01_b.md", "# B\n\nbody\n"), (1, "00_a.v2.md", " plain "), (1, "x.txt", "no")], "doc_id long, file_name string, raw string")
    assert sorted(map(tuple, articles.resumed(files).collect())) == [(1, 0, "00_a.v2", "plain"), (1, 1, "B", "body")]
    row = spark.createDataFrame([("# B\n\n body", "B"), ("# Other\nbody ", "B"), (" x ", "B")], "raw string, title string")
    assert [r[0] for r in row.select(articles.cached_content(F.col("raw"), F.col("title"))).collect()] == [" body", "body", "x"]


def test_block_headings_and_long_lines():
    kinds = lambda t: [(k, c, lv) for k, c, lv in blocks.typed_blocks(t)]
    assert kinds("#5 is a number") == [("paragraph", "#5 is a number", 0)]
    assert kinds("  # in") == [("paragraph", "# in", 0)]
    assert kinds("####### seven") == [("paragraph", "####### seven", 0)]
    assert kinds("- a\nmore\n# H\nx") == [("list", "- a\nmore", 0), ("heading", "H", 1), ("paragraph", "x", 0)]
    assert kinds("Copyright X\nParis\n## H") == [("metadata", "Copyright X\nParis", 0), ("heading", "H", 2)]
    assert kinds("Dr A, ORCID 1\n# Copyright\nRome") == [("metadata", "Dr A, ORCID 1\n# Copyright\nRome", 0)]
    assert not blocks.is_metadata("a.b" * 100_000)  # linear in the length
    assert blocks.is_metadata("mail x.y@uni.edu now")


def test_ids_keep_their_value(spark):
    docs = spark.createDataFrame([(9007199254740993, "a"), (None, "b"), (1, None)], "doc_id long, text string")
    for f in (blocks.blocks, blocks.narrations):
        assert {r.doc_id for r in f(docs).collect()} >= {9007199254740993, None}


def test_pages_as_arrays(spark):
    rows = spark.createDataFrame([(d, p, p * 7 % 5 * d) for d in (1, 2, 3) for p in range(2, 30)], "doc_id long, page long, chars int")
    arrays = toc.pages_by_document(rows, "chars").unionByName(spark.createDataFrame([(4, [], [])], "doc_id long, page array<long>, chars array<long>"))
    got = [sorted(map(tuple, toc.packed_pages(p, 4).collect())) for p in (rows, arrays)]
    assert got[0] == got[1] and {d for d, *_ in got[0]} == {1, 2, 3}


def budget_case(spark):
    entries = spark.createDataFrame([(d, o, lv, f"T{o}", p) for d in (1, 2) for o, lv, p in ((1, 1, 0), (2, 2, 3), (3, 2, 6), (4, 1, 9))] + [(3, 1, 1, "Index", 0)], "doc_id long, ord long, level long, title string, page long")
    within = spark.createDataFrame([(1, 0, 11), (2, 0, 11), (3, 0, 3)], "doc_id long, start_page long, end_page long")
    pages = spark.createDataFrame([(d, p, None if p == 4 else f"{d}.{p} " + "x" * (40 if d == 1 else 4)) for d in (1, 2, 3) for p in range(12)], "doc_id long, page long, text string")
    return entries, within, pages


def test_pages_read_where_used(spark):
    entries, within, pages = budget_case(spark)
    sized = pages.withColumn("chars", F.length("text"))
    by_row = sorted(map(tuple, toc.budget_sections(entries, within, sized, 60, 1).collect()))
    read = toc.budget_sections(entries, within, lambda rows: rows.join(toc.pages_by_document(sized, "chars"), "doc_id", "left"), 60, 1)
    assert sorted(map(tuple, read.collect())) == by_row
    assert [r[2:] for r in by_row if r[0] == 1] == [("T1", 1, 0, 2), ("T2", 2, 3, 5), ("T3", 2, 6, 8), ("T4", 1, 9, 11)]
    assert [r[2:] for r in by_row if r[0] != 1] == [("T1", 1, 0, 8), ("T4", 1, 9, 11), ("Full Document", 1, 0, 3)]


@pytest.mark.parametrize("trim", [None, toc.trimmed])
def test_texts_with_their_sections(spark, trim):
    entries, within, pages = budget_case(spark)
    old = toc.section_texts(toc.budget_sections(entries, within, pages.withColumn("chars", F.length("text")), 60, 1), pages, trim)
    new = toc.budget_texts(entries, within, pages, 60, 1, trim)
    assert sorted(map(tuple, new.select(old.columns).collect())) == sorted(map(tuple, old.collect()))
    assert "pages" not in new.columns and new.count() == 7
