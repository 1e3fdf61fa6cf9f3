"""Table functions, from SQL alone."""

import pytest

from foliant.functions import tables
from foliant.operators import blocks, dialogue

TEXT = "# Title\n\nwords that go on,\n\nand on\n\n- one\n- two\n\n| a |\n\n```\nx\n```"


def test_split(spark):
    tables.register(spark)
    docs = spark.createDataFrame([("a", TEXT), ("b", None), ("c", "")], "id string, t string")
    got = spark.sql("select id, b.* from {d}, lateral split_blocks(t) b order by id, block_idx", d=docs).collect()
    assert [tuple(r) for r in got] == [("a", i, *x) for i, x in enumerate(blocks.typed_blocks(blocks.stitched(TEXT)))]
    lines = spark.createDataFrame([(k, i, x) for k in ("a", None) for i, x in reversed(list(enumerate(TEXT.split("\n"))))], "k string, n int, line string")
    got = spark.sql("select * from line_blocks(table({x}))", x=lines).collect()
    want = [tuple(x) for x in enumerate(blocks.typed_blocks(blocks.stitched(TEXT)))]
    for k in ("a", None):
        assert sorted((r.block_idx, (r.kind, r.content, r.level)) for r in got if r.k == k) == want


def test_turns(spark):
    tables.register(spark)
    text = " first [S2] hello  [PAUSE_SHORT] there [S1] [S1]bye[PAUSE_LONG]"
    s = spark.createDataFrame([(1, text), (2, None)], "doc_id long, dialogue string")
    got = spark.sql("select doc_id, cast(turn_idx as long) turn_idx, tag, text from {s}, lateral split_turns(dialogue)", s=s).collect()
    assert sorted(got) == sorted(dialogue.turns(s).collect())
    got = spark.sql("select doc_id, cast(part_idx as long) part_idx, kind, text from {s}, lateral split_narration(dialogue)", s=s).collect()
    assert sorted(got) == sorted(dialogue.narration_parts(s, text="dialogue").collect())


def test_wrong_table(spark):
    tables.register(spark)
    with pytest.raises(Exception, match="three columns"):
        spark.sql("select * from line_blocks(table(select 1 a, 2 b))").collect()
