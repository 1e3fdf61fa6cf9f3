"""Main text of pages, narration and dialogue by models in batches."""

import pytest

from foliant.operators import blocks, narration, rounds
from foliant.plans.speech import stub_by_instruction
from foliant.sources import maintext

WORDS = "the river runs along the old town and past the mill where people used to grind their corn every autumn day"


def page(*parts):
    return "<html><head><title>skip me</title><script>var a = '<p>no</p>'</script></head><body>" + "".join(parts) + "</body></html>"


NAV = "<div><ul>" + "".join(f"<li><a href=/{i}>Part {i} of the site</a></li>" for i in range(12)) + "</ul></div>"
SIDE = "<div><p><a href=x>Ten places you must see before summer ends</a> now</p><p><a href=y>Why nobody talks of the other river any more</a></p></div>"
FOOT = "<div>All rights reserved by the owners of this place <a href=z>contact</a></div>"
PAGES = {
    "plain": (page(NAV, f"<div><h1>A town</h1><p>{WORDS}</p><p>{WORDS} <a href=q>again</a></p></div>", SIDE, FOOT), f"# A town\n\n{WORDS}\n\n{WORDS} again"),
    "nested": (page(NAV, "<div><div>" + "".join(f"<div><p>{WORDS} {i}</p></div>" for i in range(4)) + "</div></div>", SIDE, FOOT), "\n\n".join(f"{WORDS} {i}" for i in range(4))),
    "unclosed": (page(NAV, f"<div><h2>B &amp; C<p>{WORDS}<p><b>{WORDS}<br>end<ul><li>one thing<li>two <i>things</i></ul>", FOOT.replace("<div>", "</div><div>")), f"## B & C\n\n{WORDS}\n\n**{WORDS} end**\n\n- one thing\n- two *things*"),
    "table": (page(NAV, f"<section><p>{WORDS}</p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><pre>x = 1</pre></section>", FOOT), f"{WORDS}\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\nx = 1\n```"),
    "links": (page(NAV, NAV), None),
    "loose": ("only loose words here", "only loose words here"),
    "empty": ("", None),
    "none": (None, None),
}


@pytest.mark.parametrize("telling", [False, True])
def test_main_text(spark, telling):
    df = spark.createDataFrame([(k, h) for k, (h, _) in PAGES.items()], "name string, html string")
    got = {r.name: r for r in maintext.main_text(df, "name", telling=telling).collect()}
    assert {k: r.markdown for k, r in got.items()} == {k: m for k, (_, m) in PAGES.items()}
    assert (got["none"].error, got["empty"].error, got["links"].error, got["plain"].error) == ("no page", "no text", "no text", None)
    kinds = {r.text: r.kept for r in maintext.main_blocks(maintext.page_blocks(df.where("name = 'plain'"), "name"), "name", telling).collect()}
    assert kinds["A town"] and kinds[WORDS] and not any(kinds[f"Part {i} of the site"] for i in range(12))
    assert not kinds["All rights reserved by the owners of this place contact"] and not any(v for k, v in kinds.items() if k.startswith(("Ten", "Why")))


def test_told_names(spark):
    inner = f"<div class='cookie-banner'><p>{WORDS}</p><p>{WORDS}</p><p>{WORDS}</p></div>"
    df = spark.createDataFrame([(1, page(f"<div><p>{WORDS} main</p></div>", inner, f"<aside><p>{WORDS}</p><p>{WORDS}</p></aside>"))], "page_id long, html string")
    assert maintext.main_text(df).first().text == f"{WORDS} main"
    assert WORDS + " " + WORDS in maintext.main_text(df, telling=False).first().text  # density alone takes the longest


def test_references_cut_short(spark):
    head = "B&amp;C &lt;1&gt; &#x27;x&#39; &copy; &amp;lt; end&amp"
    df = spark.createDataFrame([(1, page(f"<div><h1>{head}</h1><p>{WORDS}&#x2</p><p>{WORDS} &copy=1 &notit; A&B &</p></div>"))], "page_id long, html string")
    assert maintext.main_text(df, closed=True).first().text == f"B&C <1> 'x' © &lt; end&amp {WORDS}&#x2 {WORDS} &copy=1 &notit; A&B &"
    assert "end&amp " in maintext.main_text(df, telling=False, closed=True).first().text
    assert "end& " in maintext.main_text(df).first().text  # as browsers read it


MIXED = "# Title *one*\n\nIt cost $5 in 2020, see Fig. 3.\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\ncode 1\n\n# not a heading\n```\n\n- first\n- second\ngoes on\n\nCopyright 2020 by X\n\n## Sub\nText that ends in [1]\n\n### Deep\n1. one\n2. two"


def model():
    """Answers by instruction; a closure, as the tasks can't import this module."""
    from foliant.prompts import BLOCKS, prompt

    said = {"metadata": "MENTION: by X ", "table": " a table. ", "code": "some code]", "list": ""}
    starts = {prompt(name): kind for kind, name in BLOCKS.items()}

    def answer(system, text):
        kind = next(k for p, k in starts.items() if system.startswith(p))
        return said.get(kind, f"<{text}>")

    return answer, lambda kind, text: said.get(kind, f"<{text}>")


@pytest.mark.parametrize("target", ["en", "de"])
def test_narration(spark, tmp_path, target):
    made, (answer, by_kind) = str(tmp_path / "made"), model()

    def make():
        with open(made, "a") as f:
            f.write("x\n")
        return answer

    texts = [MIXED, None, "", "plain words only", MIXED + "\n\nCopyright again", "- only\n- a list"]
    docs = spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = sorted(map(tuple, narration.narrated_with(docs, make, "en", target).collect()), key=str)
    assert got == sorted(((i % 5, *blocks.narrated(t or "", by_kind, target != "en")) for i, t in enumerate(texts)), key=str)
    tasks = 2 * spark.sparkContext.defaultParallelism
    with open(made) as f:
        assert 1 <= len(f.readlines()) <= tasks * (1 if target == "en" else 2)  # one model a task and pass, not one a block
    seen = {r.kind for r in blocks.blocks(docs).collect()}
    assert seen == {"heading", "paragraph", "table", "code", "list", "metadata"}


def test_rules_need_no_model(spark):
    def make():
        raise AssertionError("no row needs it")

    docs = spark.createDataFrame([(1, "# A\n\nplain words only")], "doc_id long, text string")
    assert narration.narrated_with(docs, make).first()["llm_calls"] == 0


def test_stub_by_instruction(spark):
    docs = spark.createDataFrame([("x", MIXED)], "doc_id string, text string")
    assert tuple(narration.narrated_with(docs, stub_by_instruction).first()) == ("x", *blocks.narrated(MIXED))


def fold(segments, outlines):
    """The plain loop: a segment after the other."""
    out, answer = [], rounds.stub_speaker()
    for d in dict.fromkeys(s[0] for s in segments):
        summary, topics = "", []
        for k, (_, i, title, content) in enumerate(sorted((s for s in segments if s[0] == d), key=lambda s: s[1])):
            parts = [f"PODCAST OUTLINE (for reference):\n{outlines.get(d) or ''}\n", f"CURRENT SEGMENT: {k + 1} — {title or ''}\n"]
            parts += [f"CONVERSATION SO FAR (summary):\n{summary}\n"] * bool(summary)
            parts += ["TOPICS ALREADY COVERED (do NOT repeat):\n" + "\n".join(f"- {t}" for t in topics) + "\n"] * bool(topics)
            dialogue = answer("", "\n".join([*parts, f"SOURCE MATERIAL FOR THIS SEGMENT:\n{content or ''}"]))
            raw = answer(rounds.SUMMARISER, f"Summary so far:\n{summary or rounds.NO_SUMMARY}\n\nNew dialogue:\n{dialogue}")
            summary, _, rest = raw.partition("TOPICS COVERED:")
            summary = summary.strip()
            for line in rest.splitlines():
                line = line.strip().lstrip("-•*").strip()
                topics = topics + [line] if line and line not in topics else topics
            out.append((d, i, dialogue, summary, topics))
    return sorted(out, key=str)


SEGMENTS = [("a", 0, "One two three four five", "some words here"), ("a", 5, None, None), ("a", 7, "Two six", "more"), ("b", 1, "Only", "x y"), (None, 0, "No id", "z"), (None, 1, "at all", "z z")]


def test_rounds(spark, tmp_path):
    df = spark.createDataFrame(SEGMENTS, "doc_id string, section_idx int, title string, content string")
    outlines = {"a": "Title: A", None: None}
    out = spark.createDataFrame(list(outlines.items()), "doc_id string, outline string")
    asked, broken = str(tmp_path / "asked"), str(tmp_path / "broken")

    def make():
        import os

        inner = rounds.stub_speaker()

        def answer(system, text):
            if "CURRENT SEGMENT: 3 " in text and os.path.exists(broken):
                raise RuntimeError("stopped")
            if "CURRENT SEGMENT" in text:
                with open(asked, "a") as f:
                    f.write(text.partition("CURRENT SEGMENT: ")[2][0] + ("o" if "Title: A" in text else "") + "\n")
            return inner(system, text)

        return answer

    folder = f"file://{tmp_path}/run"
    open(broken, "w").close()
    with pytest.raises(Exception, match="stopped"):
        rounds.dialogue_rounds(df, folder, make, out)
    import os

    os.remove(broken)
    got = rounds.dialogue_rounds(df, folder, make, out)
    assert sorted(map(tuple, got.collect()), key=str) == fold(SEGMENTS, outlines)
    with open(asked) as f:
        assert sorted(f.read().split()) == ["1", "1", "1o", "2", "2o", "3o"]  # the rounds before the stop aren't asked for again
    files = rounds.states_by_file(got.where("doc_id = 'b'")).first()
    assert (files.state_file, files.state) == ("02_state.json", '{"rolling_summary":"Only","covered_topics":["Only"]}')
    again = rounds.dialogue_rounds(df, folder, lambda: (_ for _ in ()).throw(AssertionError("asked again")), out)
    assert again.count() == len(SEGMENTS)


def test_no_segments(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, section_idx long, title string, content string")
    assert rounds.dialogue_rounds(df, f"file://{tmp_path}/run", rounds.stub_speaker).count() == 0


def test_rolled_with_odd_rows(spark):
    from foliant.operators.dialogue import rolled

    df = spark.createDataFrame([("a", 0, None, None), ("a", 1, "Two words", "x y z")], "doc_id string, section_idx long, title string, content string")
    got = sorted(rolled(df).collect(), key=lambda r: r.section_idx)
    assert [(r.doc_id, r.dialogue, r.summary) for r in got] == [("a", "[S1] About . [S2] 0 words, after 0 topics.", ""), ("a", "[S1] About Two words. [S2] 3 words, after 0 topics.", "Two words")]
