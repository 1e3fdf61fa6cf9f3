"""Main text of web pages by the density of their blocks.

A page's block tree becomes rows: each block (heading, paragraph, list item, table row, loose text) with the containers around it, its
words and those of them inside links. Blocks that are mostly links count nothing; the words of the others count for their container, and
half for the one around that. The container of highest count holds the main text, whatever its tag is called."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = re.compile(r"\s+")
#: A reference to a character, closed by a semicolon or not, or a bare ampersand.
REFERENCE = re.compile(r"&(?:(#[0-9]+;|#[xX][0-9a-fA-F]+;)|([A-Za-z][A-Za-z0-9]*;))?")
CONTAINERS = frozenset({"body", "div", "article", "section", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table", "blockquote", "figure"})
LEAVES = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "dt", "dd", "pre", "tr", "figcaption"})
UNSEEN = frozenset({"script", "style", "noscript", "template", "title", "svg", "select", "textarea"})
#: Tags and names (of a class or an id) that tell boilerplate.
TELLING = frozenset({"nav", "header", "footer", "aside", "form"})
TOLD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|footer|masthead|menu|nav\w*|newsletter|popup|promo|related|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)(?:$|[\s_-])", re.I)
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*"}
#: Words that a heading counts for the container that it stands in, besides its own.
HEADING = 20


class _Tree(HTMLParser):
    """Blocks of a page in order: (tag, path, text, markup, words, link_words, told). path: numbers of the containers around the block,
    from the outermost; markup: the text with bold and italic marks; told: whether a telling tag or name stands around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.open: list[tuple[str, int, bool]] = []  # containers: tag, number, told
        self.number = 0
        self.leaf = "text"
        self.unseen: list[str] = []
        self.parts: list[tuple[str, str]] = []  # ("text", "link" or "mark", what)
        self.marks: list[str] = []
        self.links = self.cells = 0
        self.first_row = False

    def flush(self) -> None:
        plain = " ".join("".join(x for kind, x in self.parts if kind != "mark").split())
        if plain:
            linked = sum(len(x.split()) for kind, x in self.parts if kind == "link")
            markup = SPACE.sub(" ", "".join(x for _, x in self.parts) + "".join(reversed(self.marks))).strip() if any(kind == "mark" for kind, _ in self.parts) else plain
            if self.leaf == "tr":
                markup = f"| {markup} |" + ("\n|" + "---|" * max(1, self.cells) if self.first_row else "")
                self.first_row = False
            words = len(plain.split())
            self.blocks.append((self.leaf, [n for _, n, _ in self.open], plain, markup, words, min(words, linked), any(t for _, _, t in self.open)))
        self.parts = [("mark", m) for m in self.marks] if not plain else []
        if plain:
            self.marks = []
        self.cells = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in UNSEEN:
            self.unseen.append(tag)
        elif tag in CONTAINERS:
            self.flush()
            self.number += 1
            names = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role"))
            self.open.append((tag, self.number, tag in TELLING or bool(names and TOLD.search(names))))
            self.leaf = "text"
            self.first_row = tag == "table"
        elif tag in LEAVES:
            self.flush()
            self.leaf = tag
        elif tag in ("td", "th"):
            if self.leaf == "tr" and self.cells:
                self.parts += [("text", " "), ("mark", "| ")]
            self.cells += 1
        elif tag in ("br", "hr"):
            self.parts.append(("text", " "))
        elif tag == "a":
            self.links += 1
        elif tag in MARKS and not self.unseen:
            self.parts.append(("mark", MARKS[tag]))
            self.marks.append(MARKS[tag])

    def handle_endtag(self, tag: str) -> None:
        if tag in UNSEEN:
            if tag in self.unseen:
                self.unseen.remove(tag)
        elif tag in CONTAINERS:
            self.flush()
            if any(t == tag for t, _, _ in self.open):
                while self.open.pop()[0] != tag:
                    pass
            self.leaf = "text"
        elif tag in LEAVES:
            self.flush()
            self.leaf = "text"
        elif tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in MARKS and MARKS[tag] in self.marks:
            self.parts.append(("mark", MARKS[tag]))
            self.marks.remove(MARKS[tag])

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self.parts.append(("link" if self.links else "text", data))


def closed_only(html: str) -> str:
    """html in which only references that a semicolon closes are references: every other ampersand is escaped."""
    return REFERENCE.sub(lambda m: m[0] if m[1] or m[2] in html5 else "&amp;" + m[0][1:], html)


def block_tree(html: str, closed: bool = False) -> list[tuple]:
    t = _Tree()
    t.feed(closed_only(html) if closed else html)
    t.close()
    t.flush()
    return t.blocks


BLOCK = {"tag": ("string", pa.string()), "path": ("array<int>", pa.list_(pa.int32())), "text": ("string", pa.string()), "markup": ("string", pa.string()), "words": ("int", pa.int32()), "link_words": ("int", pa.int32()), "told": ("boolean", pa.bool_())}


def page_blocks(pages: DataFrame, key: str = "page_id", html: str = "html", closed: bool = False) -> DataFrame:
    """key, block_idx and the blocks of every page, in order. Null and empty pages, and pages without text, have none. Tags that aren't
    closed end with what is around them. References to characters count as browsers read them, also without a semicolon; with `closed`,
    only those that have one (a text that was cut within a reference stays as it stands). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [block_tree(h or "", closed) for h in b.column("__html").to_pylist()]
            row = [i for i, x in enumerate(found) for _ in x]
            flat = [x for f in found for x in f]
            cols = [b.column(key).take(pa.array(row, pa.int64())), pa.array([k for f in found for k in range(len(f))], pa.int32())]
            cols += [pa.array([x[k] for x in flat], kind) for k, (_, kind) in enumerate(BLOCK.values())]
            yield pa.RecordBatch.from_arrays(cols, [key, "block_idx", *BLOCK])

    kinds = ", ".join(f"{k} {s}" for k, (s, _) in BLOCK.items())
    return pages.select(key, F.col(html).alias("__html")).mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, block_idx int, {kinds}")


def container_scores(blocks: DataFrame, key: str = "page_id", telling: bool = True) -> DataFrame:
    """key, container, score of every container that holds blocks: twice the words of its own blocks, and the words of the blocks of the
    containers right inside it; blocks that are links by half or more, and with `telling` those that are told, count nothing."""
    free = F.when((2 * F.col("link_words") >= F.col("words")) | (F.col("told") if telling else F.lit(False)), 0).otherwise(F.col("words") - F.col("link_words"))
    heads = F.when((free > 0) & F.col("tag").rlike("^h[1-6]$"), HEADING).otherwise(0)
    around = F.array(F.struct(F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(0)).alias("container"), (2 * (free + heads)).alias("score")), F.struct(F.try_element_at("path", F.lit(-2)).alias("container"), free.alias("score")))
    return blocks.select(key, F.inline(around)).where("container is not null").groupBy(key, "container").agg(F.sum("score").alias("score"))


def main_blocks(blocks: DataFrame, key: str = "page_id", telling: bool = True) -> DataFrame:
    """blocks with link_density, container (that of the highest score on the page, the first of equal ones; null where nothing counts)
    and kept: whether the block stands in that container and isn't links by half or more (with `telling`, nor told)."""
    best = container_scores(blocks, key, telling).where("score > 0").groupBy(key).agg(F.max_by("container", F.struct("score", -F.col("container"))).alias("container"))
    inside = F.coalesce((F.col("container") == 0) | F.array_contains("path", F.col("container")), F.lit(False))
    kept = inside & (2 * F.col("link_words") < F.col("words")) & (~F.col("told") if telling else F.lit(True))
    return blocks.join(best, key, "left").withColumn("link_density", F.col("link_words") / F.col("words")).withColumn("kept", kept)


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", telling: bool = True, closed: bool = False) -> DataFrame:
    """key, text, markdown, n_blocks, error of every page: the plain main text (blocks parted by spaces), the same as markdown, and how
    many blocks the page has; a missing page and one without main text are errors and have null texts. Pages that share a key share the
    text. `closed`: see page_blocks. Exchanges: counts of containers, and block rows once, by key."""
    level = F.regexp_extract("tag", "^h([1-6])$", 1)
    line = F.when(level != "", F.concat(F.expr("repeat('#', int(regexp_extract(tag, '^h([1-6])$', 1)))"), F.lit(" "), "markup")).when(F.col("tag") == "li", F.concat(F.lit("- "), "markup")).when(F.col("tag") == "pre", F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("markup"))
    rows = main_blocks(page_blocks(pages, key, html, closed), key, telling).withColumn("line", line)
    part = F.when(F.col("kept"), F.struct("block_idx", "tag", "text", "line"))
    texts = rows.groupBy(key).agg(F.sort_array(F.collect_list(part)).alias("kept"), F.count("*").alias("n_blocks"))
    close = F.col("kept")  # items of a list and rows of a table stand line by line, other blocks apart
    apart = F.transform(close, lambda x, i: F.concat(F.when(i == 0, "").when(x["tag"].isin("li", "tr") & (F.get(close, i - 1)["tag"] == x["tag"]), "\n").otherwise("\n\n"), x["line"]))
    texts = texts.select(key, F.array_join(F.col("kept.text"), " ").alias("text"), F.array_join(apart, "").alias("markdown"), "n_blocks")
    out = pages.select(key, F.col(html).isNull().alias("__none")).join(texts, key, "left")
    empty = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return out.select(key, empty("text"), empty("markdown"), F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"), F.when(F.col("__none"), "no page").when(F.coalesce("text", F.lit("")) == "", "no text").alias("error"))
