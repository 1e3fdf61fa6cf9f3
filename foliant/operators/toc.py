"""Tables of contents: entries (doc_id, ord, level, title, page) to kinds, ranges, sections and heading levels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from foliant.functions.text import stripped

# Which titles are front matter, back matter or preamble; the first group that matches wins.
FRONT = (
    r"^cover$",
    r"^half\s*title",
    r"^title\s*page",
    r"^copyright",
    r"^table\s*of\s*contents$",
    r"^contents$",
    r"^list\s*of\s*(figures|tables|illustrations)",
    r"^dedication",
    r"^epigraph",
    r"^praise\b",
    r"^endorsements?$",
    r"^also\s*by\b",
    r"^about\s*the\s*cover",
)
BACK = (
    r"^index$",
    r"^glossary$",
    r"^bibliography$",
    r"^references$",
    r"^about\s*the\s*authors?$",
    r"^colophon$",
    r"appendix",
    r"^acknowledg[e]?ments?$",
    r"^acknowledg[e]?ments?\s+and\b",
)
PREAMBLE = (
    r"^foreword",
    r"^preface",
    r"^introduction$",
)


def kind(title: Column) -> Column:
    t = F.lower(F.regexp_replace(title, r"(?U)^\s+|\s+\z", ""))
    return F.when(t.rlike("|".join(FRONT)), "front").when(t.rlike("|".join(BACK)), "back").when(t.rlike("|".join(PREAMBLE)), "preamble").otherwise("content")


def ranges(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """doc_id, start_page, end_page of the content, from level-1 entries: from the first preamble or content entry to the page before
    the run of back matter at the end."""
    top = entries.where("level = 1").withColumn("kind", kind(F.col("title")))
    back = Window.partitionBy("doc_id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    top = top.withColumn("tail", F.min((F.col("kind") == "back").cast("int")).over(back))
    at = top.groupBy("doc_id").agg(F.min_by("page", F.when(F.col("kind").isin("preamble", "content"), F.col("ord"))).alias("s"), F.min_by("page", F.when(F.col("tail") == 1, F.col("ord"))).alias("b"))
    return totals.join(at, "doc_id", "left").select("doc_id", F.coalesce("s", F.lit(0)).cast("long").alias("start_page"), F.coalesce(F.col("b") - 1, F.col("total_pages") - 1).cast("long").alias("end_page"))


def eligible_sections(entries: DataFrame, within: DataFrame, max_level: int = 2) -> DataFrame:
    """doc_id, section_idx, title, level, start_page, end_page: eligible entries up to the next one's page; a parent that shares its page
    with a deeper next entry is skipped. The last one ends with the range."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    e = entries.withColumn("kind", kind(F.col("title"))).join(within, "doc_id").where((F.col("level") <= max_level) & F.col("kind").isin("preamble", "content") & F.col("page").between(F.col("start_page"), F.col("end_page")))
    e = e.withColumn("np", F.lead("page").over(w)).withColumn("nl", F.lead("level").over(w))
    e = e.where(~F.coalesce((F.col("np") == F.col("page")) & (F.col("nl") > F.col("level")), F.lit(False)))
    end = F.when(F.col("np").isNull(), F.col("end_page")).otherwise(F.greatest("page", F.col("np") - 1))
    return e.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("section_idx"), "title", F.col("level").cast("long").alias("level"), F.col("page").cast("long").alias("start_page"), end.cast("long").alias("end_page"))


def sections(entries: DataFrame, within: DataFrame, max_level: int = 2) -> DataFrame:
    """The sections of every document of within: its eligible ones, or one "Full Document" over its range where nothing is eligible."""
    some = eligible_sections(entries, within, max_level)
    whole = within.join(some.select("doc_id").distinct(), "doc_id", "left_anti")
    return some.unionByName(_whole(whole))


def _whole(within: DataFrame) -> DataFrame:
    return within.select("doc_id", F.lit(0).cast("long").alias("section_idx"), F.lit("Full Document").alias("title"), F.lit(1).cast("long").alias("level"), "start_page", "end_page")


def page_tokens(secs: DataFrame, pages: DataFrame) -> DataFrame:
    """Token estimate of each section: characters of its pages (doc_id, page, chars) over 4. Pages and the ends of sections stand in one
    order by document, along which characters are summed once; a section has what the sum gains between its ends. One exchange by
    document; neither arrays nor a range join."""
    ends = F.array(F.struct(F.col("start_page").alias("__page"), F.lit(0).alias("__what")), F.struct(F.col("end_page").alias("__page"), F.lit(2).alias("__what")))
    marks = secs.select("*", F.inline(ends))
    rows = marks.unionByName(pages.select("doc_id", F.col("page").alias("__page"), F.lit(1).alias("__what"), F.col("chars").cast("long").alias("__chars")), allowMissingColumns=True)
    run = F.coalesce(F.sum("__chars").over(Window.partitionBy("doc_id").orderBy("__page", "__what").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    rows = rows.withColumn("__run", run).where("__what <> 1")
    before, after = F.max(F.when(F.col("__what") == 0, F.col("__run"))), F.max(F.when(F.col("__what") == 2, F.col("__run")))
    total = rows.groupBy(*secs.columns).agg(F.greatest(after - before, F.lit(0)).alias("__n"), F.count(F.when(F.col("__what") == 0, 1)).alias("__copies"))
    # sections that are alike in all columns fell together
    return total.select(*secs.columns, F.explode(F.array_repeat(F.floor(F.col("__n") / 4).cast("long"), F.col("__copies").cast("int"))).alias("tokens"))


def cleaned_headings(h: DataFrame) -> DataFrame:
    """Headings (doc_id, ord, title, page, font_size) without noise, each title once, with levels."""
    h = h.where((F.length("title") >= 3) & ~F.col("title").rlike(r"^[a-z]\(.+\)$"))
    t = Window.partitionBy("doc_id", "title")
    h = h.withColumn("n", F.count("*").over(t)).where("n <= 2").withColumn("rn", F.row_number().over(t.orderBy("ord"))).where("rn = 1")
    d = Window.partitionBy("doc_id")
    number = F.regexp_extract("title", r"^(\d+(?:\.\d+)*)\s", 1)
    share = F.avg((number != "").cast("int")).over(d)
    size = F.when(F.col("font_size") > 0, F.col("font_size"))
    sizes, most = F.size(F.collect_set(size).over(d)), F.max(size).over(d)
    by_number = F.when(number != "", F.regexp_count(number, F.lit(r"\.")) + 1).otherwise(1)
    by_size = F.when((sizes >= 2) & ~F.coalesce(size >= most, F.lit(False)), 2).otherwise(1)
    return h.select("doc_id", "ord", "title", F.coalesce("page", F.lit(0)).alias("page"), F.when(share > 0.5, by_number).otherwise(by_size).cast("long").alias("level"))


#: Adds page and chars (or text), as pages_by_document has them, to rows by doc_id: documents are read where their pages are used.
Reader = Callable[[DataFrame], DataFrame]


def pages_by_document(pages: DataFrame, field: str) -> DataFrame:
    """One row a document: doc_id, page (an array of its pages' numbers, in order) and the field (chars or text) of each as an array. A
    table whose pages are arrays stays as it is: what reads a document knows all its pages, and rows of single pages would have to be
    sorted to come together again."""
    if isinstance(pages.schema["page"].dataType, ArrayType):
        return pages.select("doc_id", "page", field)
    one = F.struct(F.col("page").cast("long").alias("page"), (F.col(field).cast("long") if field == "chars" else F.col(field)).alias(field))
    rows = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("p"))
    return rows.select("doc_id", F.col("p.page").alias("page"), F.col(f"p.{field}").alias(field))


class _Pages:
    """The pages of a batch's documents in one line: `of` tells where each document's begin and end, `run` the characters before each."""

    def __init__(self, b: pa.RecordBatch) -> None:
        self.of = _offsets(b.column("page"))
        self.page = b.column("page").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = b.column("text").flatten() if "text" in b.schema.names else None
        chars = b.column("chars").flatten() if self.text is None else pc.utf8_length(self.text)
        self.chars = chars.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.run = np.append(0, np.cumsum(self.chars))
        self.least = int(self.page.min(initial=0))
        self.wide = int(self.page.max(initial=0)) - self.least + 2
        self.keys = np.repeat(np.arange(len(b)), np.diff(self.of)) * self.wide + self.page - self.least

    def between(self, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pages a to b of each document begin and end; nothing where b comes before a."""
        at = lambda x: doc * self.wide + np.clip(x - self.least, 0, self.wide - 1)
        lo = np.searchsorted(self.keys, at(a))
        return lo, np.maximum(lo, np.searchsorted(self.keys, at(b + 1)))


def _offsets(column: pa.Array) -> np.ndarray:
    """Where the values of each list begin in column.flatten(); null lists are empty."""
    return np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)


def packed_pages(pages: DataFrame, budget: int) -> DataFrame:
    """doc_id, part, start_page, end_page: pages (doc_id, page, chars, or one row a document, see pages_by_document) in order, a chunk
    closed before the page with which its characters over 4 pass the budget, unless it has that page only. The k-th chunks of all
    documents of a batch are found at once along the sum of characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _Pages(b)
            doc = np.flatnonzero(np.diff(p.of))
            at, part, found = p.of[doc], 0, []
            while len(doc):
                until = np.searchsorted(p.run, p.run[at] + 4 * budget + 3, "right") - 1
                until = np.minimum(np.maximum(until, at + 1), p.of[doc + 1])
                found.append((doc, np.full(len(doc), part), p.page[at], p.page[until - 1]))
                more = until < p.of[doc + 1]
                doc, at, part = doc[more], until[more], part + 1
            if found:
                row, *cols = map(np.concatenate, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), *map(pa.array, cols)], ["doc_id", "part", "start_page", "end_page"])

    return pages_by_document(pages, "chars").mapInArrow(run, f"doc_id {pages.schema['doc_id'].dataType.simpleString()}, part long, start_page long, end_page long")


def raw_entries(toc: DataFrame) -> DataFrame:
    """toc (..., title, page counted from 1) with pages counted from 0 and trimmed titles; entries before the first page are dropped."""
    return toc.withColumn("page", F.col("page") - 1).where("page >= 0").withColumn("title", stripped(F.col("title")))


def chosen_entries(embedded: DataFrame, inferred: DataFrame, totals: DataFrame, least: float = 0.3) -> DataFrame:
    """The embedded entries of the documents of totals (doc_id, total_pages) in which they reach the share `least` of the pages, the
    inferred ones of all other documents. Both have the same columns."""
    reach = embedded.groupBy("doc_id").agg(F.max("page").alias("most"))
    good = totals.join(reach, "doc_id").where(F.col("most") >= F.col("total_pages") * least).select("doc_id")
    rest = totals.select("doc_id").join(good, "doc_id", "left_anti")
    return embedded.join(good, "doc_id", "left_semi").unionByName(inferred.join(rest, "doc_id", "left_semi"))


def font_sizes(headings: DataFrame, lines: DataFrame) -> DataFrame:
    """headings (doc_id, ord, title, page) with font_size: the largest size in the first line of that page that holds the title, in
    letters of either case; null where none does. lines: doc_id, page, line, text, sizes (array)."""
    hit = headings.select("doc_id", "page", "ord", "title").join(lines, ["doc_id", "page"]).where(F.contains(F.lower(stripped(F.col("text"))), F.lower("title")))
    first = hit.groupBy("doc_id", "ord").agg(F.min_by(F.array_max("sizes"), "line").alias("font_size"))
    return headings.join(first, ["doc_id", "ord"], "left")


def context_budget(num_ctx: Column, prompt_tokens: int = 350) -> Column:
    """Tokens of a section that fit a model's window beside the prompt and the answer; a backend without a window counts as 40960."""
    return F.floor((F.coalesce(num_ctx, F.lit(40960)) - prompt_tokens) / 2).cast("long")


Section = tuple[str, int, int, int]  # title, level, first and last page


def subdivided_one(secs: list[Section], entries: list[tuple[str, int, int]], run: np.ndarray, budget: int, strict: bool = True) -> list[Section]:
    """Sections of one document, none over the budget that can be divided. entries: (title, level, page) of preamble and content, in
    order, with the deepest level of all entries last as (None, level, None); run: characters before each page. A section over the budget becomes the entries one
    level deeper in its pages, after an introduction up to the first of them; at the deepest level its pages are packed in parts. Passes
    go on until nothing changes; without strict, as long as the last section looked into has changed (which can leave others whole)."""
    deepest = entries[-1][1]
    tokens = lambda a, b: int(run[min(b + 1, len(run) - 1)] - run[min(a, len(run) - 1)]) // 4 if b >= a else 0

    def divided(sec: Section) -> tuple[list[Section], bool | None]:
        title, level, a, b = sec
        if tokens(a, b) <= budget:
            return [sec], None
        inner = [(t, p) for t, lv, p in entries[:-1] if lv == level + 1 and a <= p <= b]
        if inner:
            ends = [max(p, q - 1) for (_, p), (_, q) in zip(inner, inner[1:])] + [b]
            head = [(title, level, a, inner[0][1] - 1)] if inner[0][1] > a else []
            return head + [(t, level + 1, p, e) for (t, p), e in zip(inner, ends, strict=True)], True
        if level < deepest:
            return [sec], None
        starts = [a]
        for p in range(a + 1, b + 1):
            if tokens(starts[-1], p) > budget:
                starts.append(p)
        if len(starts) == 1:
            return [sec], False
        return [(f"{title} (part {k + 1})", level, p, e) for k, (p, e) in enumerate(zip(starts, [q - 1 for q in starts[1:]] + [b], strict=True))], True

    more = True
    while more:
        found = [divided(s) for s in secs]
        secs = [x for part, _ in found for x in part]
        marks = [m for _, m in found if m is not None]
        more = any(marks) if strict else bool(marks) and marks[-1]
    return secs


SECTION = ["section_idx", "title", "level", "start_page", "end_page"]


def subdivided(secs: DataFrame, entries: DataFrame, pages: DataFrame | Reader, budget: int, strict: bool = True, texts: bool = False, whole: DataFrame | None = None) -> DataFrame:
    """secs (doc_id, section_idx, title, level, start_page, end_page) divided to the token budget (see subdivided_one), numbered anew.
    entries: doc_id, ord, level, title, page; pages: doc_id, page, chars, or one row a document (see pages_by_document), or a Reader, so that no page moves. What belongs
    to a document meets by doc_id, one row each; sections that fit are told by the sum of characters for a whole batch, and only
    documents with a section over the budget are divided one by one. With texts, pages have texts (chars may lack), and sections have
    content, the texts of their pages line by line, and next_title, that of the next section if it begins on a page of this one. whole:
    sections of other documents, which stay as they are."""
    long = lambda c: F.col(c).cast("long").alias(c)
    use = F.when(kind(F.col("title")).isin("preamble", "content"), F.struct("ord", "title", long("level"), long("page")))
    e = entries.groupBy("doc_id").agg(F.array_sort(F.collect_list(use)).alias("entries"), F.max("level").cast("long").alias("deepest"))
    s = secs.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_idx", "title", *map(long, SECTION[2:])))).alias("secs"))
    s = s.join(e, "doc_id", "left").withColumn("fixed", F.lit(False))
    if whole is not None:
        s = s.unionByName(whole.select("doc_id", F.array(F.struct(*SECTION)).alias("secs"), F.lit(True).alias("fixed")), allowMissingColumns=True)
    every = pages(s) if callable(pages) else s.join(pages_by_document(pages, "text" if texts else "chars"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _Pages(b)
            of, flat = _offsets(b.column("secs")), b.column("secs").flatten()
            doc = np.repeat(np.arange(len(b)), np.diff(of))
            title, (level, a, z) = flat.field("title"), (flat.field(k).to_numpy() for k in SECTION[2:])
            lo, hi = p.between(doc, a, z)
            heavy = np.zeros(len(b), bool)
            heavy[doc[(p.run[hi] - p.run[lo]) // 4 > budget]] = True
            heavy &= ~b.column("fixed").to_numpy(zero_copy_only=False).astype(bool)
            fits = ~heavy[doc]
            parts = [(doc[fits], (np.arange(len(doc)) - of[doc])[fits], title.filter(pa.array(fits)), level[fits], a[fits], z[fits])]
            new: list[tuple] = []
            for i in np.flatnonzero(heavy):
                inner = [(x["title"], x["level"], x["page"]) for x in b.column("entries")[i].as_py() or []]
                mine = list(zip(title[of[i] : of[i + 1]].to_pylist(), *(x[of[i] : of[i + 1]].tolist() for x in (level, a, z)), strict=True))
                own = slice(p.of[i], p.of[i + 1])
                dense = np.zeros(1 + int(p.page[own].max(initial=-1)), np.int64)
                np.add.at(dense, p.page[own], p.chars[own])
                divided = subdivided_one(mine, [*inner, (None, b.column("deepest")[i].as_py() or 0, None)], np.append(0, np.cumsum(dense)), budget, strict)
                new += [(i, k, *x) for k, x in enumerate(divided)]
            if new:
                d, k, t, *more = zip(*new, strict=True)
                parts.append((np.array(d), np.array(k), pa.array(t, pa.string()), *map(np.array, more)))
            for part in parts:
                yield from _with_texts(b.column("doc_id"), p, *part) if texts else _plain(b.column("doc_id"), *part)

    kinds = f"doc_id {secs.schema['doc_id'].dataType.simpleString()}, section_idx long, title string, level long, start_page long, end_page long"
    return every.mapInArrow(run, kinds + ", content string, next_title string" * texts)


def _plain(ids: pa.Array, doc: np.ndarray, idx: np.ndarray, title: pa.Array, *numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(idx), title, *map(pa.array, numbers)], ["doc_id", *SECTION])


#: Characters of the texts of sections in one batch on its way out of a task, or those of one section, where they are more.
TEXTS = 1 << 22


def _with_texts(ids: pa.Array, p: _Pages, doc: np.ndarray, idx: np.ndarray, title: pa.Array, level: np.ndarray, a: np.ndarray, z: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of sections with content and next_title. Rows of a document stand together and in order."""
    lo, hi = p.between(doc, a, z)
    shared = np.append((doc[1:] == doc[:-1]) & (a[1:] <= z[:-1]), False)[: len(doc)]
    following = title.take(pa.array(np.where(shared, np.arange(len(doc)) + 1, 0), mask=~shared)) if len(doc) else title
    there = np.append(0, np.cumsum(p.text.is_valid().to_numpy(zero_copy_only=False)))  # pages without a text add no line
    lines, lo, hi = p.text.drop_null(), there[lo], there[hi]
    size = np.cumsum(p.run[np.searchsorted(there, hi)] - p.run[np.searchsorted(there, lo)] + 1) if len(doc) else np.zeros(0, np.int64)
    at = 0
    while at < len(doc):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXTS, "right")))
        n = (hi - lo)[at:end]
        begins = np.append(0, np.cumsum(n))
        take = np.arange(begins[-1]) - np.repeat(begins[:-1] - lo[at:end], n)
        content = pc.binary_join(pa.ListArray.from_arrays(pa.array(begins, pa.int32()), lines.take(pa.array(take))), "\n")
        cols = [ids.take(pa.array(doc[at:end])), pa.array(idx[at:end]), title[at:end], *(pa.array(x[at:end]) for x in (level, a, z)), content, following[at:end]]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", *SECTION, "content", "next_title"])
        at = end


def budget_sections(entries: DataFrame, within: DataFrame, pages: DataFrame | Reader, budget: int, max_level: int = 2, strict: bool = True) -> DataFrame:
    """sections() divided to the budget. A document in which nothing is eligible stays whole, however large."""
    some = eligible_sections(entries, within, max_level)
    whole = within.join(some.select("doc_id").distinct(), "doc_id", "left_anti")
    return subdivided(some, entries, pages, budget, strict).unionByName(_whole(whole))


def budget_texts(entries: DataFrame, within: DataFrame, pages: DataFrame | Reader, budget: int, max_level: int = 2, trim: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """budget_sections() of pages with texts (doc_id, page, text, or one row a document), with content: texts go from their document's
    row to its sections, without rows of single pages; `trim` as in section_texts."""
    some = eligible_sections(entries, within, max_level)
    whole = within.join(some.select("doc_id").distinct(), "doc_id", "left_anti")
    out = subdivided(some, entries, pages, budget, texts=True, whole=_whole(whole))
    if trim is not None:
        out = out.withColumn("content", trim(F.col("content"), F.col("title"), F.col("next_title")))
    return out.drop("next_title")


def title_pattern(title: Column) -> Column:
    """A pattern for the heading line of a title in markdown: its first four words, after hashes or in bold, with its number or without."""
    numbered = F.regexp_extract(title, r"^([\d.]+)\s+(.*)", 1)
    rest = F.when(numbered != "", F.regexp_extract(title, r"^([\d.]+)\s+(.*)", 2)).otherwise(title)
    quoted = lambda x: F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    words = F.array_join(F.transform(F.slice(F.regexp_extract_all(rest, F.lit(r"(?U)\S+"), F.lit(0)), 1, 4), quoted), r"\s+")
    number = quoted(numbered)
    plain = F.concat(F.lit(r"^#{1,6}\s+\**"), words, F.lit(r"|^\**"), words, F.lit(r"\**\s*$"))
    with_number = F.concat(F.lit(r"^\**"), number, F.lit(r"\**\s+\**"), words, F.lit(r"|^#{1,6}\s+"), number, F.lit(r"\s+"), words, F.lit("|"))
    return F.concat(F.lit("(?mUd)(?:"), F.when(numbered != "", with_number).otherwise(""), plain, F.lit(")"))


def trimmed(md: Column, title: Column, next_title: Column) -> Column:
    """What belongs to a section on pages that it shares: what comes before its heading goes with the heading (and bold lines that carry it
    on), unless the heading is the very beginning; what follows from the next title's heading on goes too (null: nothing does)."""
    own, following = title_pattern(title), title_pattern(next_title)
    at_start = lambda t, p: F.regexp_like(t, F.concat(F.lit(r"\A"), p))
    before = lambda p: F.concat(F.lit("(?mUd)(?="), p, F.lit(")"))
    parts = F.split(md, before(own), 2)
    rest = F.regexp_replace(F.regexp_replace(F.get(parts, F.lit(1)), r"\A[^\n]*(?:\n|\z)", ""), r"\A(?:\*\*[^\n]*(?:\n|\z))*+", "")
    body = F.when(at_start(md, own) | (F.size(parts) < 2), md).otherwise(F.regexp_replace(rest, r"\A\n+", ""))
    cut = F.when(next_title.isNull(), body).when(at_start(body, following), "").otherwise(F.get(F.split(body, before(following), 2), F.lit(0)))
    return stripped(cut)


def section_texts(secs: DataFrame, pages: DataFrame, trim: Callable[[Column, Column, Column], Column] | None = trimmed) -> DataFrame:
    """secs with content: the texts of its pages (doc_id, page, text), cut by `trim` where pages are shared (None: not cut). The next
    title takes part only if it begins on a page of this section. Pages meet their sections by document and page, without a range join."""
    w = Window.partitionBy("doc_id").orderBy("section_idx")
    s = secs.withColumn("__next", F.when(F.lead("start_page").over(w) <= F.col("end_page"), F.lead("title").over(w)))
    on_page = s.where("start_page <= end_page").select("doc_id", "section_idx", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    body = on_page.join(pages, ["doc_id", "page"]).groupBy("doc_id", "section_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n").alias("content"))
    out = s.join(body, ["doc_id", "section_idx"], "left").withColumn("content", F.coalesce("content", F.lit("")))
    if trim is not None:
        out = out.withColumn("content", trim(F.col("content"), F.col("title"), F.col("__next")))
    return out.drop("__next")


def section_stats(content: Column, budget: int) -> dict[str, Column]:
    """Characters, tokens, and percent of the budget."""
    n = F.length(content).cast("long")
    tokens = F.floor(n / 4).cast("long")
    return {"n_chars": n, "n_tokens": tokens, "percent": F.bround(100 * tokens / budget, 0).cast("long")}
