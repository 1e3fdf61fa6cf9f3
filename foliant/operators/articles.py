"""Markdown articles divided at headings, structure flags, and section files with their cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import safe_name, stripped

#: Stands for a heading while a text is divided. A text's own first characters of it are followed by KEPT meanwhile, so no text holds it.
MARK, KEPT = "\ue000\ue002", "\ue000\ue001"


def split_by_headings(docs: DataFrame, max_level: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section_idx, title, content of docs: divided at headings of at most max_level hashes. Text before the first one is the
    "Introduction"; sections without text are dropped; a text without headings (an empty one too) is one "Full article". A line of
    hashes alone takes the next line of text as its title."""
    heading = rf"(?mUd)^(#{{1,{max_level}}})\s+(.+)$"
    t = F.coalesce(F.col(text), F.lit(""))
    titles = F.regexp_extract_all(t, F.lit(heading), F.lit(2))
    escaped = F.replace(t, F.lit(MARK[0]), F.lit(KEPT))
    bodies = F.transform(F.split(F.regexp_replace(escaped, heading, MARK), MARK, -1), lambda x: F.replace(x, F.lit(KEPT), F.lit(MARK[0])))
    d = docs.select(key, titles.alias("__titles"), bodies.alias("__bodies"))
    found = F.transform("__bodies", lambda body, i: F.struct(F.when(i == 0, "Introduction").otherwise(stripped(F.get("__titles", i - 1))).alias("title"), stripped(body).alias("content")))
    whole = F.array(F.struct(F.lit("Full article").alias("title"), stripped(F.col("__bodies")[0]).alias("content")))
    some = F.when(F.size("__titles") == 0, whole).otherwise(F.filter(found, lambda x: x["content"] != ""))
    out = d.select(key, F.posexplode(some).alias("section_idx", "s"))
    return out.select(key, F.col("section_idx").cast("long").alias("section_idx"), "s.title", "s.content")


def markdown_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section_idx, title, content: divided at lines that begin with two hashes and a space, contents as they stand; sections
    without lines are dropped (numbers keep counting them), blank ones stay."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    head = F.col("line").startswith("## ")
    s = lines.withColumn("head", head).withColumn("k", F.sum(head.cast("int")).over(Window.partitionBy(key).orderBy("i")))
    g = s.groupBy(key, F.col("k").alias("section_idx")).agg(F.max(F.when(F.col("head"), stripped(F.ltrim("line", F.lit("#"))))).alias("title"), F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("i", "line")))).alias("b"))
    return g.where(F.size("b") > 0).select(key, "section_idx", F.coalesce("title", F.lit("Introduction")).alias("title"), F.array_join(F.transform("b", lambda x: x["line"]), "\n").alias("content"))


def has_table(content: Column) -> Column:
    return content.contains("|") & content.contains("---")


def has_list(content: Column) -> Column:
    """A mark or number with a full stop or bracket after it at the start of a line; a plain dash is none."""
    return content.rlike(r"(?mUd)^\s*[-*\d]+[.)]\s")


def loose_flags(content: Column) -> dict[str, Column]:
    """The looser tests: a line with three bars, and any mark or number at the start of a line."""
    return {"has_table": content.rlike(r"(?d)\|.*\|.*\|"), "has_list": content.rlike(r"(?mUd)^\s*[-*\d]+[.)\]]?\s")}


def section_files(sections: DataFrame) -> DataFrame:
    """sections (doc_id, section_idx, title, content) with the name and the body of their files."""
    name = F.concat(F.lpad(F.col("section_idx").cast("string"), 2, "0"), F.lit("_"), safe_name(F.col("title")), F.lit(".md"))
    wide = F.concat(F.col("section_idx").cast("string"), F.lit("_"), safe_name(F.col("title")), F.lit(".md"))
    return sections.withColumns({"file_name": F.when(F.col("section_idx") > 99, wide).otherwise(name), "body": F.concat(F.lit("# "), "title", F.lit("\n\n"), "content")})


def cached_content(raw: Column, title: Column) -> Column:
    """Text of a stored section: without the very heading that was written, else without a first heading line, stripped."""
    head = F.concat(F.lit("# "), title, F.lit("\n\n"))
    first = F.instr(raw, "\n")
    return F.when(raw.startswith(head), F.substring(raw, F.length(head) + 1, F.length(raw))).when(raw.startswith("# "), stripped(F.substring(raw, first, F.length(raw)))).otherwise(stripped(raw))


def cached_or_new(sections: DataFrame, cache: DataFrame) -> DataFrame:
    """section_files() with `cached`, and the stored text in place of content where cache (doc_id, file_name, raw) has the file."""
    s = section_files(sections).join(cache.select("doc_id", "file_name", "raw"), ["doc_id", "file_name"], "left")
    content = F.when(F.col("raw").isNotNull(), cached_content(F.col("raw"), F.col("title"))).otherwise(stripped(F.col("content")))
    return s.select("doc_id", "section_idx", "title", "file_name", content.alias("content"), F.col("raw").isNotNull().alias("cached"))


def resumed(files: DataFrame) -> DataFrame:
    """doc_id, section_idx, title, content of stored sections (doc_id, file_name, raw), in the order of their names: the first heading
    line is the title, else the name without its ending."""
    head = F.col("raw").startswith("# ")
    end = F.instr("raw", "\n")
    title = F.when(head, F.substring("raw", F.lit(3), end - 3)).otherwise(F.regexp_replace("file_name", r"(?<=.)\.[^.]*$", ""))
    content = F.when(head, F.substring("raw", end, F.length("raw"))).otherwise(F.col("raw"))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("file_name")) - 1
    return files.where(F.col("file_name").endswith(".md")).select("doc_id", idx.cast("long").alias("section_idx"), title.alias("title"), stripped(content).alias("content"))
