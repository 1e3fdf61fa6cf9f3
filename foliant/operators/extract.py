"""From sources to sections: web pages by headings, documents by their table of contents, stored sections, and all of them at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators import articles, toc
from foliant.sources.manifest import Manifest
from foliant.sources.pages import pages_to_markdown, source_kind

NAMES = ["doc_id", "section_idx", "title", "content"]


def web_sections(pages: DataFrame, max_level: int = 1) -> DataFrame:
    """doc_id, section_idx, title, content of web pages (page_id, url, html) that have a text."""
    md = pages_to_markdown(pages).where("error is null")
    return articles.split_by_headings(md.select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text")), max_level)


def document_sections(entries: DataFrame, totals: DataFrame, pages: DataFrame | toc.Reader, max_level: int = 1, budget: int = 20_000, trim: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """doc_id, section_idx, title, content of documents: sections of their entries within the content's pages, divided to the token
    budget, with the texts of pages (doc_id, page, text, or one row a document or a reader, see toc.subdivided);
    trim cuts what shared pages hold of other sections."""
    return toc.budget_texts(entries, toc.ranges(entries, totals), pages, budget, max_level, trim).select(*NAMES)


def extracted(web: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """Sections of all sources with their mode: of web texts (doc_id, text), of documents (sections as document_sections gives them), and of stored files
    (doc_id, file_name, raw)."""
    tagged = lambda df, mode: df.select(*NAMES).withColumn("mode", F.lit(mode))
    return tagged(articles.split_by_headings(web), "url").unionByName(tagged(documents, "pdf")).unionByName(tagged(articles.resumed(files), "resume"))


def kinds(sources: DataFrame) -> DataFrame:
    """doc_id, mode of sources (doc_id, value, content_type): resume where there is no value, else pdf or url."""
    mode = F.when(F.col("value").isNull(), "resume").otherwise(source_kind(F.col("value"), F.col("content_type")))
    return sources.select("doc_id", mode.alias("mode"))


def extract_content(sources: DataFrame, web: DataFrame, documents: DataFrame, cache: Manifest, max_level: int = 2) -> DataFrame:
    """doc_id, section_idx, title, content, mode, cached of every source, each in the mode of its kind: a url's Markdown (web: doc_id, text)
    divided at headings, a pdf's sections (documents: doc_id, section_idx, title, content, as document_sections gives them), a resumed
    one's stored files. Sections whose file is in the cache (doc_id, file_name, body) are read from there; the others are committed to it,
    once, whoever else writes. Sources that share an id count once. A source of which there is neither text nor file has no rows."""
    mode = kinds(sources).groupBy("doc_id").agg(F.min("mode").alias("mode"))
    of = lambda df, m: df.join(mode.where(F.col("mode") == m).select("doc_id"), "doc_id", "left_semi")
    found = articles.split_by_headings(of(web, "url"), max_level).unionByName(of(documents, "pdf").select(*NAMES))
    files = articles.section_files(found)
    stored = cache.read()
    fresh = files if stored is None else files.join(stored.select("doc_id", "file_name"), ["doc_id", "file_name"], "left_anti")
    cache.commit(fresh.select("doc_id", "file_name", "body"))
    every = cache.read()  # what was written now, and what another writer may have put first
    none = files.select("doc_id", "file_name", F.lit(None).cast("string").alias("raw")).limit(0)
    raw = none if every is None else every.select("doc_id", "file_name", F.col("body").alias("raw"))
    before = (none if stored is None else stored.select("doc_id", "file_name")).select("doc_id", "file_name", F.lit(True).alias("__was"))
    read = articles.cached_or_new(found, raw).drop("cached").join(before, ["doc_id", "file_name"], "left")
    again = articles.resumed(of(raw, "resume")).withColumn("__was", F.lit(True))
    rows = read.select(*NAMES, "__was").unionByName(again.select(*NAMES, "__was"))
    return rows.join(mode, "doc_id").select(*NAMES, "mode", F.coalesce("__was", F.lit(False)).alias("cached"))
