"""Inputs: what a source string is, and web pages as markdown."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = re.compile(r"\s+")


def source_kind(value: Column, content_type: Column) -> Column:
    """pdf or url; not http(s) is a local pdf; a failed or missing content type makes it a web page."""
    web = value.startswith("http://") | value.startswith("https://")
    return F.when(~web, "pdf").when(F.lower(value).endswith(".pdf") | F.coalesce(content_type.contains("application/pdf"), F.lit(False)), "pdf").otherwise("url")


def raw_url(value: Column) -> Column:
    """A blob page of the code host stands for its raw file."""
    return F.regexp_replace(value, r"^https?://github\.com/([^/]+)/([^/]+)/blob/(.+)$", "https://raw.githubusercontent.com/$1/$2/$3")


def download_name(value: Column) -> Column:
    """Last part of the path, with .pdf, and only word characters, dots and dashes."""
    path = F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]+://[^/]*", ""), r"[?#].*$", "")
    name = F.regexp_extract(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"([^/]*)$", 1)
    name = F.when(name == "", "download.pdf").otherwise(name)
    name = F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
    return F.regexp_replace(name, r"(?U)[^\w.\-]", "_")


class _Markdown(HTMLParser):
    """Main text of a page: headings, paragraphs, list items, bold and italic words, tables; texts of links without their targets, no
    images; scripts, navigation and the like are left out."""

    OUT = frozenset({"script", "style", "nav", "header", "footer", "aside", "noscript", "form", "head"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0
        self.rows = self.cells = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.OUT:
            self.hidden += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.parts.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "table", "ul", "ol"):
            self.parts.append("\n\n")
            self.rows = 0 if tag == "table" else self.rows
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag == "br":
            self.parts.append("\n")
        elif tag == "tr":
            self.parts.append("\n|")
            self.cells = 0
        elif tag in ("td", "th"):
            self.parts.append(" ")
            self.cells += 1
        elif tag in ("b", "strong"):
            self.parts.append("**")
        elif tag in ("i", "em"):
            self.parts.append("*")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.OUT:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("b", "strong"):
            self.parts.append("**")
        elif tag in ("i", "em"):
            self.parts.append("*")
        elif tag in ("td", "th"):
            self.parts.append(" |")
        elif tag == "tr":
            self.parts.append("\n|" + "---|" * self.cells if self.rows == 0 else "")
            self.rows += 1
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "div"):
            self.parts.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(SPACE.sub(" ", data))


def page_markdown(html: str) -> str:
    p = _Markdown()
    p.feed(html)
    t = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(p.parts))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


@F.pandas_udf(T.StringType())
def _markdown(c: pd.Series) -> pd.Series:
    return c.map(page_markdown, na_action="ignore")


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """page_id, url, markdown, error: an empty or missing page is an error."""
    md = pages.select("page_id", "url", "html", _markdown("html").alias("markdown"))
    return md.select("page_id", "url", F.nullif("markdown", F.lit("")).alias("markdown"), F.when(F.col("html").isNull(), "no page").when(F.coalesce("markdown", F.lit("")) == "", "no text").alias("error"))
