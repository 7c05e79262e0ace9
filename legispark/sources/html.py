"""HTML to clean text that keeps block structure, as an Arrow-batched UDF over the standard library's parser.

Comments are dropped and text after a removed element is kept; white space and markers are normalised line by line.
"""

from __future__ import annotations

import json
import re
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legispark.functions.text import FILLER, FILLER_PLACEHOLDER, MARKERS

# Element names of HTML by their effect on text, and the markers of tables.
REMOVED = {"title", "script", "style", "noscript", "iframe", "svg", "canvas", "object", "embed"}
IN_HEAD = {"head", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
BLOCKS = {"address", "article", "aside", "blockquote", "caption", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "legend", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
TABLE_START, TABLE_HEADERS, TABLE_ROW, TABLE_END = "[[TABLE_START]]", "[[TABLE_HEADERS]]", "[[TABLE_ROW]]", "[[TABLE_END]]"
VERSION = "1"
_MARKERS = tuple((re.compile(pattern), close) for pattern, close in MARKERS)


class _Reader(HTMLParser):
    """Collects text; tables become marker lines, nested tables follow the one that holds them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.head = False
        self.tables: list[dict] = []
        self.waiting: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        # A head ends with its end tag or, where that is missing, with the first element that belongs to a body.
        self.head = tag == "head" or (self.head and tag in IN_HEAD)
        if tag == "head":
            return
        if tag in REMOVED:
            self.skip += tag != "embed"
        elif self.skip:
            pass
        elif tag == "table":
            self.tables.append({"rows": [], "row": None, "cell": None})
        elif self.tables and tag == "tr":
            self.tables[-1]["row"] = {"cells": [], "head": False}
        elif self.tables and tag in ("td", "th"):
            table = self.tables[-1]
            self._close_cell()
            table["row"] = table["row"] or {"cells": [], "head": False}
            table["row"]["head"] |= tag == "th"
            table["cell"] = []
        elif tag == "br" or tag in BLOCKS:
            self._add("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.head = False
        elif tag in REMOVED:
            self.skip = max(0, self.skip - 1)
        elif self.skip:
            pass
        elif self.tables and tag in ("td", "th"):
            self._close_cell()
        elif self.tables and tag == "tr":
            self._close_row()
        elif self.tables and tag == "table":
            self._close_row()
            lines, done = self._lines(self.tables.pop()["rows"]), not self.tables
            if done:
                self.out.append("\n".join(["", *lines, *self.waiting, ""]))
                self.waiting = []
            else:
                self.waiting += lines
        elif tag in BLOCKS:
            self._add("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip and not self.head:
            self._add(data)

    def _add(self, text: str) -> None:
        if not self.tables:
            self.out.append(text)
        elif self.tables[-1]["cell"] is not None:
            self.tables[-1]["cell"].append(text)

    def _close_cell(self) -> None:
        table = self.tables[-1]
        if table["cell"] is not None and table["row"] is not None:
            table["row"]["cells"].append(" ".join("".join(table["cell"]).split()))
        table["cell"] = None

    def _close_row(self) -> None:
        self._close_cell()
        table = self.tables[-1]
        if table["row"] and any(table["row"]["cells"]):
            table["rows"].append(table["row"])
        table["row"] = None

    @staticmethod
    def _lines(rows: list[dict]) -> list[str]:
        if not rows:
            return []
        head = next((k for k, r in enumerate(rows) if r["head"]), None)
        out = [TABLE_START]
        if head is not None:
            out.append(TABLE_HEADERS + json.dumps(rows[head]["cells"], ensure_ascii=False))
        return [*out, *(TABLE_ROW + json.dumps(r["cells"], ensure_ascii=False) for k, r in enumerate(rows) if k != head), TABLE_END]


def _line(line: str) -> str:
    line = re.sub(FILLER, FILLER_PLACEHOLDER, re.sub(r"[ \t\f\v]+", " ", line))
    line = re.sub(r"\s+([,.;:!?])", r"\1", line).strip()
    for pattern, close in _MARKERS:
        m = pattern.match(line)
        if m:
            return f"{m[1]}{close} {line[m.end():].strip()}".strip()
    m = re.match(r"^[•●▪▫◦‣⁃∙]\s*", line)
    return f"- {line[m.end():].strip()}".strip() if m else line


def clean_html(html: str | None) -> str:
    """Lines of visible text, with at most one blank line between others."""
    if not html:
        return ""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    text = unicodedata.normalize("NFC", "".join(reader.out))
    text = re.sub(r"[\u200b\u200c\u200d\u2060\ufeff]", "", re.sub(r"[\u00a0\u202f\u2007]", " ", text)).replace("\r\n", "\n").replace("\r", "\n")
    lines: list[str] = []
    for raw in text.split("\n"):
        line = raw if raw.startswith("[[TABLE_") else _line(raw)
        if line or (lines and lines[-1]):
            lines.append(line)
    return "\n".join(lines).strip()


def meaningful(text: Column) -> Column:
    """Whether a text has a letter or digit beside the marks that the cleaner itself writes."""
    for mark in (FILLER_PLACEHOLDER, TABLE_START, TABLE_HEADERS, TABLE_ROW, TABLE_END):
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text.rlike(r"[\p{L}\p{N}]")


def clean_status(html: Column, clean: Column, failed: Column | None = None) -> Column:
    """What became of a page: ok, source_null, source_blank, no_visible_text, no_meaningful_text, cleaner_empty, parse_error or clean_error.

    ``clean`` is the cleaned text, null where the cleaner could not read the page; ``failed`` tells that it raised.
    """
    visible = F.trim(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|noscript|title)\b.*?(</\1\s*>|$)|<!--.*?(-->|$)", ""), "<[^>]*>", ""))
    out = F.when(clean != "", F.when(meaningful(clean), "ok").otherwise("no_meaningful_text"))
    out = out.when(html.isNull(), "source_null").when(F.trim(F.regexp_replace(html, r"\s+", " ")) == "", "source_blank")
    if failed is not None:
        out = out.when(failed, "clean_error")
    return out.when(clean.isNull(), "parse_error").when(F.regexp_replace(visible, r"\s+", "") == "", "no_visible_text").when(~meaningful(visible), "no_meaningful_text").otherwise("cleaner_empty")


def clean_pages(pages: DataFrame) -> DataFrame:
    """(id, content_clean, original_html_length, clean_text_length, clean_status, clean_error, cleaner_version) per page (page_id, html)."""

    @F.pandas_udf("content string, error string")
    def clean(html: pd.Series) -> pd.DataFrame:
        def one(h: str | None) -> tuple[str, str | None]:
            try:
                return clean_html(h), None
            except Exception as e:  # recorded per row: one bad page must not stop a batch
                return "", f"{type(e).__name__}: {e}"[:2000]

        return pd.DataFrame([one(h) for h in html], columns=["content", "error"])

    x = pages.select(F.col("page_id").alias("id"), "html", clean("html").alias("c"))
    status = clean_status(F.col("html"), F.col("c.content"), F.col("c.error").isNotNull())
    return x.select("id", F.col("c.content").alias("content_clean"), F.coalesce(F.length("html"), F.lit(0)).cast("long").alias("original_html_length"), F.length("c.content").cast("long").alias("clean_text_length"), status.alias("clean_status"), F.col("c.error").alias("clean_error"), F.lit(VERSION).alias("cleaner_version"))
