"""Parsers as Arrow functions: HTML to outline text, file type by magic bytes, DOCX body text."""

from __future__ import annotations

import io
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_SKIP = {"nav", "footer", "header", "aside", "script", "style"}
_HEADS = {"h1": "#", "h2": "##", "h3": "###", "h4": "####"}
_TEXT = {"p", "li", "td", "th", *_HEADS}


class _Outline(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.skip = 0
        self.open: list[tuple[str, list[str]]] = []

    def _close(self) -> None:
        tag, parts = self.open.pop()
        line = " ".join("".join(parts).split())
        if line:
            self.lines.append(f"{_HEADS[tag]} {line}" if tag in _HEADS else line)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self.skip += 1
        elif tag in _TEXT and not self.skip:
            while self.open and self.open[-1][0] == tag:
                self._close()
            self.open.append((tag, []))

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in _TEXT and any(t == tag for t, _ in self.open):
            while self.open[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        if not self.skip and self.open:
            self.open[-1][1].append(data)


def outline(html: str | None) -> str:
    """Headings as ``#`` lines, paragraphs, list items and cells as lines; navigation, scripts and styles left out."""
    if not html:
        return ""
    p = _Outline()
    p.feed(html)
    p.close()
    while p.open:
        p._close()
    return "\n".join(p.lines)


@F.pandas_udf(StringType())
def html_markdown(c: pd.Series) -> pd.Series:
    return c.map(outline)


def file_kind(content: Column) -> Column:
    """pdf, ole, zip, text or null, from the first bytes; text has under five percent of control bytes."""
    head = F.hex(F.substring(content, 1, 8))
    text = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    bad = F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("D0CF11E0A1B11AE1"), "ole").when(head.startswith("504B0304"), "zip").when((F.length(content) > 0) & (bad < 0.05 * F.length(text)), "text")


def docx_outline(data: bytes) -> str:
    """Body paragraphs of a DOCX file in order, headings as ``#`` lines, table rows as ``|`` lines."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t")).strip()
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{w}p":
            style = e.find(f"{w}pPr/{w}pStyle")
            name = (style.get(f"{w}val") or "") if style is not None else ""
            level = next((int(c) for c in name if c.isdigit()), 0) if name.lower().startswith("heading") else 0
            if line := text(e):
                out.append(f"{'#' * level} {line}" if 1 <= level <= 4 else line)
        elif e.tag == f"{w}tbl":
            for row in e.iter(f"{w}tr"):
                cells = list(dict.fromkeys(text(c) for c in row.iter(f"{w}tc")))
                out.append(f"| {' | '.join(cells)} |")
    return "\n".join(out)


@F.pandas_udf(StringType())
def docx_markdown(c: pd.Series) -> pd.Series:
    return c.map(lambda b: docx_outline(bytes(b)) if b is not None else "")
