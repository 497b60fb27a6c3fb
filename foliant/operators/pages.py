"""Pages of chunks: where in a marked text a chunk stands, exactly, by its beginning, or with all white space left out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The marker of a page, the length of a chunk's beginning, and least and most of the probes of its ends.
PAGE = re.compile(r"<!--\s*PAGE_START:\s*(\d+)\s*-->")
HEAD, PROBE_LEAST, PROBE_MOST, PROBE_SHARE = 30, 20, 80, 3
_SPACE = re.compile(r"\s+")


def _squeezed(text: str) -> str:
    return _SPACE.sub("", PAGE.sub(" ", text))


def page_ranges(raw: str | None, chunks: list[str | None]) -> list[tuple[int, int]]:
    """(first, last) page of each chunk, (0, 0) where it isn't found or the text has no pages.

    A chunk is looked for as it is, then by its first characters (and is held to be as long as it says), then page by page
    without white space: as a part of the page, the page as a part of it, or by either of its ends.
    """
    marks = [(int(m[1]), m.start(), m.end()) for m in PAGE.finditer(raw or "")]
    if not marks:
        return [(0, 0)] * len(chunks)
    ends = [start for _, start, _ in marks[1:]] + [len(raw)]
    bare: list[str] = []  # squeezed pages, made when first needed

    def spread_over(at: int, size: int) -> tuple[int, int]:
        first = next((n for n, start, _ in reversed(marks) if start <= at), marks[0][0])
        return first, next((n for n, start, _ in reversed(marks) if start < at + size), first)

    def squeezed(chunk: str) -> tuple[int, int]:
        body = _squeezed(chunk)
        if not body:
            return 0, 0
        if not bare:
            bare.extend(_squeezed(raw[begin:end]) for (_, _, begin), end in zip(marks, ends, strict=True))
        size = min(PROBE_MOST, max(PROBE_LEAST, len(body) // PROBE_SHARE))
        hit = [n for (n, _, _), page in zip(marks, bare, strict=True) if page and (body in page or page in body or body[:size] in page or body[-size:] in page)]
        return (min(hit), max(hit)) if hit else (0, 0)

    def one(chunk: str | None) -> tuple[int, int]:
        if not chunk:
            return 0, 0
        at = raw.find(chunk)
        if at < 0 and (head := chunk[:HEAD].strip()):
            at = raw.find(head)
        return spread_over(at, len(chunk)) if at >= 0 else squeezed(chunk)

    return [one(c) for c in chunks]


def with_pages(docs: DataFrame, raw: str, chunks: str) -> DataFrame:
    """``docs`` with ``pages``: for each text of the array ``chunks`` its first and last page in ``raw``; a document's text is read once."""

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for raws, lists in batches:
            yield pd.Series([[{"first": a, "last": b} for a, b in page_ranges(r if isinstance(r, str) else None, [] if c is None else list(c))] for r, c in zip(raws, lists, strict=True)])

    return docs.withColumn("pages", run(raw, chunks))
