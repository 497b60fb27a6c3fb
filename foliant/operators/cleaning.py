"""Cleaning of documents line by line, structural noise, and quality gates."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import strip
from foliant.sources.tables import spread

#: Words that mark a line as a watermark when they are all of it.
WATERMARKS = ("内部文件", "内部资料", "内部使用", "仅供内部使用", "绝密", "机密", "秘密", "保密", "请勿外传", "严禁外传", "禁止复制")
LEAST_EFFECTIVE = 10


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line_no, line), lines cut at line feeds, runs of blanks collapsed."""
    cut = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return cut.withColumn("line", strip(F.regexp_replace("line", r"[ \t　]+", " ")))


def noise_reason(line: Column) -> Column:
    """Why a line is noise, or null: broken encoding, repeated characters, watermarks."""
    n = F.length(line)
    fffd = n - F.length(F.replace(line, F.lit("�"), F.lit("")))
    return (
        F.when(line == "", "blank").when((n > 5) & (fffd / n > 0.3), "encoding").when(line.rlike(r"([一-龥])\1{3,}"), "repeated")
        .when(line.rlike(r"(.)\1{7,}"), "repeated").when(line.rlike(r"^[一-龥×]{1,2}$"), "fragment")
        .when((n <= 10) & line.isin(*WATERMARKS), "watermark").when(line.rlike(r"^\|[\s|-]+\|$"), "separator")
    )


def effective_chars(text: Column) -> Column:
    """Ideographs, ASCII letters and digits."""
    return F.regexp_count(text, F.lit(r"[一-龥A-Za-z0-9]"))


_REPEATED, _ANY_REPEATED = re.compile(r"([一-龥])\1{3,}"), re.compile(r"(.)\1{7,}")
_FRAGMENT, _SEPARATOR = re.compile(r"^[一-龥×]{1,2}$"), re.compile(r"^\|[\s|-]+\|$")


def _is_noise(line: str) -> bool:
    """Broken encoding, runs of one character, seal fragments, watermark words."""
    return (len(line) > 5 and line.count("\ufffd") / len(line) > 0.3) or bool(_ANY_REPEATED.search(line) or _FRAGMENT.match(line)) or (len(line) <= 10 and line in WATERMARKS)


def _is_marked(line: str) -> bool:
    """Watermarks: an ideograph four times over, table separators, table rows of one ideograph."""
    if _REPEATED.search(line):
        return True
    if not (line.startswith("|") and line.endswith("|")):
        return False
    cells = {c for c in (x.strip() for x in line.split("|")) if c and c != "---"}
    return bool(_SEPARATOR.match(line)) or (len(cells) == 1 and bool(re.fullmatch("[一-龥]", next(iter(cells)))))


def clean_text(text: str | None, margins: bool = False) -> str:
    """One text without its noise: of a run of equal lines two stay; under ten effective characters nothing does.

    With ``margins`` lines of at most 30 characters that occur three times or more go as well.
    """
    rows = [(x, x.strip()) for x in (text or "").splitlines()]
    often = {x for x, n in Counter(s for _, s in rows if s and len(s) <= 30).items() if n >= 3} if margins else ()
    out: list[str] = []
    before, again = None, 0
    for line, s in rows:
        if not s:
            before, again = s, 0
            continue
        if s in often or _is_marked(s):
            continue
        again = again + 1 if s == before else 0
        if again >= 2 or _is_noise(s):
            continue
        before = s
        out.append(line)
    cleaned = "\n".join(out)
    return cleaned if len(re.findall(r"[一-龥A-Za-z0-9]", cleaned)) >= LEAST_EFFECTIVE else ""


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", margins: bool = False) -> DataFrame:
    """(id, cleaned) of every document row, null texts empty: a narrow Arrow stage in which lines never leave their document."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: clean_text(t, margins))

    return spread(docs.select(id_col, text_col)).select(id_col, cleaned(F.coalesce(F.col(text_col), F.lit(""))).alias("cleaned"))


def frequent_short_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = 30, times: int = 3) -> DataFrame:
    """Short lines that come again and again in a document: (id, line, n)."""
    short = lines(docs, id_col, text_col).where((F.col("line") != "") & (F.length("line") <= chars))
    return short.groupBy(id_col, "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= times)


def structural_policy(kind: Column, comments: str = "drop", footnotes: str = "metadata_only") -> Column:
    """keep_for_index, keep_for_metadata and reason for headers, footers, comments, notes and watermarks."""
    def of(index: bool, meta: bool, reason: str) -> Column:
        return F.struct(F.lit(index).alias("keep_for_index"), F.lit(meta).alias("keep_for_metadata"), F.lit(reason).alias("noise_reason"))

    policies = {"drop": (False, False), "metadata_only": (False, True), "keep": (True, True)}
    return (
        F.when(kind.isin("header", "footer"), of(False, True, "page_margin")).when(kind == "watermark", of(False, False, "watermark"))
        .when(kind == "comment", of(*policies[comments], "comment")).when(kind.isin("footnote", "endnote"), of(*policies[footnotes], "note"))
        .otherwise(F.struct(F.lit(True).alias("keep_for_index"), F.lit(True).alias("keep_for_metadata"), F.lit(None).cast("string").alias("noise_reason")))
    )


def repeated_margins(boxes: DataFrame, margin: float = 0.10, times: int = 2) -> DataFrame:
    """Boxes (doc_id, page_idx, y0, y1, text) with ``drop``: texts that recur in a page's top or bottom margin, page numbers too."""
    page = Window.partitionBy("doc_id", "page_idx")
    out = boxes.withColumn("height", F.max("y1").over(page))
    out = out.withColumn("zone", F.when(F.col("y1") <= F.col("height") * margin, "top").when(F.col("y0") >= F.col("height") * (1 - margin), "bottom"))
    mark = F.regexp_replace(F.regexp_replace(strip(F.col("text")), r"\d{4}[-/.年]\d{1,2}[-/.月]\d{1,2}日?", "<date>"), r"\d+", "<n>")
    out = out.withColumn("mark", mark)
    same = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "zone", "mark"))
    number = F.col("mark").rlike(r"^(第?\s*<n>\s*页?|- ?<n> ?-|<n>\s*/\s*<n>|(?i)page <n>( of <n>)?)$")
    return out.withColumn("drop", F.col("zone").isNotNull() & ((same >= times) | number))


def parse_gate(pages: DataFrame) -> DataFrame:
    """Page statuses (doc_id, status) -> coverage and ERROR (under .5), PARTIAL (under .98) or OK."""
    ratio = F.sum(F.when(F.col("status") == "SUCCESS", 1).otherwise(0)) / F.count(F.lit(1))
    return pages.groupBy("doc_id").agg(ratio.alias("coverage")).withColumn("gate", F.when(F.col("coverage") < 0.5, "ERROR").when(F.col("coverage") < 0.98, "PARTIAL").otherwise("OK"))


def write_gate(ok: Column, failed: Column, most: float = 0.05) -> Column:
    return F.when(failed / F.greatest(ok + failed, F.lit(1)) > most, "ERROR").when(failed > 0, "PARTIAL").otherwise("OK")
