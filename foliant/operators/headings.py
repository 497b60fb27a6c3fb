"""Structure of official documents: headings with their paths, blocks of text, tables as sentences, heading stacks.

A line is a heading by its numbering, or, without any, by what stands around it (a blank line before or after) and by how it
looks.  A rule says how much of the path so far stays above a heading and how it is named.  Lines are classified first, with the
zones they stand in, and then gathered into blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.sources.tables import spread

#: Heading forms in order, how many parts of the path stay above them, and where in the line their name is.
HEADINGS = tuple(
    (re.compile(pattern), kept)
    for pattern, kept in (
        (r"^\*\*(?P<name>[一二三四五六七八九十]+、)(?=.+\*\*$)", 0),
        (r"^\*\*(?P<name>（[一二三四五六七八九十\d]+）)(?=.+\*\*$)", 1),
        (r"^\*\*(?P<name>[一二三四五六七八九十]+。|第[\d一二三四五六七八九十百千零]+[章节篇条]|\d+[\.、])(?=.+\*\*$)", 0),
        (r"^#\s+(?P<name>.+)$", 0),
        (r"^##\s+(?P<name>.+)$", 1),
        (r"^#{3,4}\s+(?P<name>.+)$", 2),
        (r"^(?P<name>第[一二三四五六七八九十百千零\d]+[章节篇])[　\s]", 0),
        (r"^(?P<name>[一二三四五六七八九十]+、)", 0),
        (r"^(?P<name>（[一二三四五六七八九十\d]+）)", 1),
        (r"^(?P<name>\([一二三四五六七八九十一-龥]+\))", 1),
        (r"^(?P<name>\d+\.)(?!\d)", 2),
        (r"^(?P<name>\d+、)", 2),
        (r"^(?P<name>[一二三四五六七八九十]+是)", 1),
    )
)
#: The last form is named by the first three characters of its line.
ENUMERATED, ENUMERATED_NAME = HEADINGS[-1][0], 3
#: Fixed values of headings without a number: lengths, what rules them out, what they end in.
NAKED_LEAST, NAKED_MOST, NOUN_MOST = 2, 20, 6
NOT_NAKED = re.compile(
    r"[。！？；]$|^(?:为|根据|依据|按照|经|经过|鉴于|基于|现将|特此|请|要求|确保|加强|推进|落实|完成|开展|组织|制定|建立|健全|坚持|积极|全面|深入|继续|进一步|深化|持续|切实|严格|统筹|协调|规范|优化|提升|创新|强化|完善|推动|实施|执行|贯彻)"
    r"|^[（(].+[）)]$|^[\d\s年月日\-/：:一二三四五六七八九十第页共]+$|(?:如下|以下|如下所述)[：:]?\s*$"
)
NAKED_END = re.compile(r"(?:目标|任务|要求|措施|背景|原则|意义|现状|问题|方向|方案|规定|管理|建设|保障|机制|说明|计划|部署|安排|步骤|流程|内容|情况|分析|概述|总结|展望|结论|附则|定义|范围|职责|权限|处罚|奖励|监督|评估|验收|移交)$")
VERB = re.compile(r"[了着过]|[不未已][^一-龥]{0,1}[^一-龥]?[一-龥]")
#: Document numbers, and the zones at the head of a document and in its annexes.
DOC_NUMBER = re.compile(r".*(?:〔\d{4}〕\d+号|\(\d{4}\).{1,10}第\d+号|（\d{4}）.{1,10}第\d+号|令第\d+号|公告第\d{4}[-–]\d+号|(?<![年月日期])第\d{1,4}号).*")
HEAD_DATE, HEAD_ADDRESS = re.compile(r"^\d{4}年\d{1,2}月\d{1,2}日$"), re.compile(r"^(?:各|指)[^，。]{0,30}[：:]\s*$")
FORMAL = re.compile(r"^(?:#{1,4}\s|第[一-龥\d]+[章节篇]|[一二三四五六七八九十]+、)")
ANNEX = re.compile(r"^(?:附件|附录)[一二三四五六七八九十\d]*[：:\s]")
#: Data rows of one table text, cells that say nothing.
TABLE_ROWS, VOID_CELLS = 20, ("-", "--", "—")


@dataclass(frozen=True)
class Block:
    kind: str  # body, table or doc_num
    path: tuple[str, ...]
    text: str


def naked_heading(line: str, open_side: bool) -> bool:
    """A short line without number beside a blank one that looks like a title: it ends like one, or is a few characters without a verb's mark."""
    if not open_side or not NAKED_LEAST <= len(line) <= NAKED_MOST or NOT_NAKED.search(line):
        return False
    return bool(NAKED_END.search(line)) or (len(line) <= NOUN_MOST and not VERB.search(line))


def heading_path(line: str, path: tuple[str, ...], open_side: bool = False) -> tuple[str, ...] | None:
    """The path from a heading on, or None where a (stripped) line is none."""
    for form, kept in HEADINGS:
        if m := form.match(line):
            return (*path[:kept], line[:ENUMERATED_NAME] if form is ENUMERATED else m["name"])
    return (line,) if naked_heading(line, open_side) else None


def classified(lines: list[str], persons: tuple[str, ...] = ()) -> Iterator[tuple[str, str, tuple[str, ...], bool]]:
    """(kind, line, path, begins) of every line; kinds are blank, table, number and body, ``begins`` opens a block.

    Before the first formal heading, dates and addresses are body whatever is around them.  From an annex on, nothing
    deepens the path.  Lines that begin with one of ``persons`` open a block.
    """
    path: tuple[str, ...] = ()
    head, annex = True, False
    blank = [not x.strip() for x in lines]
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            yield "blank", "", path, True
        elif s.startswith("|") and s.endswith("|"):
            yield "table", line, path, False
        elif DOC_NUMBER.match(line):
            yield "number", s, path, True
        else:
            begins = s.startswith(persons) if persons else False
            head = head and not FORMAL.match(s)
            if head and (HEAD_DATE.match(s) or HEAD_ADDRESS.match(s)):
                yield "body", line, path, begins
                continue
            annex = annex or bool(ANNEX.match(s))
            found = heading_path(s, path, i == 0 or blank[i - 1] or i + 1 == len(lines) or blank[i + 1])
            if found and not (annex and len(found) > len(path)):
                path = found
                yield "body", s, path, True
            else:
                yield "body", line, path, begins


def flat_table(lines: list[str]) -> list[str]:
    """A table's rows as sentences ("header is value"), twenty rows a text; two lines or fewer are joined as they are."""
    if len(lines) < 3:
        return [" ".join(lines)]
    cells = lambda line: [c.strip() for c in line.split("|") if c.strip()]
    headers, rows, out = cells(lines[0]), lines[2:], []
    for n in range(0, max(len(rows), 1), TABLE_ROWS):
        part = rows[n : n + TABLE_ROWS]
        said = []
        for row in part:
            pairs = [f"{headers[i] if i < len(headers) else f'第{i + 1}项'}为{v}" for i, v in enumerate(cells(row)) if v not in VOID_CELLS]
            if pairs:
                said.append("，".join(pairs) + "。")
        mark = f"[表格数据第{n // TABLE_ROWS + 1}组] " if n else "[表格数据] "
        out.append(mark + " ".join(said or part))
    return out


def blocks(text: str | None, persons: tuple[str, ...] = ()) -> list[Block]:
    """Blocks in order; a null or empty text has none.

    Blank lines, headings, tables and document numbers part blocks; a heading is the first line of its block.  A document
    number goes before the next body text (of two in a row the later), and is a block of its own only where none follows.  A
    table of one row carries the body line before it.
    """
    out: list[Block] = []
    number, before, nth = "", "", 0
    marked = []
    last = ""
    for kind, line, path, begins in classified((text or "").splitlines(), persons):
        nth += begins or kind != last
        marked.append((nth, kind, line, path))
        last = kind
    for (_, kind), rows in groupby(marked, key=lambda r: (r[0], r[1])):
        held = list(rows)
        lines, path = [r[2] for r in held], held[-1][3]
        if kind == "body":
            out.append(Block("body", path, "\n".join([number] * bool(number) + ["\n".join(lines).strip()])))
            number = ""
        elif kind == "table":
            caption = f"[表格说明: {before}]\n" if before and len(lines) == 1 else ""
            out += [Block("table", path, (caption if i == 0 else "") + t) for i, t in enumerate(flat_table(lines))]
        elif kind == "number":
            number = lines[-1]
        before = lines[-1].strip() if kind == "body" else ""
    return out + [Block("doc_num", (), number)] * bool(number)


#: Numbered titles of extracted pages and their levels; what is cut off a title's front.
TITLES = ((re.compile(r"^\d+\.\d+\.\d+\s+"), 3), (re.compile(r"^\d+\.\d+\s+"), 2), (re.compile(r"^第[一二三四五六七八九十百]+[章节回]\s+"), 1))
TITLE_FRONT = re.compile(r"^(?:#+\s+|第.*?[章节回]\s+|\d+(?:\.\d+)*\s+)")


def title_level(text: str, kind: str) -> int:
    """Level of an element that is a title by its number or its kind, else 0."""
    found = next((level for form, level in TITLES if form.match(text.strip())), 0)
    return found or (0 if kind != "title" else 3 if text.startswith("### ") else 2 if text.startswith("## ") else 1)


def context_stacks(elements: list[tuple[str, str]]) -> list[list[str]]:
    """Titles above each (text, kind) element, itself included: a title closes those of its level and below."""
    stack: list[str] = []
    out = []
    for text, kind in elements:
        if text and (level := title_level(text, kind)):
            name = TITLE_FRONT.sub("", text).strip()
            stack = [*(stack[: level - 1] if len(stack) >= level else stack), *[name] * bool(name)]
        out.append(stack)
    return out


def document_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", persons: tuple[str, ...] = ()) -> DataFrame:
    """(id, n, kind, path, content): the blocks of every text, numbered from 0."""

    @F.pandas_udf("array<struct<kind:string,path:string,content:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in batches:
            yield pd.Series([[{"kind": b.kind, "path": "/".join(b.path), "content": b.text} for b in blocks(t if isinstance(t, str) else None, persons)] for t in c])

    return spread(docs.select(id_col, text_col)).select(id_col, F.posexplode(run(text_col)).alias("n", "b")).select(id_col, "n", "b.*")


def element_contexts(elements: DataFrame, id_col: str, order: str, text: str, kind: str) -> DataFrame:
    """(id, order, text, context): elements of pages with the titles above them, as ``[Context: A > B] ``.

    A document's elements meet in one row as small as its text; ``order`` tells them apart.
    """

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in batches:
            yield pd.Series([[f"[Context: {' > '.join(s)}] " if s else "" for s in context_stacks([(e["text"] or "", e["kind"]) for e in row])] for row in c])

    rows = elements.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("order"), F.col(text).alias("text"), F.col(kind).alias("kind")))).alias("e"))
    each = rows.select(id_col, F.explode(F.arrays_zip("e", run(F.transform("e", lambda x: F.struct(x["text"].alias("text"), x["kind"].alias("kind")))).alias("context"))).alias("x"))
    return each.select(id_col, F.col("x.e.order").alias(order), F.col("x.e.text").alias(text), F.col("x.context").alias("context"))
