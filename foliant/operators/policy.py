"""Sensitive-term policies, routing and small governance predicates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.literals import Automaton, build
from foliant.sources.batches import bound_batches, joined, pieces, trimmed

MOST_HITS, MOST_PATTERN = 1000, 200
#: Actions that stop output, and what stands for a match where a policy names no replacement.
BLOCKING = ("BLOCK_DOC", "BLOCK_SNIPPET", "BLOCK_QA")
REDACTED = "[REDACTED]"
#: Words of one list; more take a table too large to send.
MOST_WORDS = 100_000
_NESTED = re.compile(r"\([^)]*[+*][^)]*\)[+*]")


@dataclass(frozen=True)
class Policy:
    id: int
    kind: str  # WORD or REGEX
    value: str
    action: str = "MASK"  # or one of BLOCKING; any other action only counts
    replacement: str = REDACTED
    stage: str = "ALL"
    subject_type: str = "ALL"
    subject_value: str = "*"  # or blank: everybody
    priority: int = 0
    active: bool = True

    def applies(self, stage: str, user: str = "", roles: tuple[str, ...] = (), depts: tuple[str, ...] = ()) -> bool:
        if not self.active or self.stage not in ("ALL", stage):
            return False
        value = self.subject_value.strip()
        who = {"ALL": True, "USER": value == user, "ROLE": value in roles, "DEPT": value in depts}
        return value in ("", "*") or who.get(self.subject_type, False)


def safe_regex(pattern: str) -> re.Pattern | None:
    """The compiled pattern, or None for long, nested-repetition, doubly unbounded or broken ones."""
    compact = re.sub(r"\s+", "", pattern)
    if len(pattern) > MOST_PATTERN or _NESTED.search(compact) or ".*.*" in compact:
        return None
    try:
        return re.compile(pattern)
    except re.error:
        return None


def occurrences(text: str, word: str, most: int = MOST_HITS) -> int:
    """Places where a word begins, overlapping ones too, counted up to ``most``."""
    n, at = 0, text.find(word) if word else -1
    while at >= 0 and n < most:
        n, at = n + 1, text.find(word, at + 1)
    return n


class Screen:
    """Policies in order of priority, with one automaton for all words.

    Each batch of texts is searched once for all words.  A text with hits then meets its policies in order: counts are of the
    text as it stands, so a mask is followed by another search of the masked texts of the batch, all together.
    """

    def __init__(self, policies: list[Policy]):
        self.policies = sorted(policies, key=lambda p: (-p.priority, p.id))
        self.words = [i for i, p in enumerate(self.policies) if p.kind != "REGEX" and p.value.strip()]
        self.automaton: Automaton = build([self.policies[i].value for i in self.words])
        self.regexes = {i: safe_regex(p.value) for i, p in enumerate(self.policies) if p.kind == "REGEX" and p.value.strip()}

    def _counts(self, texts: list[str]) -> list[dict[int, int]]:
        return [{self.words[w]: n for w, n in c.items()} for c in self.automaton.counts(texts, MOST_HITS)]

    def run(self, texts: list[str | None]) -> list[tuple[str, bool, list[tuple[int, int]]]]:
        """For each text: itself after masking, whether it is blocked (then empty), and (policy, hits) in order."""
        out = [t or "" for t in texts]
        blocked, found, at = [False] * len(out), [[] for _ in out], [0] * len(out)
        open_ = list(range(len(out)))
        while open_:
            masked = []
            for row, counts in zip(open_, self._counts([out[i] for i in open_]), strict=True):
                due = sorted(i for i in {*counts, *self.regexes} if i >= at[row])
                for i in due:
                    p, rx = self.policies[i], self.regexes.get(i)
                    if i in self.regexes:
                        n = sum(1 for _, _ in zip(rx.finditer(out[row]), range(MOST_HITS), strict=False)) if rx else 0
                    else:
                        n = counts[i]
                    if not n:
                        continue
                    found[row].append((p.id, n))
                    if p.action in BLOCKING:
                        out[row], blocked[row] = "", True
                        break
                    if p.action == "MASK":
                        put = p.replacement.strip() or REDACTED
                        out[row] = rx.sub(lambda _, put=put: put, out[row]) if rx else out[row].replace(p.value, put)
                        at[row] = i + 1
                        masked.append(row)
                        break
            open_ = masked
        return list(zip(out, blocked, found, strict=True))


def filter_text(text: str | None, policies: list[Policy]) -> tuple[str, bool, list[int], int]:
    """Text after masking in order of priority, whether it is blocked, the ids that matched, and hits counted before each mask."""
    ((out, blocked, hits),) = Screen(policies).run([text])
    return out, blocked, [i for i, _ in hits], sum(n for _, n in hits)


SCREENED = "text string, blocked boolean, matched array<int>, hits long, each array<struct<policy:int,hits:long>>"


def apply_policies(policies: list[Policy], stage: str = "ALL", **who) -> Callable[[Column | str], Column]:
    """An Arrow function text -> struct(text, blocked, matched, hits, each); the automaton is broadcast, ``build`` checks its size."""
    mine = [p for p in policies if p.applies(stage, **who)] if stage != "ALL" or who else [p for p in policies if p.active]
    bound_batches(SparkSession.active())
    shared = SparkSession.active().sparkContext.broadcast(Screen(mine))

    def screened(texts: list[str | None]) -> pd.DataFrame:
        rows = shared.value.run(texts)
        each = [[{"policy": i, "hits": n} for i, n in hits] for _, _, hits in rows]
        return pd.DataFrame({"text": [r[0] for r in rows], "blocked": [r[1] for r in rows], "matched": [[h["policy"] for h in e] for e in each], "hits": [sum(h["hits"] for h in e) for e in each], "each": each})

    @F.pandas_udf(SCREENED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from trimmed(lambda cs: (joined([screened(p) for p in pieces(c)], screened([])) for c in cs))(batches)

    return run


def word_counts(rows: DataFrame, words: list[str], id_col: str, text_col: str, most: int = MOST_HITS) -> DataFrame:
    """(id, word, hits): how often each of ``words`` begins in a text, overlapping places too, up to ``most``; one pass for all.

    A null or empty text holds nothing; words that repeat are counted once; empty words never occur.
    """
    named = sorted({w for w in words if w})
    bound_batches(SparkSession.active())
    shared = SparkSession.active().sparkContext.broadcast((build(named), named))

    def counted(texts: list[str | None]) -> pd.Series:
        machine, names = shared.value
        return pd.Series([[{"word": names[w], "hits": n} for w, n in sorted(x.items())] for x in machine.counts([t or "" for t in texts], most)], dtype=object)

    @F.pandas_udf("array<struct<word:string,hits:long>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from trimmed(lambda cs: (joined([counted(p) for p in pieces(c)], counted([])) for c in cs))(batches)

    return rows.select(F.col(id_col), F.explode(run(F.col(text_col))).alias("h_")).select(id_col, "h_.word", "h_.hits")


def route(rows: DataFrame, routes: DataFrame, key: str, default: str) -> DataFrame:
    """Target of each row by its key, else the default; the routing table is a small dimension and broadcast."""
    return rows.join(F.broadcast(routes), key, "left").withColumn("target", F.coalesce("target", F.lit(default)))


def missing_any(*cols: Column) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | c.isNull() | (c == "")
    return out


def nearest_position(n: int, p: float) -> int:
    """Position of a nearest-rank percentile: halves go to even, as Python rounds."""
    return min(n - 1, max(0, round((n - 1) * p)))


def screen_rows(rows: DataFrame, fields: list[str], policies: list[Policy], stage: str = "ALL", **who) -> DataFrame:
    """Rows with their text fields masked, ``sensitive_filtered`` (whether any changed), ``blocked``, and ``hits``: an array of
    (field, policies, hits, each) of the fields up to the first that blocks the row; ``each`` has every policy's own hits.
    A null field stays null and holds nothing."""
    run = apply_policies(policies, stage, **who)
    some = F.array().cast("array<struct<field:string,policies:array<int>,hits:bigint,each:array<struct<policy:int,hits:bigint>>>>")
    out = rows.withColumns({f"_r_{f}": run(f) for f in fields})
    blocked, changed, hits = F.lit(False), F.lit(False), some
    for f in fields:
        r = F.col(f"_r_{f}")
        found = ~blocked & F.col(f).isNotNull() & (F.size(r["matched"]) > 0)
        hits = F.when(found, F.concat(hits, F.array(F.struct(F.lit(f).alias("field"), r["matched"].alias("policies"), r["hits"].alias("hits"), r["each"].alias("each"))))).otherwise(hits)
        changed = changed | (F.col(f).isNotNull() & (r["text"] != F.col(f)))
        blocked = blocked | (F.col(f).isNotNull() & r["blocked"])
    out = out.withColumns({"sensitive_filtered": changed, "blocked": blocked, "hits": hits})
    return out.withColumns({f: F.when(F.col(f).isNotNull(), F.col(f"_r_{f}.text")) for f in fields}).drop(*(f"_r_{f}" for f in fields))
