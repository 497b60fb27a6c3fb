"""Search terms of a text: the unit that it repeats, and its commonest short grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit lengths, tenths of the text that a unit must cover, gram lengths (long ones first), most terms.
UNIT_LEAST, UNIT_MOST, UNIT_TENTHS = 2, 8, 8
GRAMS, MOST_TERMS = (4, 3, 2), 8
IDEOGRAPHS = "一-龥"


def borders(text: str) -> list[int]:
    """For each beginning of a text the length of its longest proper border: what it both begins and ends with."""
    out, n = [0] * len(text), 0
    for i in range(1, len(text)):
        while n and text[i] != text[n]:
            n = out[n - 1]
        n += text[i] == text[n]
        out[i] = n
    return out


def repeated_unit(text: str) -> str:
    """The shortest unit that the text begins with and repeats over 80 % of it, whole units counted; empty if none does.

    A beginning of length n repeats a unit of length p where it has a border of length n - p.  The shortest such p of the
    beginning that 80 % end in, from its longest border, rules out most texts; its multiples and the next borders follow.
    """
    if len(text) < 2 * UNIT_LEAST:
        return ""
    need = -(-len(text) * UNIT_TENTHS // 10)
    held = borders(text)
    for p in range(UNIT_LEAST, min(UNIT_MOST, len(text) // 2) + 1):
        whole = -(-need // p) * p
        if whole > len(text):
            continue
        border = held[whole - 1]
        while border > whole - p:
            border = held[border - 1]
        if border == whole - p:
            return text[:p]
    return ""


def common_grams(text: str, most: int = MOST_TERMS) -> list[str]:
    """The commonest grams of at least two different characters; of equally common ones the longer, then the one met first."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    best: list[tuple[int, int, int, str]] = []
    for n in GRAMS:
        if len(codes) < n:
            continue
        grams = np.lib.stride_tricks.sliding_window_view(codes, n)
        mixed = (grams != grams[:, :1]).any(axis=1)
        if codes.max() < 1 << 16:  # up to four such characters are one number
            key = np.zeros(len(grams), np.uint64)
            for j in range(n):
                key = key << np.uint64(16) | grams[:, j].astype(np.uint64)
            _, first, count = np.unique(key[mixed], return_index=True, return_counts=True)
        else:
            _, first, count = np.unique(grams[mixed], axis=0, return_index=True, return_counts=True)
        at = np.flatnonzero(mixed)[first]
        top = np.lexsort((at, -count))[:most]
        best += [(-int(count[i]), -n, int(at[i]), text[at[i] : at[i] + n]) for i in top]
    return [g for _, _, _, g in sorted(best)[:most]]


def search_terms(text: str | None, letters: str = IDEOGRAPHS) -> list[str]:
    """At most eight terms: the repeated unit, then the commonest grams of the letters alone; without any, the text's words."""
    value = (text or "").strip()
    kept = re.sub(f"[^{letters}]", "", value)
    unit = repeated_unit(kept)
    terms = list(dict.fromkeys([*[unit] * bool(unit), *common_grams(kept)]))
    if not terms:
        terms = list(dict.fromkeys(re.sub(f"[^{IDEOGRAPHS}a-zA-Z0-9]+", " ", value).split()))
    return terms[:MOST_TERMS]


def mined_terms(text: Column, letters: str = IDEOGRAPHS) -> Column:
    """``search_terms`` of each row; a null or empty text has none."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in batches:
            yield pd.Series([search_terms(t if isinstance(t, str) else None, letters) for t in c])

    return run(text)
