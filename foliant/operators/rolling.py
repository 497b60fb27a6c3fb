"""Where given strings occur in texts, by rolling hashes: every place of a text is compared with all strings of one length at once.

The hash of a window is a polynomial of its code points, modulo 2^64, to each of two bases; sums from the start of the text
give it for any place and length.  Two such hashes, 128 bits, stand for a string.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.sources.tables import spread

#: Odd bases and their inverses modulo 2^64.
BASES = tuple((b, pow(b, -1, 1 << 64)) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
#: Lengths of the windows that are looked up first; a longer string is looked up by its beginning.
WINDOWS = (32, 8, 4, 1)
#: Strings of one look-up; more are looked up in further passes over the texts.
MOST_STRINGS = 1_000_000


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Windows:
    """Hashes of all windows of a text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.size = len(codes)
        self.sums, self.powers = [], []
        for base, inverse in BASES:
            self.powers.append(_powers(base, self.size))
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(inverse, self.size), dtype=np.uint64)]))

    def at(self, starts: np.ndarray, length: int, which: int) -> np.ndarray:
        return (self.sums[which][starts + length] - self.sums[which][starts]) * self.powers[which][starts]

    def all(self, length: int, which: int = 0) -> np.ndarray:
        return self.at(np.arange(max(self.size - length + 1, 0)), length, which)


def string_hash(text: str) -> tuple[int, int]:
    w = Windows(text)
    return int(w.all(len(text))[0]), int(w.all(len(text), 1)[0])


class Strings:
    """Strings to look for, by the hash of their beginnings; empty ones are nowhere."""

    def __init__(self, strings: list[str]):
        self.by: dict[int, tuple[np.ndarray, list[list[tuple[int, int, tuple[int, int]]]]]] = {}
        groups: dict[int, dict[int, list]] = {}
        for n, s in enumerate(strings):
            if s:
                k = next(k for k in WINDOWS if k <= len(s))
                groups.setdefault(k, {}).setdefault(string_hash(s[:k])[0], []).append((n, len(s), string_hash(s)))
        for k, heads in groups.items():
            keys = np.array(sorted(heads), np.uint64)
            self.by[k] = keys, [heads[int(h)] for h in keys]

    def held(self, text: str) -> list[int]:
        """Numbers of the strings that occur in a text."""
        w, found = Windows(text), set()
        for k, (keys, lists) in self.by.items():
            hashes = w.all(k)
            if not len(hashes):
                continue
            near = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            for place in np.flatnonzero(keys[near] == hashes):
                for n, size, whole in lists[near[place]]:
                    if n not in found and place + size <= w.size and all(int(w.at(np.array([place]), size, b)[0]) == whole[b] for b in (0, 1)):
                        found.add(n)
        return sorted(found)


def _held(shared: Broadcast, kind: str) -> Callable[[Column], Column]:
    """The items (of type ``kind``) of a broadcast look-up that a text holds."""

    @F.pandas_udf(f"array<{kind}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        strings, names = shared.value
        for c in batches:
            yield pd.Series([[names[k] for k in strings.held(t)] for t in c])

    return run


def literal_matches(docs: DataFrame, strings: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(item, id): texts that hold an item's whole text, once a pair; cases count.

    Only hashes of the items are sent to the texts, ``MOST_STRINGS`` items in a pass.  Null and empty items are nowhere; a
    null text holds nothing; items that repeat are answered each.
    """
    spark = docs.sparkSession
    kind = strings.schema[item_col].dataType.simpleString()
    n = strings.count()
    out = spark.createDataFrame([], f"{item_col} {kind}, {id_col} {docs.schema[id_col].dataType.simpleString()}")
    passes = -(-n // MOST_STRINGS)
    texts = spread(docs.select(id_col, text_col).where(F.col(text_col).isNotNull()))
    for i in range(passes):
        mine = strings.where(F.pmod(F.xxhash64(item_col, item_text), F.lit(passes)) == i).select(item_col, item_text).collect()  # about MOST_STRINGS at most
        held = _held(spark.sparkContext.broadcast((Strings([r[1] or "" for r in mine]), [r[0] for r in mine])), kind)
        out = out.unionByName(texts.select(F.explode(held(F.col(text_col))).alias(item_col), id_col))
    return out


def first_holders(probes: list[str], wholes: list[str]) -> list[int]:
    """For each probe the first of ``wholes`` that holds it, else -1; an empty probe is in the first."""
    found = [-1] * len(probes)
    by_size: dict[int, list[int]] = {}
    for i, p in enumerate(probes):
        by_size.setdefault(len(p), []).append(i)
    windows = [Windows(w) for w in wholes]
    for size, own in by_size.items():
        if not size:
            for i in own:
                found[i] = 0 if wholes else -1
            continue
        keys = np.array([string_hash(probes[i])[0] for i in own], np.uint64)
        open_ = np.ones(len(own), bool)
        for nth, w in enumerate(windows):
            if not open_.any() or w.size < size:
                continue
            hashes = np.unique(w.all(size))
            hit = np.isin(keys, hashes) & open_
            for j in np.flatnonzero(hit):
                if probes[own[j]] in wholes[nth]:
                    found[own[j]] = nth
                    open_[j] = False
    return found
