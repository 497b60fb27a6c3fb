"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: each row holds one document's postings (terms of the benchmark vocabulary,
and for each term its token positions), written once to the shared folder.  Corpus frequencies of all terms are
summed over every document.  A benchmark window starts from the posting list of its rarest term; the list is
shifted by the term's offset in the window to give candidate starts, and those are intersected with the
offset-adjusted lists of the other terms, next rarest first, until all terms agree.  Proximity matches are the same
intersection with a stated slack of positions and a stated number of terms that may be missing.  Lists of one document
meet in that document's row, so no term, however frequent, is gathered in one task, and nothing but the frequency table
is shuffled.

The benchmark is the stated query set: it is broadcast in blocks of at most ``BLOCK_WORDS`` words, each block against
all rows; more blocks mean more passes over the index, not more memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_ids, settle, spread, trimmed, with_keys

WINDOW = 10
#: Words of one broadcast block of benchmark items.
BLOCK_WORDS = 1_000_000
#: Tokens of documents matched at once, and candidate starts held at once.
BATCH_TOKENS, BATCH_STARTS = 250_000, 500_000

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8: A-Z lower-cased, runs of ASCII digits, letters and everything beyond ASCII."""
    return _WORDS.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else []


class Windows:
    """The distinct windows of a block of items, as term numbers, and the items that hold each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int = WINDOW):
        self.terms: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], int] = {}
        pairs: set[tuple[int, int]] = set()
        self.items = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        for item, words in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                w = seen.setdefault(tuple(ids[i : i + size]), len(seen))
                pairs.add((w, number[item]))
        self.length = np.array([len(w) for w in seen], np.int32)
        self.word = np.full((len(seen), size), -1, np.int32)
        for w, i in seen.items():
            self.word[i, : len(w)] = w
        held = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.item_start = np.searchsorted(held[:, 0], np.arange(len(seen) + 1))
        self.item = held[:, 1]

    def order_by(self, frequency: np.ndarray) -> None:
        """Offsets of each window's terms, rarest in the corpus first."""
        rank = np.where(self.word >= 0, frequency[self.word], np.iinfo(np.int64).max)
        self.offset = np.argsort(rank, axis=1, kind="stable").astype(np.int32)


@dataclass
class Lists:
    """Posting lists of a group of documents as one sorted array of ``term * span + position``; documents follow each other at a distance."""

    ids: pa.Array
    n_words: np.ndarray
    begin: np.ndarray  # first position of each document
    span: int
    keys: np.ndarray

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, at, "right") - 1

    def next_from(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each term's list has a position in [low, high], and the first such position."""
        at = np.searchsorted(self.keys, term * self.span + np.maximum(low, 0))
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return (at < len(self.keys)) & (key <= term * self.span + high) & (high >= 0), key - term * self.span


def starts_of(lists: Lists, win: Windows, slack: int = 0, misses: int = 0) -> Iterator[tuple[np.ndarray, ...]]:
    """Occurrences (window, start, terms found, first and last position): every term within ``slack`` of its place, but for ``misses``.

    Candidates come from the lists of the rarest term and, as any ``misses`` terms may be absent, the next rarest ones.
    """
    if not len(lists.keys):
        return
    bounds = np.searchsorted(lists.keys, np.arange(len(win.terms) + 1) * lists.span)
    every = np.arange(len(win.length))
    for rank in range(misses + 1):
        first = win.offset[:, min(rank, win.offset.shape[1] - 1)]
        anchor = win.word[every, first]
        many = np.where((win.length > max(rank, misses)) & (anchor >= 0), bounds[anchor + 1] - bounds[anchor], 0)
        live = np.flatnonzero(many)
        cut = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(many[live]) // BATCH_STARTS]))
        for group in np.split(live, cut[1:]) if len(live) else []:
            n = many[group]
            w = np.repeat(group, n)
            low = lists.keys[np.repeat(bounds[anchor[group]] - (np.cumsum(n) - n), n) + np.arange(n.sum())] - anchor[w].astype(np.int64) * lists.span
            at, high, found = low - first[w], low.copy(), np.ones(len(w), np.int32)
            for k in range(win.word.shape[1]):  # meet the next rarest term's list, shifted by its offset
                if k == rank or not len(w):
                    continue
                off = win.offset[w, k]
                want = win.word[w, off].astype(np.int64)
                ok, place = lists.next_from(want, at + off - slack, at + off + slack)
                ok &= want >= 0
                found += ok
                low, high = np.where(ok, np.minimum(low, place), low), np.where(ok, np.maximum(high, place), high)
                left = win.length[w] - np.minimum(win.length[w], k + 1 + (k < rank))  # terms still to be met
                keep = (want < 0) | (found + left >= win.length[w] - misses)
                w, at, low, high, found = w[keep], at[keep], low[keep], high[keep], found[keep]
            keep = found >= win.length[w] - misses
            yield tuple(x[keep] for x in (w, at, found, low, high))


def _postings(terms: dict[bytes, int], text_col: int):
    """Documents -> their positional postings over the block's vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = terms.get
        for batch in batches:
            n_words, term, begin, position = [], [], [], []
            for text in batch.column(text_col):
                words = words_of(text.as_py())
                ids = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                at = np.flatnonzero(ids >= 0).astype(np.int32)
                at = at[np.argsort(ids[at], kind="stable")]
                own, start = np.unique(ids[at], return_index=True)
                n_words.append(len(words))
                term.append(own.astype(np.int32))
                begin.append(start.astype(np.int32))
                position.append(at)
            lists = [_lists(x) for x in (term, begin, position)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), *lists], names=["id", "n_words", "terms", "begins", "positions"])

    return run


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32), pa.int32()))


def build_index(docs: DataFrame, terms: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """The positional index of ``docs`` over ``terms``, stored in the shared folder."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _postings(shared.value, 1)(batches)

    return settle(rows.mapInArrow(trimmed(run), f"id {kind}, n_words long, terms array<int>, begins array<int>, positions array<int>"), "positional-index")


def term_frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Occurrences of each term in all documents; at most one row a term and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for t, b, p in zip(*(batch.column(c) for c in ("terms", "begins", "positions")), strict=True):
                begin = b.values.to_numpy()
                total[t.values.to_numpy()] += np.diff(np.r_[begin, len(p)])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["term", "n"])

    summed = index.select("terms", "begins", "positions").mapInArrow(trimmed(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_terms, np.int64)
    out[summed["term"].to_numpy(np.int64)] = summed["n"]
    return out


def _rows(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[Lists]:
    """Posting lists of groups of documents of a bounded number of words, ``gap`` positions between documents."""
    ids, n_words, terms, places, begin, size, kind = [], [], [], [], [], 0, None

    def group() -> Lists:
        t, p = np.concatenate(terms).astype(np.int64), np.concatenate(places)
        return Lists(pa.array(ids, kind), np.array(n_words, np.int64), np.array(begin, np.int64), size, np.sort(t * size + p))

    for batch in batches:
        cols = [batch.column(c) for c in ("id", "n_words", "terms", "begins", "positions")]
        kind = cols[0].type
        for i, n, t, b, p in zip(*cols, strict=True):
            at = p.values.to_numpy()
            ids.append(i.as_py())
            n_words.append(n.as_py())
            begin.append(size)
            terms.append(np.repeat(t.values.to_numpy(), np.diff(np.r_[b.values.to_numpy(), len(at)])))
            places.append(at.astype(np.int64) + size)
            size += n_words[-1] + gap
            if size >= BATCH_TOKENS:
                yield group()
                ids, n_words, terms, places, begin, size = [], [], [], [], [], 0
    if ids:
        yield group()


def _held_items(win: Windows, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For occurrences of windows: (place in ``w``, item) of every item that holds the window."""
    n = win.item_start[w + 1] - win.item_start[w]
    return np.repeat(np.arange(len(w)), n), win.item[np.repeat(win.item_start[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if len(n) else n


def _matches(win: Windows):
    """Index rows -> per document the hit words and items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _rows(batches, 1):
            edge = np.zeros(lists.span + 1, np.int64)
            pairs = []
            for w, at, *_ in starts_of(lists, win):
                np.add.at(edge, at, 1)
                np.add.at(edge, at + win.length[w], -1)
                of, item = _held_items(win, w)
                pairs.append(np.unique(np.stack([lists.doc_of(at)[of], item], 1), axis=0))
            hit = np.cumsum(edge[:-1]) > 0
            hits = np.add.reduceat(hit, lists.begin)
            both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.empty((0, 2), np.int64)
            cut = np.searchsorted(both[:, 0], np.arange(len(lists.ids) + 1))
            items = [[win.items[i] for i in both[a:b, 1]] for a, b in zip(cut, cut[1:], strict=False)]
            # runs of hit words, so that later blocks of items can be joined without counting a word twice
            runs = [np.flatnonzero(np.diff(np.r_[False, hit[a : a + n], False].astype(np.int8))) if h else np.empty(0, np.int64) for a, n, h in zip(lists.begin, lists.n_words, hits, strict=True)]
            yield pa.RecordBatch.from_arrays([lists.ids, pa.array(lists.n_words), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([x.tolist() for x in runs], pa.list_(pa.int64()))], names=["id", "n_words", "n_hit", "items", "runs"])

    return run


def _occurrences(win: Windows, slack: int, misses: int):
    """Index rows -> one row for each place where a window of an item occurs, once however many candidates led there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _rows(batches, win.word.shape[1] + 2 * slack + 1):
            found = []
            for w, _, n, low, high in starts_of(lists, win, slack, misses):
                doc = lists.doc_of(low)
                of, item = _held_items(win, w)
                found.append(np.stack([doc[of], item, (low - lists.begin[doc])[of], (high - low + 1)[of], n[of], win.length[w][of]], 1))
            if found:
                x = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([lists.ids.take(pa.array(x[:, 0])), pa.array([win.items[i] for i in x[:, 1]], pa.string()), *(pa.array(x[:, j], pa.int64()) for j in (2, 3, 4, 5))], names=["id", "item", "start", "n", "found", "terms"])

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Benchmark items in id order, a bounded number of words at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null").orderBy("i", "t").toLocalIterator():
        words = words_of(row["t"])
        block.append((row["i"], words))
        size += len(words)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _matched(docs: DataFrame, benchmark: DataFrame, match, schema: str, id_col: str, text_col: str, item_col: str, item_text: str, window: int) -> list[DataFrame]:
    """``match(windows)`` over the index, for each block of the benchmark."""
    out = []
    kind = docs.schema[id_col].dataType.simpleString()
    for block in _blocks(benchmark, item_col, item_text) if benchmark is not None else []:
        win = Windows(block, window)
        if not win.terms:
            continue
        index = build_index(docs, win.terms, id_col, text_col)
        win.order_by(term_frequencies(index, len(win.terms)))
        shared = docs.sparkSession.sparkContext.broadcast(win)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from match(shared.value)(batches)

        out.append(index.mapInArrow(trimmed(run), schema.format(kind=kind)))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document row: (id, n_words, n_hit, n_items, items, items_sha256, contaminated).

    A null or empty text has no words and is clean; so is every document where the benchmark is empty.  Items
    without words never occur; repeated items count once, items with a null id are left out.  Every row is answered by
    itself, whatever its id: where the benchmark has several blocks, rows get a key, written once with their texts, on
    which the blocks' results meet.  Other columns are ignored.
    """
    if benchmark is not None and len(list(islice(_blocks(benchmark, item_col, item_text), 2))) > 1:
        named = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("own"), F.col(text_col).alias("text"))
        named = settle(named, "keyed-documents")
        found = _contamination(named, benchmark, "key", "text", item_col, item_text, window)
        return named.select("key", F.col("own").alias("_own")).join(found, "key").drop("key").withColumnRenamed("_own", id_col)
    return _contamination(docs, benchmark, id_col, text_col, item_col, item_text, window)


def _contamination(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int) -> DataFrame:
    """``contamination`` of documents whose ids are unique, or against a benchmark of one block."""
    schema = "id {kind}, n_words long, n_hit long, items array<string>, runs array<long>"
    parts = _matched(docs, benchmark, _matches, schema, id_col, text_col, item_col, item_text, window)
    if not parts:
        parts = [_empty_parts(docs, schema, id_col, text_col)]
    if len(parts) == 1:
        rows = parts[0].drop("runs")
    else:
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows = rows.groupBy("id").applyInPandas(_merge_blocks, rows.drop("runs").schema)
    items = F.array_sort("items")
    return rows.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _empty_parts(docs: DataFrame, schema: str, id_col: str, text_col: str) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            none = pa.array([[]] * b.num_rows, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(words_of(t.as_py())) for t in b.column(1)], pa.int64()), pa.array([0] * b.num_rows, pa.int64()), none, none.cast(pa.list_(pa.int64()))], names=["id", "n_words", "n_hit", "items", "runs"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema.format(kind=kind))


def _merge_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row of each block for a document -> the union of their hit words and items."""
    edge = np.zeros(int(pdf["n_words"].max()) + 1, np.int64)
    for runs in pdf["runs"]:
        np.add.at(edge, np.asarray(runs[::2], np.int64), 1)
        np.add.at(edge, np.asarray(runs[1::2], np.int64), -1)
    items = sorted({i for x in pdf["items"] for i in x})
    return pd.DataFrame({"id": pdf["id"].iloc[:1], "n_words": pdf["n_words"].iloc[:1], "n_hit": [int((np.cumsum(edge) > 0).sum())], "items": [items]})


def phrase_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Exact matches, one row an occurrence of an item's window: (id, item, start word, number of words).

    Rows that repeat give repeated matches; nulls and an empty table on either side give none.
    """
    return proximity_matches(docs, benchmark, 0, 0, id_col, text_col, item_col, item_text, window).drop("found", "terms")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slack: int = 2, misses: int = 1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Places where all terms of an item's window, but for ``misses``, stand within ``slack`` words of their places.

    Places are counted from a term of the window that is there.  One row for each distinct (id, item, start, n, found,
    terms): the first word met, the number of words to the last one met, how many of the window's ``terms`` were found.
    Windows of at most ``misses`` terms have no proximity matches.  Of a term's positions within the slack the first counts.
    """
    schema = "id {kind}, item string, start long, n long, found long, terms long"
    parts = _matched(docs, benchmark, lambda win: _occurrences(win, slack, misses), schema, id_col, text_col, item_col, item_text, window)
    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], schema.format(kind=kind))
    for p in parts:
        out = out.unionByName(p)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The document rows without any benchmark window; rows that repeat an id, or have none, are told apart."""
    keyed, key = with_keys(docs, id_col)
    return drop_ids(keyed, contamination(keyed, benchmark, key, text_col, window=window).where("contaminated").select(key), key).select(*docs.columns)
