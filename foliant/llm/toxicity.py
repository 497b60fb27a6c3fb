"""Toxicity scoring by gradient-boosted trees over dense features of the whole text, with isotonic calibration.

Features: densities of lexicon words and stems, their distance to second-person words, capitals, punctuation, and
obfuscated spellings.  The lexicon has a small fixed seed and grows by the words and word beginnings that labelled
training rows show to be toxic (a likelihood-ratio test on document counts).  Lexicon, trees and calibration are fitted on a
bounded sample of labelled rows (``MOST_TOXIC`` and ``MOST_CLEAN``); scoring reads every text once, without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import settle, spread, trimmed, unit_hash

#: Bounds of the training sample, in labelled rows; rows are drawn by a hash of their id.
MOST_TOXIC, MOST_CLEAN = 5_000, 8_000
#: Share of the sample that fits the calibration alone.
CALIBRATION = 0.3
CUT = 0.7
#: Distinct tokens, and lexicon terms, that a task holds at once.
CACHED_TOKENS, COUNTED_TERMS = 100_000, 200_000
#: A learned lexicon entry has this likelihood ratio (G squared) and this ratio of toxic to clean shares at least; at most so many entries.
LEAST_G, LEAST_RATIO, MOST_TERMS = 22.0, 8.0, 400
#: ... and is in this share of the toxic documents at least.
LEAST_SHARE = 0.01
#: Min-hashes that tell near copies in the sample.
MARKS = 3
STEMS = (4, 5, 6, 7)
NEAR = 6

SEED = ("asshole", "bastard", "bitch", "clown", "crap", "disgusting", "dumb", "fool", "fuck", "garbage", "hate", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "retard", "scum", "shit", "stupid", "trash", "ugly", "vermin", "worthless")
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split())
_LEET = str.maketrans("013457@$!|", "oieastasil")

NAMES = ("words_log", "lex_density", "lex_log", "stem_density", "stem_log", "obfuscated", "you_density", "nearest_you", "near_you", "upper_ratio", "shout_ratio", "exclaim", "question", "punct_ratio", "symbol_words", "digit_ratio")
_LEX, _STEM, _OBF, _YOU, _SHOUT, _SYMBOL = 1, 2, 4, 8, 16, 32


class _Codes(dict):
    """Token -> bits of what it is; each distinct token is looked at once."""

    def __init__(self, words: frozenset[str], stems: frozenset[str]):
        super().__init__()
        self.words, self.stems = words, stems

    def known(self, word: str) -> int:
        return _LEX if word in self.words else _STEM if any(word[:n] in self.stems for n in STEMS) else 0

    def __missing__(self, token: str) -> int:
        if len(self) > CACHED_TOKENS:
            self.clear()
        core = token.strip("\"'.,;:!?()[]{}<>%&*#$|-_/\\…»«“”‘’")
        low = core.lower()
        code = self.known(low)
        if core and not core.isalpha():
            plain = "".join(c for c in low.translate(_LEET) if c.isalpha())
            if any(c.isalpha() for c in core):
                code |= _SYMBOL
            if not code & _LEX and plain in self.words:
                code |= _LEX | _OBF
        if low in SECOND_PERSON:
            code |= _YOU
        if len(core) > 2 and core.isupper():
            code |= _SHOUT
        self[token] = code
        return code


def features(text: str | None, codes: _Codes) -> np.ndarray:
    """The dense features, in the order of ``NAMES``; null and empty texts give zeros."""
    out = np.zeros(len(NAMES), np.float32)
    if not text:
        return out
    tokens = text.split()
    if not tokens:
        return out
    code = np.fromiter(map(codes.__getitem__, tokens), np.uint8, len(tokens))
    n = len(tokens)
    lex, stem = np.flatnonzero(code & _LEX), int(np.count_nonzero(code & _STEM))
    hits, you = np.flatnonzero(code & (_LEX | _STEM)), np.flatnonzero(code & _YOU)
    nearest, near = 0.0, 0
    if len(hits) and len(you):
        at = np.searchsorted(you, hits)
        gap = np.minimum(np.abs(hits - you[np.maximum(at - 1, 0)]), np.abs(you[np.minimum(at, len(you) - 1)] - hits))
        nearest, near = float(np.exp(-gap.min() / NEAR)), int((gap <= NEAR).sum())
    held = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    chars = len(text)
    upper, letters = held[65:91].sum(), held[65:91].sum() + held[97:123].sum() + held[128:].sum() / 2
    punct = held[33:48].sum() + held[58:65].sum() + held[91:97].sum() + held[123:127].sum()
    out[:] = (
        np.log1p(n), len(lex) / n, np.log1p(len(lex)), stem / n, np.log1p(stem), np.count_nonzero(code & _OBF), len(you) / n, nearest, near,
        upper / max(letters, 1), np.count_nonzero(code & _SHOUT) / n, held[33] / chars, held[63] / chars, punct / chars, np.count_nonzero(code & _SYMBOL) / n, held[48:58].sum() / chars,
    )
    return out


@dataclass
class Model:
    words: frozenset[str]
    stems: frozenset[str]
    trees: gbt.Boosted | None
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), float(self.knots[1][0]))
        return np.clip(np.interp(self.trees.margin(x), *self.knots), 0, 1)


def training_row(ident: Column) -> Column:
    """Labels may be learned from rows whose crc32(id as text) mod 3 is not 1."""
    return F.crc32(ident.cast("string").cast("binary")) % 3 != 1


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, y, weight, part): at most the documented number of labelled training rows, texts whole."""
    known = labels.select(F.col(id_col).alias("i"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1) and i is not null").where(training_row(F.col("i")))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    rate = {y: min(1.0, most / max(n.get(y, 0), 1)) for y, most in ((0, MOST_CLEAN), (1, MOST_TOXIC))}
    u = unit_hash(41, F.col("i").cast("string"))
    share = F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])
    drawn = known.where(u < share).select("i", "y", (1 / share).alias("weight"), unit_hash(43, F.col("i").cast("string")).alias("part")).orderBy("part", "i", "y").limit(2 * (MOST_TOXIC + MOST_CLEAN))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = rows.join(F.broadcast(drawn), rows["id"] == drawn["i"]).select("text", "y", "weight", "part")
    found = settle(found.withColumns({f"k{i}": _mark(F.col("text"), i) for i in range(MARKS)}), "toxic-sample")
    for i in range(MARKS):  # near copies would count the same evidence again and again
        found = found.groupBy(f"k{i}", "y").agg(F.min_by(F.struct(*[c for c in found.columns if c not in (f"k{i}", "y")]), "part").alias("s")).select(f"k{i}", "y", "s.*")
    return settle(found.select("text", "y", "weight", "part"), "toxic-sample")


def _mark(text: Column, seed: int) -> Column:
    """Min-hash of a text's three-word shingles, one of a few by which near copies in the sample are told."""
    w = F.split(F.coalesce(text, F.lit("")), r"\s+")
    two = F.zip_with(w, F.slice(w, 2, 1 << 30), lambda a, b: F.xxhash64(a, b))
    return F.array_min(F.zip_with(two, F.slice(w, 3, 1 << 30), lambda h, c: F.xxhash64(h, c, F.lit(seed))))


def _terms(text: str | None) -> set[str]:
    out = set()
    for token in set(text.split()) if text else ():
        w = token.strip("\"'.,;:!?()[]{}<>%&*#$|-_/\\").lower()
        if len(w) > 2 and w.isalpha():
            out.add("=" + w)
            out.update(w[:n] for n in STEMS if len(w) > n)
    return out


def _counted(by: tuple[Counter, Counter]) -> Iterator[pd.DataFrame]:
    for y, (pos, neg) in enumerate(((0, 1), (1, 0))):
        n = np.fromiter(by[y].values(), np.int64, len(by[y]))
        if len(n):
            yield pd.DataFrame({"term": list(by[y].keys()), "pos": n * pos, "neg": n * neg})


def _lexicon(sample: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Words and beginnings of words whose documents are toxic far beyond the usual odds."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = (Counter(), Counter())
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"], strict=True):
                by[y].update(_terms(text))
                if len(by[0]) + len(by[1]) > COUNTED_TERMS:
                    yield from _counted(by)
                    by = (Counter(), Counter())
        yield from _counted(by)

    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    summed = sample.select("text", "y").mapInPandas(trimmed(count), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = n.get(1, 0) / max(n.get(0, 0) + n.get(1, 0), 1)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("pos") + F.col("neg")) * max(p, 1e-9)))).otherwise(0.0)
    over = (F.col("pos") + 0.5) / (n.get(1, 0) + 1) > LEAST_RATIO * (F.col("neg") + 0.5) / (n.get(0, 0) + 1)
    kept = summed.where(F.col("pos") >= max(3.0, LEAST_SHARE * n.get(1, 0))).withColumn("g", 2 * (part("pos", share) + part("neg", 1 - share)))
    best = kept.where((F.col("g") >= LEAST_G) & over).orderBy(F.desc("g"), "term").limit(MOST_TERMS).collect()
    found = [r["term"] for r in best]
    return frozenset(SEED) | {t[1:] for t in found if t[0] == "="}, frozenset(t for t in found if t[0] != "=")


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled training rows; with one class or none the score is the share of toxic labels (0 without labels)."""
    sample = _sample(docs, labels, id_col, text_col)
    words, stems = _lexicon(sample.where(F.col("part") >= CALIBRATION))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = _Codes(words, stems)
        for pdf in batches:
            yield pd.DataFrame({"x": [features(t, codes) for t in pdf["text"]], "y": pdf["y"], "weight": pdf["weight"], "part": pdf["part"]})

    rows = sample.mapInPandas(trimmed(run), "x array<float>, y int, weight double, part double").toPandas().sort_values(["part", "y"])
    y, weight = rows["y"].to_numpy(float), rows["weight"].to_numpy(float)
    cal = rows["part"].to_numpy() < CALIBRATION
    if not len(rows) or len(set(y[~cal])) < 2 or len(set(y[cal])) < 2:
        mean = float(np.average(y, weights=weight)) if len(rows) else 0.0
        return Model(words, stems, None, (np.zeros(1), np.array([mean])))
    x = np.stack(rows["x"].to_numpy())
    trees = gbt.fit(x[~cal], y[~cal], weight[~cal] / weight[~cal].mean())
    return Model(words, stems, trees, gbt.isotonic(trees.margin(x[cal]), y[cal], weight[cal]))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row; null and empty texts are scored by their zero features.

    A null id is never learned from and counts as not held out.  Rows that repeat are scored row by row, an empty table
    gives no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        codes = _Codes(m.words, m.stems)
        for batch in batches:
            x = np.stack([features(t.as_py(), codes) for t in batch.column(1)]) if batch.num_rows else np.zeros((0, len(NAMES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(x), pa.float64())], names=["id", "score"])

    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    held = F.coalesce(~training_row(F.col("id")), F.lit(False))
    return rows.mapInArrow(trimmed(run), f"id {kind}, score double").select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that aren't predicted toxic; a row's text decides, so repeated ids do no harm."""
    model = fit_model(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        codes = _Codes(m.words, m.stems)
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            x = np.stack([features(t.as_py(), codes) for t in texts]) if batch.num_rows else np.zeros((0, len(NAMES)))
            yield batch.filter(pa.array(m.score(x) < CUT))

    return spread(docs).mapInArrow(trimmed(run), docs.schema)
