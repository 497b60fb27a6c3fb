"""Language identification by string kernels.

The kernel of two texts is the share of letter n-grams (n = 1 to 3, word edges included) that both hold: presence, not
counts, blended over n, and normalised.  n-grams are of real code points in any script, and the columns are the
``GRAMS_A_LANGUAGE`` that most training texts of each language hold.  A Nyström approximation, with the same number of
landmark texts for every language, turns kernel ridge regression, one versus rest, into a small linear system.  Documents
are scored in batches: presence matrix times landmark matrix gives kernel values, and those times the coefficients give
one value a language.

Training sees at most ``ROWS_A_LANGUAGE`` labelled documents of each language, the first by a hash of the id, whole
texts; no language is left out, however rare it is or however many there are.  n-gram counts and the linear system are
summed over tasks; the driver holds the landmarks, as lists of the columns that they hold, and a matrix of landmarks x
landmarks, which grow with the number of languages alone: about 16 KB and 32 KB x languages for each language of 4 landmarks.
Beyond ``MOST_SQUARE`` bytes (2,000 languages) languages get fewer landmarks; more than 8,000 languages are refused.  Scoring reads every text once and shuffles nothing.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, spread, trimmed, unit_hash

ROWS_A_LANGUAGE = 400
GRAMS_A_LANGUAGE = 2_500
#: Landmarks of one language; with few languages each has more, up to LANDMARKS in all.
MARKS_A_LANGUAGE, LANDMARKS = 4, 128
#: Landmarks that are laid out as a dense block at a time, and most bytes of a square matrix of landmarks on the driver.
MARKS_AT_ONCE, MOST_SQUARE = 512, 512 << 20
RIDGE = 1e-2
#: Sharpness of the scores.
SLOPE = 4.0
BATCH = 256
#: n-grams looked up at once, repeats included: long texts are taken in parts of a batch.
BATCH_GRAMS = 1 << 21
_CODE = 21  # bits of a symbol: any code point plus 1; the symbol 1 is a blank, so shorter n-grams are smaller numbers


@functools.cache
def _classes() -> np.ndarray:
    """Code point -> 2 for letters, 1 for marks that stand inside words of many scripts, 0 for the rest."""
    kinds = (unicodedata.category(chr(i)) for i in range(0x110000))
    return np.fromiter((2 if k[0] == "L" else 1 if k[0] == "M" else 0 for k in kinds), np.uint8, 0x110000)


def symbols(text: str) -> np.ndarray:
    """Letters and marks as numbers, every run of anything else as one 1, and a 1 at either end; empty without letters."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kind = _classes()[c]
    if not (kind == 2).any():
        return np.empty(0, np.int64)
    s = np.r_[1, np.where(kind > 0, c + 1, 1), 1]
    return s[np.r_[True, (s[1:] != 1) | (s[:-1] != 1)]]


def grams(text: str) -> np.ndarray:
    """Numbers of all n-grams of a text, repeats included."""
    s = symbols(text)
    if len(s) < 3:
        return np.empty(0, np.int64)
    two = (s[:-1] << _CODE) | s[1:]
    return np.concatenate([s, two, (two[:-1] << _CODE) | s[2:]])


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # n-gram numbers, sorted; the place is the column
    starts: np.ndarray  # column -> its part of ``marks``: the landmarks that hold it
    marks: np.ndarray
    scale: np.ndarray  # of each landmark: one over the norm of its presence
    weights: np.ndarray

    def dense(self, columns: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Landmarks ``lo`` to ``hi`` over some columns."""
        count = self.starts[columns + 1] - self.starts[columns]
        at = np.repeat(self.starts[columns] - np.cumsum(count) + count, count) + np.arange(count.sum())
        mark, place = self.marks[at], np.repeat(np.arange(len(columns)), count)
        own = (mark >= lo) & (mark < hi)
        out = np.zeros((hi - lo, len(columns)), np.float32)
        out[mark[own] - lo, place[own]] = self.scale[mark[own]]
        return out

    @property
    def landmarks(self) -> np.ndarray:
        """All landmarks over all columns: for small models, as in tests."""
        return self.dense(np.arange(len(self.vocabulary)), 0, len(self.scale))

    def held(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of every n-gram held, repeats included."""
        each = [grams(t) for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(g) for g in each])
        g = np.concatenate(each) if each else np.empty(0, np.int64)
        column = np.minimum(np.searchsorted(self.vocabulary, g), max(len(self.vocabulary) - 1, 0))
        ok = self.vocabulary[column] == g if len(self.vocabulary) else np.zeros(len(g), bool)
        return row[ok], column[ok]

    def presence(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        out[self.held(texts)] = 1
        return out

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Presence times landmarks, over the columns that these texts hold."""
        row, column = self.held(texts)
        used = np.zeros(len(self.vocabulary), bool)
        used[column] = True
        at = np.cumsum(used) - 1
        p = np.zeros((len(texts), int(used.sum())), np.float32)
        p[row, at[column]] = 1
        columns = np.flatnonzero(used)
        k = [p @ self.dense(columns, lo, min(lo + MARKS_AT_ONCE, len(self.scale))).T for lo in range(0, len(self.scale), MARKS_AT_ONCE)]
        k = np.concatenate(k, axis=1) if k else np.zeros((len(texts), 0), np.float32)
        return k / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))

    def between(self) -> np.ndarray:
        """Kernel values of the landmarks with each other."""
        out = np.zeros((len(self.scale), len(self.scale)))
        for begin in range(0, len(self.vocabulary), 1 << 13):
            columns = np.arange(begin, min(begin + (1 << 13), len(self.vocabulary)))
            for lo in range(0, len(self.scale), MARKS_AT_ONCE):
                left = self.dense(columns, lo, min(lo + MARKS_AT_ONCE, len(self.scale)))
                for lo2 in range(0, len(self.scale), MARKS_AT_ONCE):
                    hi2 = min(lo2 + MARKS_AT_ONCE, len(self.scale))
                    out[lo : lo + len(left), lo2:hi2] += left @ self.dense(columns, lo2, hi2).T
        return out

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best language's number and a score in 0 to 1: a softmax of the ridge values; ties go to the earlier name."""
        f = SLOPE * (self.kernel(texts) @ self.weights)
        e = np.exp(f - f.max(axis=1, keepdims=True))
        e /= e.sum(axis=1, keepdims=True)
        return e.argmax(axis=1), e.max(axis=1)


def parts(texts: list[str]) -> Iterator[list[int]]:
    """Places of texts that are scored together: at most BATCH, of bounded length in all unless one alone is longer."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if held and (len(held) == BATCH or size + 3 * len(t) > BATCH_GRAMS):
            yield held
            held, size = [], 0
        held.append(i)
        size += 3 * len(t)
    if held:
        yield held


def training_row(ident: Column) -> Column:
    """Languages may be learned from documents whose crc32(id as text) mod 5 is not 0."""
    return F.crc32(ident.cast("string").cast("binary")) % 5 != 0


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(text, lang, turn): the first ``ROWS_A_LANGUAGE`` training rows of each language by a hash of the id, counted from 1.

    A first cut by hash leaves about twice that number, so that no language is ranked whole.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null").where(training_row(F.col("id")))
    rates = settle(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * ROWS_A_LANGUAGE) / F.count(F.lit(1))).alias("rate")), "language-rates")
    rows = rows.withColumn("u", unit_hash(53, F.col("id").cast("string")))
    drawn = rows.join(rates, "lang").where("u < rate")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("u", F.xxhash64("text")))
    return settle(drawn.select("text", "lang", turn.alias("turn")).where(F.col("turn") <= ROWS_A_LANGUAGE), "language-sample")


def _vocabulary(sample: DataFrame) -> np.ndarray:
    """The n-grams that most texts of each language hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang"), strict=True):
                g = np.unique(grams(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(g), pa.string()), pa.array(g, pa.int64())], names=["lang", "g"])

    held = sample.select("text", "lang").mapInArrow(trimmed(run), "lang string, g long").groupBy("lang", "g").count()
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "g"))
    kept = held.withColumn("r", best).where(F.col("r") <= GRAMS_A_LANGUAGE).select("g").distinct()
    return np.sort(kept.toArrow()["g"].to_numpy())


def fit_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """None where no labelled training text has letters.  A language whose training texts have no letters is not learned."""
    sample = training_sample(docs, id_col, text_col, lang_col)
    lettered = sample.where(F.col("text").rlike(r"\p{L}"))
    n = {r["lang"]: r["count"] for r in lettered.groupBy("lang").count().orderBy("lang").collect()}  # one row a language
    names = list(n)
    vocabulary = _vocabulary(lettered) if names else np.empty(0, np.int64)
    if not len(vocabulary):
        return None
    room = int((MOST_SQUARE / 8) ** 0.5) // len(names)
    if not room:
        raise ValueError(f"{len(names)} languages: their landmarks' kernel matrix would pass {MOST_SQUARE >> 20} MB")
    most = min(room, max(MARKS_A_LANGUAGE, LANDMARKS // len(names)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("turn"))
    marks = lettered.withColumn("r", first).where(F.col("r") <= most).orderBy("lang", "r").select("text")
    model = Model(names, vocabulary, np.zeros(len(vocabulary) + 1, np.int64), np.empty(0, np.int32), np.empty(0, np.float32), np.zeros((0, len(names))))

    def column_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"at": [np.unique(model.held([t])[1]) for t in pdf["text"]]})

    held = [np.asarray(r["at"], np.int64) for r in marks.mapInPandas(column_lists, "at array<long>").toLocalIterator()]
    column = np.concatenate(held)
    order = np.argsort(column, kind="stable")
    model.starts = np.searchsorted(column[order], np.arange(len(vocabulary) + 1))
    model.marks = np.repeat(np.arange(len(held), dtype=np.int32), [len(x) for x in held])[order]
    model.scale = (1 / np.sqrt(np.maximum([len(x) for x in held], 1))).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    number = {x: i for i, x in enumerate(names)}
    m, c = len(held), len(names)
    weight = np.array([1 / n[x] for x in names])  # every language weighs the same

    def system(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Weighted sums over a task's texts of k k', and of k by language."""
        gram, by = np.zeros((m, m)), np.zeros((c, m))
        for b in batches:
            texts, of = b.column("text").to_pylist(), np.array([number[x.as_py()] for x in b.column("lang")])
            for part in parts(texts):
                k = shared.value.kernel([texts[i] for i in part]).astype(np.float64)
                own = k * weight[of[part], None]
                gram += k.T @ own
                np.add.at(by, of[part], own)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([by.tobytes()], pa.binary())], names=["gram", "total"])

    a, by = np.zeros((m, m)), np.zeros((c, m))
    for r in spread(lettered.select("text", "lang")).mapInArrow(trimmed(system), "gram binary, total binary").toLocalIterator():
        a += np.frombuffer(r["gram"]).reshape(m, m)
        by += np.frombuffer(r["total"]).reshape(c, m)
    right = 2 * by.T - by.sum(axis=0)[:, None]  # +1 for the language itself, -1 for the others
    a += RIDGE * model.between()
    a[np.diag_indices(m)] += 1e-8
    model.weights = np.linalg.solve(a, right).astype(np.float32)
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) for every row.

    ``und`` with score 0 where the text is null or has no letters, or nothing could be learned.  Texts of letters that
    no training text holds are equally near to all languages: the first by name is given, with an even score.  A null id
    is never learned from and counts as not held out; a row with a null language is scored and never learned from.  Rows
    that repeat are answered row by row; very long texts are read whole; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            for part in parts(texts) if m else ():
                some = [i for i in part if len(symbols(texts[i]))]
                if some:
                    best, p = m.predict([texts[i] for i in some])
                    lang[some], score[some] = np.array(m.languages, object)[best], p
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=["id", "lang_pred", "score"])

    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    held = F.coalesce(~training_row(F.col("id")), F.lit(False))
    return rows.mapInArrow(trimmed(run), f"id {kind}, lang_pred string, score double").select(F.col("id").alias(id_col), held.alias("held_out"), "lang_pred", "score")
