"""Recall over several fields by clauses, as a search store scores them: terms, phrases with slop, grams, exact values.

All clauses score by BM25 over their own field.  A pass over the rows counts what each clause needs, one aggregate turns the
counts into one row of statistics, and scores are a projection beside that row; nothing else is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import tokens
from foliant.operators.search import K1, B, term_counts, token_count
from foliant.sources.tables import spread

#: Fixed values of the gram fields.
GRAM_LOW, GRAM_HIGH = 2, 8


def query_terms(query: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", query.lower())


@dataclass(frozen=True)
class Terms:
    """Rows that hold at least ``least`` percent (rounded down, but one) of the query's different terms in the field."""

    field: str
    query: str
    boost: float = 1.0
    least: int = 0


@dataclass(frozen=True)
class Phrase:
    """Rows where all terms stand in order, up to ``slop`` places off; nearer ones count more."""

    field: str
    query: str
    boost: float = 1.0
    slop: int = 0


@dataclass(frozen=True)
class Grams:
    """Rows that hold character grams of the query's tokens; for short fields."""

    field: str
    query: str
    boost: float = 1.0


@dataclass(frozen=True)
class Exact:
    """Rows whose field equals the value; the score is the boost."""

    field: str
    value: str
    boost: float = 1.0


Clause = Terms | Phrase | Grams | Exact


def sloppy_frequency(found: list[str], terms: list[str], slop: int) -> float:
    """Sum of 1 / (1 + width) over the smallest windows of at most ``slop`` that hold every term.

    Places are taken less the term's own place in the phrase, so a width of 0 is the phrase itself.  A window is given by its
    lowest place; of windows with one end the narrowest counts.
    """
    line = np.array(found, object)
    at = [np.flatnonzero(line == t) - i for i, t in enumerate(terms)]
    if not terms or not all(len(a) for a in at):
        return 0.0
    lows = np.unique(np.concatenate(at))
    lows = lows[lows <= min(a[-1] for a in at)]
    ends = np.max([a[np.searchsorted(a, lows)] for a in at], axis=0) if len(lows) else lows
    last = np.append(ends[1:] != ends[:-1], True)[: len(ends)]  # ends rise with lows: the last low of an end is the narrowest
    width = (ends - lows)[last]
    return float((1.0 / (1.0 + width[width <= slop])).sum())


def phrase_frequency(text: Column, query: str, slop: int) -> Column:
    """``sloppy_frequency`` of a text; only texts that hold every term go to Python."""
    terms = query_terms(query)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        word = re.compile("[a-z0-9]+")
        for c in batches:
            yield pd.Series([sloppy_frequency(word.findall(t), terms, slop) if isinstance(t, str) else 0.0 for t in c], dtype=float)

    low, all_in = F.lower(text), F.lit(bool(terms))
    for t in dict.fromkeys(terms):
        all_in = all_in & F.contains(F.lower(text), F.lit(t))
    return F.coalesce(run(F.when(all_in, low)), F.lit(0.0))


def query_grams(query: str) -> list[str]:
    grams = (t[i : i + n] for t in query_terms(query) for n in range(GRAM_LOW, GRAM_HIGH + 1) for i in range(len(t) - n + 1))
    return list(dict.fromkeys(grams))


def _counted(c: Clause) -> Column:
    """What a clause needs of a row: (len, tf), and freq for phrases."""
    text = F.col(c.field)
    if isinstance(c, Exact):
        return F.when(text == c.value, c.boost).otherwise(0.0)
    if isinstance(c, Grams):
        size = F.aggregate(tokens(text), F.lit(0).cast("long"), lambda s, t: s + sum(F.greatest(F.length(t) - (n - 1), F.lit(0)).cast("long") for n in range(GRAM_LOW, GRAM_HIGH + 1)))
        grams = query_grams(c.query)
        tf = F.array(*[F.regexp_count(F.lower(text), F.lit(f"(?={g})")) for g in grams])  # a look ahead, so that overlapping ones count
        return F.struct(size.alias("len"), tf.alias("tf"))
    terms = query_terms(c.query)
    kept = terms if isinstance(c, Phrase) else list(dict.fromkeys(terms))
    counted = [token_count(text).alias("len"), term_counts(text, kept).alias("tf")]
    return F.struct(*counted, phrase_frequency(text, c.query, c.slop).alias("freq")) if isinstance(c, Phrase) else F.struct(*counted)


def _width(c: Clause) -> int:
    return len(query_grams(c.query)) if isinstance(c, Grams) else len(query_terms(c.query)) if isinstance(c, Phrase) else len(dict.fromkeys(query_terms(c.query)))


def _score(c: Clause, own: Column, stats: Column) -> Column:
    if isinstance(c, Exact):
        return own
    n, avg = stats["n"], stats["avg"]
    idf = F.transform(stats["df"], lambda d: F.log(1 + (n - d + 0.5) / (d + 0.5)))
    part = lambda f, w: w * f * (K1 + 1) / (f + K1 * (1 - B + B * own["len"] / avg))
    if isinstance(c, Phrase):
        score = F.when(own["freq"] > 0, part(own["freq"], F.aggregate(idf, F.lit(0.0), lambda s, x: s + x)))
    else:
        parts = F.zip_with(own["tf"], idf, lambda f, w: F.when(f > 0, part(f, w)).otherwise(0.0))
        score = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
        if isinstance(c, Terms) and c.least:
            score = F.when(F.size(F.filter(own["tf"], lambda f: f > 0)) >= max(1, _width(c) * c.least // 100), score)
    return c.boost * F.coalesce(score, F.lit(0.0))


def recall(docs: DataFrame, clauses: list[Clause], id_col: str = "doc_id", best: bool = False) -> DataFrame:
    """(id, score) of the rows that any clause finds: the sum of their scores, or with ``best`` the highest of them.

    A null field takes no part in its own statistics and is found by nothing; an empty query finds nothing.
    """
    clauses = [c for c in clauses if isinstance(c, Exact) or _width(c)]
    if not clauses:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    counted = spread(docs.select(id_col, *dict.fromkeys(c.field for c in clauses))).select(F.col(id_col), *[_counted(c).alias(f"_{i}") for i, c in enumerate(clauses)])
    scored = [(i, c) for i, c in enumerate(clauses) if not isinstance(c, Exact)]
    held = lambda i, c: F.array(*[F.count_if(F.col(f"_{i}.tf")[k] > 0) for k in range(_width(c))])
    one = [F.struct(F.count(f"_{i}.len").alias("n"), F.avg(f"_{i}.len").alias("avg"), held(i, c).alias("df")).alias(f"s_{i}") for i, c in scored]
    rows = counted.crossJoin(F.broadcast(counted.agg(*one))) if one else counted  # beside one row
    each = [_score(c, F.col(f"_{i}"), F.col(f"s_{i}") if not isinstance(c, Exact) else F.lit(None)) for i, c in enumerate(clauses)]
    each = [F.coalesce(e, F.lit(0.0)) for e in each]
    total = F.array_max(F.array(*each)) if best else sum(each, F.lit(0.0))
    return rows.select(id_col, total.alias("score")).where("score > 0")


def qa_recall(pairs: DataFrame, query: str, k: int = 10, id_col: str = "id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(id, score, confidence, rrf_score): question answered before, by words: question three times answer, the better field, 60 % of the terms.

    Confidence is a tenth of the score, at most 1.  Ties to the smaller id.
    """
    found = recall(pairs, [Terms(question, query, 3.0, 60), Terms(answer, query, 1.0, 60)], id_col, best=True)
    top = found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), id_col).limit(k)
    top = top.withColumn("confidence", F.round(F.least(F.col("score") / 10.0, F.lit(1.0)), 4))
    return top.withColumn("rrf_score", F.round(F.col("confidence") * 0.015, 6))
