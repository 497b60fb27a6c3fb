"""Vectors as whole numbers: which rows take part, and exact inner products in blocks."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, spread

#: Scores are 64-bit integers, held at these ends; ``NONE`` is below all of them.
HIGH = (1 << 63) - 1
LOW, NONE = -HIGH, -HIGH - 1
#: Components x become floor(SCALE * x).
SCALE = 256
#: Doubles are exact below; products are formed in doubles only where no sum can reach it.
EXACT = 1 << 53


def sound_vectors(vectors: DataFrame, label: str, *more: str, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int, float]:
    """(rid, id, v, ...): rows whose vector is there, finite and of the commonest length; that length; the largest norm.

    ``rid`` tells rows apart, also those that repeat an id.  Vectors that are null or hold null or non-finite components
    take no part, nor do those of another length than the commonest (of equally common ones, the shortest).  The norm is
    that of the components times ``SCALE`` after rounding, from above.  Zero vectors take part.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), *more)
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = settle(spread(rows.where(F.coalesce(finite, F.lit(False)))).withColumn("rid", F.monotonically_increasing_id()), label)
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + (F.abs(c) * SCALE + 1) * (F.abs(c) * SCALE + 1))
    common = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("norm")).orderBy(F.desc("n"), "dim").first()
    if common is None:
        return rows, 0, 0.0
    return rows.where(F.size("v") == common["dim"]), common["dim"], math.sqrt(common["norm"])


def whole(column: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) for each component, as doubles; a row of Python integers where a double can't hold it."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)
    with np.errstate(over="ignore"):
        y = np.floor(x * SCALE)
    if np.isfinite(y).all():
        return y
    return np.array([[math.floor(Fraction(c) * SCALE) for c in row] for row in x.tolist()], object).reshape(len(column), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both, as 64-bit integers: exact, held at ``LOW`` and ``HIGH``."""
    most = lambda m: max((abs(int(m.min())), abs(int(m.max()))), default=0) if m.size else 0
    if most(a) * most(b) * max(a.shape[1], 1) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = lambda m: np.array([[int(c) for c in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(exact(a) @ exact(b).T, LOW, HIGH).astype(np.int64)


def first_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's ``k`` largest values, equal values by column order, in any order."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    above, level = scores > edge, scores == edge
    level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | level)[1].reshape(len(scores), k)
