"""Exact top-k search by distributed histogram selection.

Everything is scored, several times, and no score is stored.  A pass counts, for every query, scores by bins; the counts
of all tasks are added, and the bin that holds the kth largest score is found from above.  The next pass counts inside
that bin by finer bins, until a bin is a single value: the kth score itself.  A last pass keeps the rows that reach it.
Scores above it are fewer than k; of those equal to it, the rows of smallest id are kept batch by batch and then over all.

Rows stay where they are; queries come to them in blocks of at most ``BLOCK_QUERIES``.  A batch tells only its upper bins:
below the bin that holds its own kth score the kth score of all can't lie.  So what a task emits is at most about k
counts a query and batch, at any size of the table, and equal keys gather nothing: a group is a query and a bin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, trimmed
from .vectors import HIGH, NONE, first_columns, products, sound_vectors, whole

#: Queries in one broadcast block (16 MB at 64 components), and of these, queries scored at once in a task.
BLOCK_QUERIES, SUB_QUERIES = 16_384, 128
#: Bins of a pass, as a power of two.
BIN_BITS = 12


class _Block:
    """A block of queries with what is known of each: the bin of its kth score at the present width, and how many of that bin are needed."""

    def __init__(self, rid: np.ndarray, x: np.ndarray, k: int, norm: float):
        self.rid, self.x = rid, x
        most = int(norm * norm * (1 + 1e-9)) + 1 if norm < 3e9 else HIGH  # no score lies further from 0
        self.shift = max(0, most.bit_length() + 1 - BIN_BITS)  # from -most to most in fewer than 2^BIN_BITS bins
        self.last = None  # the shift before
        self.bin = np.zeros(len(rid), np.int64)
        self.need = np.full(len(rid), k, np.int64)
        self.found = np.ones(len(rid), bool)  # False: fewer than k candidates, all are kept

    def floors(self) -> np.ndarray:
        return np.where(self.found, self.bin, NONE)


def _scored(block: _Block, batch: pa.RecordBatch, dim: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Scores of a batch for some queries at a time, and where a row meets itself."""
    x, rid = whole(batch.column("v"), dim), batch.column("rid").to_numpy()
    for lo in range(0, len(block.rid), SUB_QUERIES):
        at = slice(lo, lo + SUB_QUERIES)
        yield at, products(block.x[at], x), block.rid[at][:, None] == rid[None, :]


def _count(shared, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = shared.value
        width = 1 << BIN_BITS if block.last is None else 1 << (block.last - block.shift)
        half = width // 2 if block.last is None else 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rids, bins, counts = [], [], []
            for at, s, own in _scored(block, batch, dim):
                n = len(s)
                base = (block.bin[at] << (block.last - block.shift))[:, None] if block.last is not None else -half
                bin_ = (s >> block.shift) - base
                inside = (bin_ >= 0) & (bin_ < width) & ~own & block.found[at][:, None]
                place = (bin_ + np.arange(n)[:, None] * width)[inside]
                held = np.bincount(place, minlength=n * width).reshape(n, width)
                above = np.cumsum(held[:, ::-1], axis=1)[:, ::-1] - held
                row, col = np.nonzero((held > 0) & (above < block.need[at][:, None]))
                rids.append(row + at.start)
                bins.append(col - half if block.last is None else col + base[row, 0])
                counts.append(held[row, col])
            cat = lambda parts: pa.array(np.concatenate(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([cat(rids), cat(bins), cat(counts)], names=["q", "bin", "n"])

    return trimmed(run)


def _keep(shared, dim: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block = shared.value
        floors = block.floors()
        for batch in batches:
            ids = batch.column("id")
            order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
            batch = batch.take(pa.array(order))
            q, at_row, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, s, own in _scored(block, batch, dim) if batch.num_rows else ():
                open_ = (s >= floors[at][:, None]) & ~own
                col = first_columns(np.where(open_, s, NONE), k)
                row = np.broadcast_to(np.arange(len(s))[:, None], col.shape)
                ok = open_[row, col]
                q.append(row[ok] + at.start)
                at_row.append(col[ok])
                score.append(s[row[ok], col[ok]])
            rows = np.concatenate(at_row)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q)), batch.column("id").take(pa.array(rows)), pa.array(np.concatenate(score))], names=["q", "vec_id", "score"])

    return trimmed(run)


def _locate(block: _Block, counts: DataFrame, k: int) -> None:
    """Find each query's bin from the counts of all tasks; one row a query comes to the driver."""
    down = Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    total = counts.groupBy("q", "bin").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(down))
    need = dict(enumerate(block.need.tolist()))
    first = block.last is None
    wanted = total.where(F.col("upto") >= k) if first else total.join(F.broadcast(counts.sparkSession.createDataFrame([(q, n) for q, n in need.items() if block.found[q]], "q long, need long")), "q").where("upto >= need")
    found = wanted.groupBy("q").agg(F.max_by(F.struct("bin", "upto", "n"), "bin").alias("x")).select("q", "x.*").toArrow()
    q, bin_, upto, n = (found[c].to_numpy() for c in ("q", "bin", "upto", "n"))
    if first:
        block.found[:] = False
        block.found[q] = True
    block.bin[q] = bin_
    block.need[q] -= upto - n  # those above the bin are in
    block.last = block.shift
    block.shift = max(0, block.shift - BIN_BITS)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the k rows of highest score.

    A component x becomes floor(256 * x); the score is the exact inner product of these whole numbers, held at the ends of a
    64-bit integer.  Candidates are all rows but the query's own; rows that repeat an id are rows of their own, as queries
    and as candidates.  Equal scores rank the smaller id first, a null id (which is never a query) last.  With fewer than k
    candidates all are returned.  Vectors null or with null or non-finite components take no part, nor do those of another
    length than the commonest; zero vectors do.  An empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows, dim, norm = sound_vectors(vectors, "topk-rows", id_col=id_col, vec_col=vec_col)
    asking = rows.where(F.col("id") % every == 0)
    blocks = -(-asking.count() // BLOCK_QUERIES)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for i in range(blocks):
        mine = asking.where(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == i).select("rid", "id", "v").toArrow()
        if not mine.num_rows:
            continue
        block = _Block(mine["rid"].to_numpy(), whole(mine["v"].combine_chunks(), dim), k, norm)
        scored = rows.select("rid", "id", "v")
        while block.last is None or block.last > 0:
            counts = scored.mapInArrow(_count(spark.sparkContext.broadcast(block), dim), "q long, bin long, n long")
            _locate(block, counts, k)
        kept = scored.mapInArrow(_keep(spark.sparkContext.broadcast(block), dim, k), "q long, vec_id long, score long")
        best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
        ids = F.broadcast(spark.createDataFrame(list(enumerate(mine["id"].to_pylist())), "q long, query_id long"))  # BLOCK_QUERIES rows
        ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).join(ids, "q")
        out = out.unionByName(settle(ranked.select("query_id", "rank", "vec_id", "score"), "topk-found"))
    return out
