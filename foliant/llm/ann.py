"""Maximum inner product search: anisotropic four-bit product quantisation, table scans, exact reranking.

Codebooks of 16 centres for every two dimensions minimise the score-aware loss: the residual's part parallel to the
vector costs ``eta`` times its orthogonal part, because it is the parallel part that shifts large inner products.
Codebooks and coarse centres are fitted on at most ``SAMPLE`` vectors drawn by a hash of the id; every row is indexed.

Rows are kept in lists by coarse centre, lists that are too long (a very common vector) are cut by a hash of the id,
and queries go to lists: list and query rows meet by key in groups of bounded size.  A group is scanned by adding
table entries for the codes, its best rows are reranked with the original vectors in double precision, then every
further row of the group whose code doesn't rule it out, and the best of all groups are ranked per query.  A code rules
a row out where its sum of entries and |q| times the length of the row's residual stay under the query's ``k``-th score
so far: copies of one vector, or vectors around a far centre, share codes that say nothing about their order.  A query first reads the lists of largest centre product; that gives a ``k``-th score,
and of the other lists it then reads all but those that can't reach it: no row of a list with centre c and radius r
scores above q.c + |q| r.  So no list is left out unless that bound rules it out, at any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, spread, unit_hash

SAMPLE = 32_768
CENTRES, SUB = 16, 2
#: Rows a list should have, most lists, and lists that a query reads at least before others may be ruled out.
LIST_ROWS, MAX_LISTS, LEAST_PROBES = 4_096, 1_024, 16
#: Rows and queries of one group; queries scanned at once.
GROUP_ROWS, GROUP_QUERIES, CHUNK = 8_192, 4_096, 128
#: Rows of a group that are reranked exactly, for each query, before codes rule out others; pairs reranked at once.
RERANK, PAIRS = 200, 32_768
#: Cosine from which inner products matter; sets the weight of the parallel residual.
THRESHOLD = 0.2
SWEEPS = 6


@dataclass
class Quantiser:
    books: np.ndarray  # subspace, centre, SUB
    lists: np.ndarray  # coarse centres
    dim: int

    def padded(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.books.shape[0] * SUB - x.shape[1])))

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        return _assign(self.padded(x), self.books, _eta(self.dim), sweeps)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Per query and pair of subspaces the 256 sums of two table entries."""
        t = np.einsum("qsd,scd->qsc", self.padded(q).reshape(len(q), -1, SUB), self.books, optimize=True).astype(np.float32)
        if t.shape[1] % 2:
            t = np.pad(t, ((0, 0), (0, 1), (0, 0)))
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, CENTRES * CENTRES)

    def reach(self, q: np.ndarray) -> np.ndarray:
        """Per query what no sum of its table entries exceeds."""
        parts = np.sqrt((self.padded(q).reshape(len(q), -1, SUB) ** 2).sum(axis=2))
        return np.maximum(parts @ np.sqrt((self.books**2).sum(axis=2)).max(axis=1), np.finfo(float).tiny)

    def residuals(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Lengths of what the codes leave of each row."""
        r = self.padded(x).reshape(len(x), -1, SUB) - self.books[np.arange(self.books.shape[0]), codes]
        return np.sqrt((r * r).sum(axis=(1, 2)))


def _eta(dim: int) -> float:
    return max(1.0, (dim - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))


def _assign(x: np.ndarray, books: np.ndarray, eta: float, sweeps: int, codes: np.ndarray | None = None) -> np.ndarray:
    """Codes by coordinate descent over subspaces on |residual|^2 + (eta - 1) <residual, x>^2 / |x|^2."""
    parts = x.reshape(len(x), -1, SUB)
    norm = np.maximum((x * x).sum(axis=1), 1e-30)
    if codes is None:
        codes = np.stack([((parts[:, s, None] - books[s]) ** 2).sum(axis=2).argmin(axis=1) for s in range(books.shape[0])], axis=1)
    dots = np.stack([((parts[:, s] - books[s][codes[:, s]]) * parts[:, s]).sum(axis=1) for s in range(books.shape[0])], axis=1)
    total = dots.sum(axis=1)
    for _ in range(sweeps):
        for s in range(books.shape[0]):
            other = total - dots[:, s]
            r = parts[:, s, None] - books[s]
            along = (r * parts[:, s, None]).sum(axis=2)
            codes[:, s] = ((r * r).sum(axis=2) + (eta - 1) * (other[:, None] + along) ** 2 / norm[:, None]).argmin(axis=1)
            dots[:, s] = along[np.arange(len(x)), codes[:, s]]
            total = other + dots[:, s]
    return codes.astype(np.uint8)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        n = np.bincount(near, minlength=k)
        for d in range(x.shape[1]):
            c[:, d] = np.where(n > 0, np.bincount(near, x[:, d], k) / np.maximum(n, 1), c[:, d])
        lost = np.flatnonzero(n == 0)
        c[lost] = x[rng.choice(len(x), len(lost))]
    return c


def train(sample: np.ndarray, lists: int, seed: int = 5) -> Quantiser:
    """Coarse centres by k-means; codebooks by alternating assignments and weighted least squares."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float64)
    dim = x.shape[1]
    subs = -(-dim // SUB)
    padded = np.pad(x, ((0, 0), (0, subs * SUB - dim)))
    parts, eta = padded.reshape(len(x), subs, SUB), _eta(dim)
    norm = np.maximum((padded * padded).sum(axis=1), 1e-30)
    books = np.stack([_kmeans(parts[:, s], CENTRES, 8, rng) for s in range(subs)])
    codes = None
    for _ in range(SWEEPS):
        codes = _assign(padded, books, eta, 1, None if codes is None else codes.astype(np.int64))
        along = lambda s: ((parts[:, s] - books[s][codes[:, s]]) * parts[:, s]).sum(axis=1)
        dots = np.stack([along(s) for s in range(subs)], axis=1)
        total = dots.sum(axis=1)
        for s in range(subs):
            other = total - dots[:, s]
            p, w = parts[:, s], (eta - 1) / norm
            for c in range(CENTRES):
                rows = codes[:, s] == c
                if rows.any():
                    a = rows.sum() * np.eye(SUB) + (p[rows] * w[rows, None]).T @ p[rows]
                    b = (p[rows] * (1 + w[rows] * (other[rows] + (p[rows] ** 2).sum(axis=1)))[:, None]).sum(axis=0)
                    books[s, c] = np.linalg.solve(a, b)
            dots[:, s] = along(s)
            total = other + dots[:, s]
    return Quantiser(books, _kmeans(x, lists, 10, rng), dim)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest values, equal values by column order."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    above, level = scores > edge, scores == edge
    level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | level)[1].reshape(len(scores), k)


def _search(q: Quantiser, ids: np.ndarray, codes: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
    """Exact (query, row, score) of the best k rows of a group for each of its queries, of those that reach its ``floor``."""
    order = np.argsort(ids, kind="stable")
    ids, codes, x = ids[order], codes[order], x[order].astype(np.float64)
    away, longest = q.residuals(x, codes), np.sqrt((x * x).sum(axis=1).max())
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    pair = (codes[:, 0::2].astype(np.int64) * CENTRES + codes[:, 1::2]).T.copy()
    out = []
    for lo in range(0, len(query_ids), CHUNK):
        qi, qv, least = query_ids[lo : lo + CHUNK], queries[lo : lo + CHUNK].astype(np.float64), floor[lo : lo + CHUNK]
        unit = q.reach(qv)
        table = q.tables(qv / unit[:, None])  # sums within -1 and 1, whatever the vectors' scale
        score = np.zeros((len(qi), len(ids)), np.float32)
        for s in range(pair.shape[0]):
            score += np.take(table[:, s], pair[s], axis=1)
        own = qi[:, None] == ids[None, :]
        score[own] = -np.inf
        at = _best(score, RERANK)
        exact = np.einsum("qrd,qd->qr", x[at], qv)
        exact[np.take_along_axis(own, at, axis=1)] = -np.inf
        edge = np.maximum(least, np.partition(exact, -k, axis=1)[:, -k] if exact.shape[1] >= k else -np.inf)
        size = np.sqrt((qv * qv).sum(axis=1))
        slack = 1e-12 * size * longest  # rounding must not rule a row out: of doubles here, of table entries and their sums below
        open_ = score >= ((edge - slack)[:, None] - size[:, None] * away) / unit[:, None] - 4e-7 * (pair.shape[0] + 2)
        open_ &= ~own
        cols = np.flatnonzero(open_.any(axis=0))
        near = qv @ x[cols].T
        near[~open_[:, cols]] = -np.inf
        if len(cols) > k:
            edge = np.maximum(edge, np.partition(near, len(cols) - k, axis=1)[:, -k])
        # products of matrices only choose the pairs: their last digits depend on a row's place
        row, col = np.nonzero((near >= (edge - slack)[:, None]) & np.isfinite(near))
        col = cols[col]
        found = np.concatenate([np.einsum("pd,pd->p", x[col[i : i + PAIRS]], qv[row[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)] or [np.zeros(0)])
        best = np.lexsort((ids[col], -found, row))
        nth = np.arange(len(best)) - np.searchsorted(row[best], row[best])
        best = best[(nth < k) & (found[best] >= least[row[best]])]
        out.append((qi[row[best]], ids[col[best]], found[best]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product for rows whose id is divisible by ``every``.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id or of
    another length than the most common one.  A query never finds rows of its own id; with fewer than k candidates all
    are returned.  Equal scores rank the smaller id first.  A repeated id is searched for once, with the smallest of its vectors,
    component by component, whatever the order of rows.  Other columns are
    ignored; an empty table gives no rows.
    """
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return vectors.sparkSession.createDataFrame([], schema)
    dim, n = lengths[0]
    rows = rows.where(F.size("v") == dim)
    drawn = rows.where(unit_hash(61, F.col("id")) < min(1.0, SAMPLE / n)).select("id", "v").orderBy("id").limit(2 * SAMPLE).toArrow()
    lists = max(1, min(MAX_LISTS, n // LIST_ROWS, max(1, drawn.num_rows // 16)))
    q = train(_matrix(drawn.column("v").combine_chunks(), dim) if drawn.num_rows else np.ones((1, dim)), lists)
    shared = vectors.sparkSession.sparkContext.broadcast(q)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), dim)
                near = (x @ m.lists.T - (m.lists**2).sum(axis=1) / 2).argmax(axis=1)
                away = np.sqrt(((x - m.lists[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(near, pa.int32()), pa.array(away), pa.array([c.tobytes() for c in m.encode(x)], pa.binary()), b.column("v")], names=["id", "list", "away", "code", "v"])

    # components are floats in the table; the index keeps them in double, as the ranking needs them
    indexed = settle(spread(rows).mapInArrow(index, "id long, list int, away double, code binary, v array<double>"), "quantised")
    stats = {r["list"]: r for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away")).collect()}  # at most MAX_LISTS rows
    held = np.array([stats[i]["n"] if i in stats else 0 for i in range(len(q.lists))])
    radius = np.array([stats[i]["away"] if i in stats else 0.0 for i in range(len(q.lists))])
    far = np.sqrt((q.lists**2).sum(axis=1))
    probes = max(LEAST_PROBES, lists // 8)

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column("v"), dim)
                    dots = x @ m.lists.T
                    order = np.argsort(-dots, axis=1, kind="stable")
                    enough = np.cumsum(held[order], axis=1) - held[order] < 10 * k
                    go = enough | (np.arange(order.shape[1]) < probes)
                    if not first:
                        size = np.sqrt((x * x).sum(axis=1))[:, None]
                        bound = dots + size * (radius + 1e-12 * (radius + far))  # rounding must not rule a list out
                        go = ~go & np.take_along_axis(bound >= b.column("floor").to_numpy()[:, None], order, axis=1)
                    at = np.nonzero(go & (held[order] > 0))
                    rows = pa.array(at[0])
                    yield pa.RecordBatch.from_arrays([b.column("id").take(rows), pa.array(order[at], pa.int32()), b.column("floor").take(rows), b.column("v").take(rows)], names=["id", "list", "floor", "v"])

        return run

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        left, right = left.combine_chunks(), right.combine_chunks()
        codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(left.num_rows, -1)
        a, b, s = _search(shared.value, left["id"].to_numpy(), codes, _matrix(left["v"].chunk(0), dim), right["id"].to_numpy(), _matrix(right["v"].chunk(0), dim), right["floor"].to_numpy(), k)
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    key = ["list", "sub", "block"]
    own = lambda seed, of: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(of)).cast("int")
    to = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def scan(asking: DataFrame, first: bool) -> DataFrame:
        queries = asking.mapInArrow(route(first), "id long, list int, floor double, v array<double>")
        asked = {r["list"]: r["count"] for r in queries.groupBy("list").count().collect()}
        sizes = vectors.sparkSession.createDataFrame([(i, -(-int(held[i]) // GROUP_ROWS), -(-n // GROUP_QUERIES)) for i, n in asked.items()], "list int, subs int, blocks int")
        data = indexed.join(F.broadcast(sizes), "list").select("list", own(1, "subs").alias("sub"), to("blocks").alias("block"), "id", "code", "v")
        ask = queries.join(F.broadcast(sizes), "list").select("list", to("subs").alias("sub"), own(2, "blocks").alias("block"), "id", "floor", "v")
        return data.groupBy(*key).cogroup(ask.groupBy(*key)).applyInArrow(group, "query_id long, vec_id long, score double")

    queries = indexed.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).select("id", F.lit(float("-inf")).alias("floor"), "v")
    if probes >= lists:
        return ranked(scan(queries, True))
    queries = settle(queries, "queries")
    near = settle(ranked(scan(queries, True)), "near")
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    asking = settle(queries.drop("floor").join(floors, "id", "left").select("id", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), "v"), "floors")
    return ranked(near.drop("rank").unionByName(scan(asking, False)))
