"""Hard negatives for anchors, found exactly on candidate lists that anchors share.

1. Anchors are clustered by direction (spherical k-means, fitted on at most about ``SAMPLE`` anchors; every anchor is assigned).
   With centre c, and t the largest angle between c and an anchor u of the cluster, no candidate x scores above
   |u| |x| cos(max(0, angle(x, c) - t)).  Without |u| that is the candidate's bound for the whole cluster.
2. For each cluster all candidates are sorted by bound once, over ranges of (cluster, bound), and cut into blocks.  A list
   holds row numbers and bounds only; vectors meet them when a block is walked.
3. Every anchor walks the list of its cluster from the top, block after block and step after step inside a block, and stops
   where it is certain that nothing further down counts: the next bound times |u| is below all it still needs.
   Positives need scores of the fifth best so far or more.  Then each positive has a window of negative scores (``low`` to
   ``high`` percent of its own) and needs those in it, from the third best so far on.

Blocks are walked in rounds that grow four times each; a round is one grouping of (cluster, anchor block, list block) of bounded
size, so a common label, vector or key gathers nothing, and the best of all groups are merged by anchor, at most a few rows each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, ranked_spans, settle, spread, trimmed, unit_hash
from .vectors import HIGH, NONE, first_columns, products, sound_vectors, whole

#: Anchors that the centres are fitted on at most, about; clusters; rounds of k-means.
SAMPLE, CLUSTERS, ROUNDS = 8_192, 8, 8
#: Candidates of a list block, anchors of an anchor block, candidates of one step.
LIST_ROWS, ANCHOR_ROWS, STEP = 4_096, 1_024, 512
#: Growth of the part of a list that a round walks.
GROWTH = 4
#: Angles are widened by this much before they rule anything out, and bounds by this share.
MARGIN, SLACK = 1e-6, 1e-9
#: A null id in tasks: it comes last among equals and is never an anchor's.
NO_ID = (1 << 63) - 1


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def fit_centres(x: np.ndarray, clusters: int = CLUSTERS, seed: int = 3) -> np.ndarray:
    """Unit centres by spherical k-means; fewer where there are fewer vectors."""
    u, norm = _directions(x)
    u = u[norm > 0]
    if not len(u):
        return np.zeros((1, x.shape[1]))
    rng = np.random.default_rng(seed)
    c = u[rng.choice(len(u), min(clusters, len(u)), replace=False)]
    for _ in range(ROUNDS):
        near = (u @ c.T).argmax(axis=1)
        total = np.stack([u[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c = _directions(total)[0]
    return c


def _angles(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ c.T, -1, 1))


def _assigned(centres: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, norm = _directions(whole(batch.column("v"), dim))
                angle = _angles(u, centres)
                near = angle.argmin(axis=1)
                away = np.where(norm > 0, angle[np.arange(len(u)), near], 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), batch.column("label"), batch.column("v"), pa.array(near, pa.int64()), pa.array(away), pa.array(norm)], names=["rid", "id", "label", "v", "cluster", "away", "norm"])

    return trimmed(run)


def _bounds(centres: np.ndarray, widest: np.ndarray, dim: int):
    """One row for each candidate and cluster that has anchors: the candidate's bound for anchors of norm 1."""
    used = np.flatnonzero(~np.isnan(widest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, norm = _directions(whole(batch.column("v"), dim))
                apart = np.maximum(0, _angles(u, centres[used]) - widest[used] - MARGIN)
                bound = np.nan_to_num(norm[:, None] * np.cos(apart), nan=np.inf)
                n = len(used)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(used, len(u)), pa.int64()), pa.array(np.repeat(batch.column("rid").to_numpy(), n)), pa.array(bound.ravel())], names=["part", "rid", "bound"])

    return trimmed(run)


def _better(score, ids, rid, new, k):
    """Merge each row's best so far with its new ones: highest score, then smallest id, then row number."""
    s, i, r = (np.concatenate(x, axis=1) for x in zip((score, ids, rid), new, strict=True))
    top = np.lexsort((r, i, ~s), axis=1)[:, :k]  # ~s falls as s rises, and holds NONE too
    row = np.arange(len(s))[:, None]
    return s[row, top], i[row, top], r[row, top]


def _slots(column: pa.ChunkedArray, fill: int) -> np.ndarray:
    """Anchors by slots; anchors with fewer slots get some that nothing fits."""
    rows = column.to_pylist()
    out = np.full((len(rows), max(map(len, rows))), fill, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _walk(left: pa.Table, right: pa.Table, dim: int, k: int, same: bool) -> pa.Table:
    """Anchors of one block along one block of their list.

    Each anchor has slots: one for positives (``same``), with no ceiling, or one for each window of negatives.  A slot
    takes scores from its floor to its ceiling and returns at most its k best.  ``floors`` says what a slot still needs.
    """
    left, right = left.combine_chunks(), right.combine_chunks().sort_by([("bound", "descending")])
    a, x = whole(left["v"].chunk(0), dim), whole(right["v"].chunk(0), dim)
    norm, bound = left["norm"].to_numpy(), right["bound"].to_numpy()
    label, labels = left["label"].to_numpy(), right["label"].to_numpy()
    rid, rids = left["rid"].to_numpy(), right["rid"].to_numpy()
    ids = right["id"].fill_null(NO_ID).to_numpy()
    floors, ceilings = _slots(left["floors"], HIGH), _slots(left["ceilings"], NONE)
    slots = floors.shape[1]
    best = [tuple(np.full((len(rid), k), fill, np.int64) for fill in (NONE, NO_ID, -1)) for _ in range(slots)]
    for lo in range(0, len(rids), STEP):
        with np.errstate(invalid="ignore"):
            reach = np.nan_to_num(norm * bound[lo], nan=np.inf)
        walking = np.flatnonzero(reach + SLACK * np.abs(reach) >= floors.min(axis=1))
        if not len(walking):
            break  # certain for all: bounds only fall from here
        order = lo + np.lexsort((rids[lo : lo + STEP], ids[lo : lo + STEP]))
        s = products(a[walking], x[order])
        fit = (label[walking, None] == labels[order][None, :]) == same
        fit &= rid[walking, None] != rids[order][None, :]
        for slot in range(slots):
            open_ = fit & (s >= floors[walking, slot][:, None]) & (s <= ceilings[walking, slot][:, None])
            if not open_.any():
                continue
            held = np.where(open_, s, NONE)
            col = first_columns(held, k)
            found = np.take_along_axis(held, col, axis=1)
            none = found == NONE
            new = found, np.where(none, NO_ID, ids[order][col]), np.where(none, -1, rids[order][col])
            merged = _better(*(b[walking] for b in best[slot]), new, k)
            for b, m in zip(best[slot], merged, strict=True):
                b[walking] = m
            floors[walking, slot] = np.maximum(floors[walking, slot], merged[0][:, k - 1])
    out = [[np.zeros(0, np.int64)] for _ in range(5)]
    for slot, (s, i, r) in enumerate(best):
        row, col = np.nonzero(s > NONE)
        for o, v in zip(out, (rid[row], np.full(len(row), slot), s[row, col], i[row, col], r[row, col]), strict=True):
            o.append(v)
    anchor, slot, score, ident, row = (np.concatenate(o) for o in out)
    return pa.table({"anchor": anchor, "slot": pa.array(slot, pa.int32()), "score": score, "id": pa.array(ident, mask=ident == NO_ID), "rid": row})


FOUND = "anchor long, slot int, score long, id long, rid long"


class _Lists:
    """The sorted lists of all clusters and the walk along them."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, centres: np.ndarray, dim: int):
        self.rows, self.dim = rows, dim
        widest = np.full(len(centres), np.nan)
        held = np.zeros(len(centres), np.int64)
        for r in anchors.groupBy("cluster").agg(F.max("away").alias("t"), F.count(F.lit(1)).alias("n")).collect():  # at most CLUSTERS rows
            widest[r["cluster"]], held[r["cluster"]] = r["t"], r["n"]
        listed = settle(spread(rows).mapInArrow(_bounds(centres, widest, dim), "part long, rid long, bound double"), "negatives-bounds")
        placed, spans = ranked_spans(listed.withColumn("down", -F.col("bound")), ["down", "rid"], "negatives-lists")
        self.entries = numbered(placed, spans).select(F.col("part").alias("cluster"), F.floor(F.col("rank") / LIST_ROWS).alias("block"), "rid", "bound")
        self.edges = settle(self.entries.groupBy("cluster", "block").agg(F.max("bound").alias("edge")), "negatives-edges")
        self.blocks = self.entries.sparkSession.createDataFrame([(i, max(1, -(-int(n) // ANCHOR_ROWS))) for i, n in enumerate(held)], "cluster long, sides int")
        self.last = (self.edges.agg(F.max("block")).first()[0] or 0) + 1

    def walk(self, anchors: DataFrame, slots: DataFrame, k: int, same: bool, label: str) -> DataFrame:
        """(anchor, slot, score, id, rid): each slot's k best; ``slots``: (anchor, slot, floor, ceiling)."""
        spark = anchors.sparkSession
        found = spark.createDataFrame([], FOUND)
        begin, end, dim = 0, 1, self.dim
        best = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "rid")
        while begin < self.last:
            have = found.groupBy("anchor", "slot").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
            need = F.when(F.col("n") >= k, F.greatest("floor", "least")).otherwise(F.col("floor"))
            state = slots.join(have, ["anchor", "slot"], "left").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", need.alias("floor"), "ceiling"))).alias("s"))
            state = state.select(F.col("anchor").alias("rid"), F.col("s.floor").alias("floors"), F.col("s.ceiling").alias("ceilings"))  # one entry a slot
            edge = F.broadcast(self.edges.where(F.col("block") == begin).select("cluster", "edge"))  # at most CLUSTERS rows
            reach = F.col("norm") * F.col("edge")
            going = anchors.join(state, "rid").join(edge, "cluster").where(F.isnan(reach) | (reach + SLACK * F.abs(reach) >= F.array_min("floors")))
            going = settle(going.select("cluster", "rid", "label", "v", "norm", "floors", "ceilings"), f"{label}-going")
            if going.isEmpty():
                break
            sides = F.broadcast(self.blocks)
            walkers = going.join(sides, "cluster").withColumn("side", F.pmod(F.xxhash64("rid"), F.col("sides")).cast("int"))
            busy = going.join(sides, "cluster").select("cluster", F.pmod(F.xxhash64("rid"), F.col("sides")).cast("int")).toDF("cluster", "side").distinct()
            part = self.entries.where((F.col("block") >= begin) & (F.col("block") < end))
            part = part.join(F.broadcast(busy) if busy.count() <= 10_000 else busy, "cluster").join(self.rows.select("rid", "id", "label", "v"), "rid")
            there = self.edges.where((F.col("block") >= begin) & (F.col("block") < end)).select("cluster", "block")
            walkers = walkers.join(there, "cluster").select("cluster", "side", "block", "rid", "label", "v", "norm", "floors", "ceilings")

            def group(left: pa.Table, right: pa.Table) -> pa.Table:
                if not left.num_rows or not right.num_rows:
                    return pa.table({n: pa.array([], t) for n, t in (("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("rid", pa.int64()))})
                return _walk(left, right, dim, k, same)

            key = ["cluster", "side", "block"]
            new = walkers.groupBy(*key).cogroup(part.select(*key, "rid", "id", "label", "bound", "v").groupBy(*key)).applyInArrow(group, FOUND)
            merged = found.unionByName(new).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth")
            found = settle(merged, f"{label}-found")
            begin, end = end, end + (end - begin) * GROWTH
        return found


def _windows(found: DataFrame, low: int, high: int) -> DataFrame:
    """(anchor, slot, floor, ceiling, positive_score): the window of negative scores of each different positive score that has one.

    Whole hundreds and the rest apart, so that no product leaves 64 bits.  Below 0 a window is empty.
    """
    scores = found.groupBy("anchor").agg(F.sort_array(F.collect_set("score"), asc=False).alias("s")).select("anchor", F.posexplode("s").alias("slot", "positive_score"))
    windows = scores.where("positive_score >= 0").selectExpr(
        "anchor", "slot", f"{low} * (positive_score div 100) + ({low} * (positive_score % 100) + 99) div 100 as floor", f"{high} * (positive_score div 100) + ({high} * (positive_score % 100)) div 100 as ceiling", "positive_score"
    )
    return windows.where("floor <= ceiling")


def mine_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, low: int = 50, high: int = 95, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows whose id is divisible by ``every``.

    A component x becomes floor(256 * x); a row's score is its exact inner product with the anchor, held at 2^63 - 1 and its
    negative.  Higher scores come first, equal ones by smaller id, null ids (never anchors) last.  Positives are the first
    ``positives`` other rows of the anchor's label, or all; negatives of a positive are the first ``negatives`` rows of another
    label, or all, that score from ``low`` to ``high`` percent (at most 100) of it.  Labels are whole numbers.

    Rows with a null label, and vectors null or with null or non-finite components, take no part, nor do those of another
    length than the commonest; zero vectors do.  Rows that repeat an id are rows of their own, as anchors and candidates.
    An anchor without positives, or without negatives in a window, has no rows there; an empty table gives none.  Other columns
    are ignored, whatever their names.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("percentages must rise from 0 to 100")
    spark = vectors.sparkSession
    labelled = vectors.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id_"), F.col(vec_col).alias("v_"), F.col(label_col).cast("long").alias("label"))
    rows, dim, _ = sound_vectors(labelled, "negatives-rows", "label", id_col="id_", vec_col="v_")
    asking = rows.where(F.col("id") % every == 0)
    n = asking.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    drawn = asking.where(unit_hash(83, F.col("rid")) < min(1.0, SAMPLE / n)).select("v").toArrow()
    centres = fit_centres(whole(drawn["v"].combine_chunks(), dim))
    anchors = settle(asking.mapInArrow(_assigned(centres, dim), "rid long, id long, label long, v array<double>, cluster long, away double, norm double"), "negatives-anchors")
    lists = _Lists(rows, anchors, centres, dim)
    slots = anchors.select(F.col("rid").alias("anchor"), F.lit(0).alias("slot"), F.lit(NONE).alias("floor"), F.lit(HIGH).alias("ceiling"))
    near = lists.walk(anchors, slots, positives, True, "negatives-positives")
    windows = settle(_windows(near, low, high), "negatives-windows")
    hard = lists.walk(anchors, windows.select("anchor", "slot", "floor", "ceiling"), negatives, False, "negatives-hard")
    nth = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "rid")
    hard = hard.select("anchor", "slot", F.row_number().over(nth).alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(windows.select("anchor", "slot", "positive_score"), ["anchor", "positive_score"])
    named = anchors.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    return pairs.join(hard, ["anchor", "slot"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
