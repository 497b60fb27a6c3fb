"""Mixing sources to target weights by subset-sum budget fitting.

1. Per-source word counts give the targets: 150 % of all words shared by weight, a source stopping at twice its
   own words and the excess reshared among the others (found as one water level, by aggregates over sources).
2. Per source, documents are counted by exact length.  Every document is taken ``floor(target / words)`` times;
   the remaining budget is fitted by taking the same share of each length's documents and closing the gap with a
   bounded-knapsack dynamic programme over the lengths that are left.
3. Per (source, length) the chosen number of rows is drawn by a seeded hash of id and text.  Large length groups are
   cut into hash bins, whole bins are taken below the threshold, and only the different hashes of the bin at the
   threshold are ranked, by their counts, so no group is ever gathered in one task.  Rows that repeat id and text share a
   hash; where the threshold falls among them, as many as are wanted are drawn by row number in the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, settle, unit_hash

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
#: Documents in one hash bin of a length group, on average.
BIN_ROWS = 100
#: Rows of the selection table (distinct source and length) up to which it is broadcast; beyond, a shuffle join.
BROADCAST_ROWS = 400_000
#: The dynamic programme's table has at most this many sums; it is reached only with documents longer than that.
GAP = 1 << 17


def bounded_subset(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many items of each length to take so that their sum comes as near ``budget`` as any choice not above it.

    The classic bounded-knapsack table: for each sum the length that first reached it.  Lengths are tried in
    ascending order and the table is closed as soon as the budget itself is reached.
    """
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not len(lengths):
        return take
    by = np.full(budget + 1, -1, np.int64)
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    for i, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        if not 0 < length <= budget:
            continue
        steps = -(-(budget + 1) // length)
        grid = np.zeros(steps * length, bool)
        grid[: budget + 1] = reached
        grid = grid.reshape(steps, length)  # a column holds the sums that differ by multiples of this length
        nth = np.arange(steps)[:, None]
        used = nth - np.maximum.accumulate(np.where(grid, nth, -steps - count), axis=0)
        ok = (used <= count).ravel()[: budget + 1]
        by[ok & ~reached] = i
        reached = ok
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at > 0:
        take[by[at]] += 1
        at -= int(lengths[by[at]])
    return take


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """Counts to take of each length, summing to ``budget`` words as nearly as can be."""
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    words = int((lengths * counts).sum())
    goal = int(min(max(round(budget), 0), words))
    if not words or not goal:
        return np.zeros(len(lengths), np.int64)
    take = np.floor(counts * (goal / words)).astype(np.int64)
    gap = goal - int((lengths * take).sum())
    longest = int(lengths.max())
    for i in np.argsort(-lengths, kind="stable"):  # one more of each length, down to a gap that the table can close
        if lengths[i] <= 0 or gap <= max(2 * longest, 1024):
            break
        if take[i] < counts[i] and gap - lengths[i] >= longest:
            take[i] += 1
            gap -= int(lengths[i])
    while gap > GAP:  # documents longer than the table: nearest fit from above first
        i = int(np.argmax(np.where((take < counts) & (lengths <= gap), lengths, 0)))
        if take[i] >= counts[i] or not 0 < lengths[i] <= gap:
            break
        take[i] += 1
        gap -= int(lengths[i])
    left = counts - take
    open_ = np.flatnonzero((left > 0) & (lengths > 0) & (lengths <= gap))
    take[open_] += bounded_subset(lengths[open_], left[open_], min(gap, GAP))
    return take


def source_targets(by_source: DataFrame) -> DataFrame:
    """(source, source_size) -> + target.  Weights repeat over sources in code point order, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    ranked = by_source.orderBy(*order).rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.col("nth") % len(WEIGHTS) + 1).cast("int"))
    ranked = settle(by_source.sparkSession.createDataFrame(ranked, "source string, source_size long, nth long").withColumn("weight", w), "mix-sources")
    budget = BUDGET * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    cap, level, stopped = MOST * F.col("source_size"), 0.0, -1
    while True:  # the level rises until no further source stops: at most one round a source, a few in practice
        over = cap <= F.lit(level) * F.col("weight")
        held, rest, n = ranked.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if n == stopped or not rest:
            break
        level, stopped = (budget - (held or 0)) / rest, n
    return ranked.select("source", "source_size", F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def _choose(pdf: pd.DataFrame) -> pd.DataFrame:
    """One source's length counts -> base repeats and number of extra documents for each length."""
    pdf = pdf.sort_values("size")
    words, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    base = min(int(target // words), MOST) if words else 0
    extra = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), target - base * words) if base < MOST else np.zeros(len(pdf), np.int64)
    return pdf.assign(base=base, extra=extra)[["source", "size", "source_size", "target", "n", "base", "extra"]]


def _measured(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with the columns that decide: source, words, and a draw in [0, 1) from id and text."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"_source": F.col(source_col).cast("string"), "_size": words, "_u": unit_hash(seed, F.col(id_col).cast("string"), F.col(text_col))})


def _cut(rows: DataFrame, want: DataFrame, few: bool, label: str) -> DataFrame:
    """(source, size, edge, rest, held): the value up to which ``extra`` of a group's ``n`` rows are taken.

    ``rows`` has (source, size, value in [0, 1)), ``want`` (source, size, n, extra).  ``held`` rows have the value ``edge``
    itself, and ``rest`` of them are due.
    """
    bins = F.ceil(F.col("n") / BIN_ROWS)
    binned = settle(_with_plan(rows, want, few).withColumn("bin", F.floor(F.col("value") * bins).cast("long")), f"{label}-bins")
    # rows of a group in earlier bins, from one row a bin; the bin in which the count of extra rows is reached
    per_bin = binned.groupBy("source", "size", "bin").agg(F.count(F.lit(1)).alias("held"), F.first("extra").alias("extra"))
    w = Window.partitionBy("source", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    per_bin = per_bin.withColumn("earlier", F.coalesce(F.sum("held").over(w), F.lit(0)))
    split = settle(per_bin.where("earlier < extra and earlier + held >= extra").select("source", "size", F.col("bin").alias("last"), (F.col("extra") - F.col("earlier")).alias("nth")), f"{label}-thresholds")
    edge = _with_plan(binned.drop("n", "extra"), split, few).where("bin = last").groupBy("source", "size", "nth", "value").agg(F.count(F.lit(1)).alias("held"))
    w = Window.partitionBy("source", "size").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("earlier", F.coalesce(F.sum("held").over(w), F.lit(0))).where("earlier < nth and earlier + held >= nth")
    return settle(edge.select("source", "size", F.col("value").alias("edge"), (F.col("nth") - F.col("earlier")).alias("rest"), "held"), f"{label}-edges")


def _plan(sized: DataFrame) -> tuple[DataFrame, bool]:
    """(source, size, u) -> source_size, target, base repeats and ``u_max``; whether the plan may be broadcast.

    Rows whose draw is below ``u_max`` are taken once more; of the ``held`` rows that have it, ``rest`` are.
    """
    counted = settle(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    targets = source_targets(counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    lengths = counted.join(targets, counted["source"].eqNullSafe(targets["source"])).select(counted["source"], "size", "n", "source_size", "target")
    chosen = settle(lengths.groupBy("source").applyInPandas(_choose, "source string, size long, source_size long, target double, n long, base int, extra long"), "mix-choice")
    few = chosen.count() <= BROADCAST_ROWS
    part = chosen.where("extra > 0 and extra < n")
    edge = _cut(sized.select("source", "size", F.col("u").alias("value")), part.select("source", "size", "n", "extra"), few, "mix").withColumnsRenamed({"source": "s_", "size": "z_"})
    same = chosen["source"].eqNullSafe(edge["s_"]) & (chosen["size"] == edge["z_"])
    u_max = F.when(F.col("extra") <= 0, -1.0).when(F.col("extra") >= F.col("n"), 2.0).otherwise(F.col("edge"))
    plan = chosen.join(edge, same, "left").select("source", "size", "source_size", "target", "base", u_max.alias("u_max"), F.coalesce("rest", F.lit(0)).alias("rest"), F.coalesce("held", F.lit(0)).alias("held"))
    return settle(plan, "mix-plan"), few


def _among_equals(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """``rows`` (source, size, u, v) with their plan and ``repeats``: where draws are equal at the threshold, v decides."""
    tied = settle(plan.where("rest < held"), "mix-tied")
    joined = _with_plan(rows, plan, few)
    more = F.expr("u <= u_max")
    if not tied.isEmpty():
        equal = _with_plan(rows, tied.select("source", "size", "u_max"), few).where("u = u_max").select("source", "size", F.col("v").alias("value"))
        edge = _cut(equal, tied.select("source", "size", F.col("held").alias("n"), F.col("rest").alias("extra")), few, "mix-equal").withColumnsRenamed({"source": "s_", "size": "z_", "edge": "v_max"}).drop("rest", "held")
        edge = F.broadcast(edge) if few else edge
        joined = joined.join(edge, joined["source"].eqNullSafe(edge["s_"]) & (joined["size"] == edge["z_"]), "left").drop("s_", "z_")
        more = F.expr("u < u_max or u = u_max and v <= coalesce(v_max, 2.0)")
    return joined.withColumn("repeats", (F.col("base") + F.when(more, 1).otherwise(0)).cast("int"))


def _with_plan(rows: DataFrame, plan: DataFrame, few: bool, source: str = "source", size: str = "size") -> DataFrame:
    """Rows joined to the plan of their source and length: broadcast where its size was checked, else a shuffle join of plain tables, which adaptive execution splits at hot keys."""
    side = plan.withColumnsRenamed({"source": "s_", "size": "z_"})
    return rows.join(F.broadcast(side) if few else side, rows[source].eqNullSafe(side["s_"]) & (rows[size] == side["z_"])).drop("s_", "z_")


def mix_sources(docs: DataFrame, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often each document enters the mix: (id, source, size, source_size, target, taken, repeats).

    Size counts words; a null text has none and is taken for 0 words; very long texts are counted whole.  A null source is
    a source of its own.  Documents of one source and length are drawn by a hash of id, text and seed.  Rows that repeat
    both, or repeat null ids, are drawn one by one, so that every source comes near its target: reruns agree on how many of
    equal rows are taken, not on which.  An empty table gives no rows; other columns are ignored, whatever their names.
    """
    measured = _measured(docs.select(id_col, text_col, source_col), seed, id_col, text_col, source_col)
    columns = [F.col(id_col).alias("id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_u").alias("u"), unit_hash(seed + 1, F.monotonically_increasing_id()).alias("v")]
    sized = settle(measured.select(*columns), "mix-sizes")
    plan, few = _plan(sized)
    mixed = _among_equals(sized, plan, few)
    return mixed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def mix_documents(docs: DataFrame, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as often as ``mix_sources`` takes it, with the columns of ``docs``.

    Texts aren't shuffled, and only rows among which a threshold falls, because they repeat id and text, are written once
    more.  Nulls, repeated rows and empty tables are handled as there.
    """
    measured = _measured(docs, seed, id_col, text_col, source_col)
    plan, few = _plan(settle(measured.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_u").alias("u")), "mix-sizes"))
    side = plan.select(F.col("source").alias("s_"), F.col("size").alias("z_"), F.col("base").alias("base_"), F.col("u_max").alias("u_max_"), (F.col("rest") < F.col("held")).alias("tied_"))
    side = F.broadcast(side) if few else side
    joined = measured.join(side, measured["_source"].eqNullSafe(side["s_"]) & (measured["_size"] == side["z_"]))
    times = lambda of, n: of.withColumn("_nth", F.explode(F.expr(f"array_repeat(0, {n})"))).select(*docs.columns)
    clear = times(joined.where("not (tied_ and _u = u_max_)"), "base_ + if(_u <= u_max_, 1, 0)")
    if plan.where("rest < held").isEmpty():
        return clear
    # rows that share the draw at a threshold: numbered in a written table, then drawn by number
    equal = settle(joined.where("tied_ and _u = u_max_").select(F.struct(*docs.columns).alias("row"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_u").alias("u"), unit_hash(seed + 1, F.monotonically_increasing_id()).alias("v")), "mix-equals")
    drawn = _among_equals(equal, plan, few).select("row", "repeats")
    return clear.unionByName(drawn.withColumn("_nth", F.explode(F.expr("array_repeat(0, repeats)"))).select("row.*"))
