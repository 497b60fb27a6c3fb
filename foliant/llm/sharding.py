"""Sharding by sampled splitters.

Records are ordered by (hash of the text, id), so equal texts are neighbours.  Keys are sampled with a
probability that grows with a record's size, weighted quantiles of the sample become range boundaries, ranges
that turn out overfull get boundaries of their own from a denser sample, and running byte counts inside the
ranges place every record: shard ``s`` holds the records whose middle byte lies in the ``s``-th equal part of
all bytes.  Byte totals of two shards therefore differ by less than two records.

Only ids, sizes and hashes are shuffled; texts are read once.  The sample has at most
``SAMPLES_A_RANGE * MAX_RANGES`` keys in expectation, and up to 16 times as many keys of overfull ranges alone when
these are sampled again, however large the input is, so the driver's share is bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, unit_hash, utf8_length

ROWS_A_RANGE = 250_000
MIN_RANGES, MAX_RANGES = 256, 16_384
SAMPLES_A_RANGE = 32
#: A range with this many times the mean rows or bytes is divided again.
OVERFULL = 3.0
ROUNDS = 3
NO_ID = -(2**63)


def _splitters(sample: pd.DataFrame, ranges: int) -> np.ndarray:
    """Boundaries (key, id) at the weighted quantiles of a sample; record array rows are sorted and distinct."""
    sample = sample.sort_values(["key", "id"], kind="stable")
    weight = sample["weight"].to_numpy(float).cumsum()
    if not len(weight):
        return np.empty((0, 2), np.int64)
    at = np.searchsorted(weight, np.arange(1, ranges) * weight[-1] / ranges)
    return np.unique(sample[["key", "id"]].to_numpy(np.int64)[np.minimum(at, len(weight) - 1)], axis=0)


def range_of(bounds: np.ndarray, key: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """Number of boundaries at or below each (key, id)."""
    first, last = np.searchsorted(bounds[:, 0], key, "left"), np.searchsorted(bounds[:, 0], key, "right")
    out = first.copy()
    tied = np.flatnonzero(first < last)
    for k in np.unique(key[tied]):
        rows = tied[key[tied] == k]
        lo, hi = first[rows[0]], last[rows[0]]
        out[rows] = lo + np.searchsorted(bounds[lo:hi, 1], ident[rows], "right")
    return out


def _range_column(bounds: np.ndarray) -> Column:
    @F.pandas_udf("int")
    def of(key: pd.Series, ident: pd.Series) -> pd.Series:
        return pd.Series(range_of(bounds, key.to_numpy(np.int64), ident.to_numpy(np.int64)).astype(np.int32))

    return of("key", "id")


def _sample(rows: DataFrame, rate: float, total: int, count: int, seed: int) -> pd.DataFrame:
    """Keys drawn with a chance of rate * (half the share of bytes + half the share of records)."""
    share = rate * (F.col("bytes") / (2.0 * total) + F.col("copies") / (2.0 * count))
    rows = rows.where(unit_hash(seed, F.col("key"), F.col("id")) < share)
    return rows.select("key", "id", F.greatest(share, F.lit(1.0)).alias("weight")).toPandas()


def assign_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every row of ``docs``: (id, size, text_crc32, law, shard, slot, grown_shard).

    Size is the UTF-8 length of the text plus 1; a null text has size 1 and checksum 0.  Slots count up from 0 in
    each shard in key order.  Rows that repeat (same id, same text) are placed one by one; a null id sorts first.
    Ties in the hash of different texts are ordered by id, so they do no harm.  An empty table gives no rows.
    Further columns of ``docs``, whatever their names, are ignored.
    """
    text = F.col(text_col)
    each = docs.select(
        F.col(id_col).alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("key"),
        (utf8_length(text) + 1).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
    )
    # repeated rows travel as one with a count, so that no key is indivisible
    rows = settle(each.groupBy("given", "id", "key", "size", "crc").agg(F.count(F.lit(1)).alias("copies")).withColumn("bytes", F.col("size") * F.col("copies")), "shard-keys")
    total, count = rows.agg(F.sum("bytes"), F.sum("copies")).first()
    total, count = total or 0, count or 0
    ranges = int(min(MAX_RANGES, max(min(MIN_RANGES, -(-count // 100)), 1, -(-count // ROWS_A_RANGE))))
    rate = float(SAMPLES_A_RANGE * ranges)
    bounds = _splitters(_sample(rows, rate, max(total, 1), max(count, 1), seed), ranges)
    for again in range(ROUNDS):
        ranged = rows.withColumn("range", _range_column(bounds))
        held = ranged.groupBy("range").agg(F.sum("bytes").alias("bytes"), F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("keys")).toPandas().sort_values("range")
        over = held[(held["keys"] > 1) & ((held["bytes"] > OVERFULL * total / ranges) | (held["copies"] > OVERFULL * count / ranges))]
        if not len(over) or again == ROUNDS - 1 or len(bounds) > 2 * MAX_RANGES:
            break
        inside = F.broadcast(rows.sparkSession.createDataFrame(over[["range"]], "range int"))
        more = _sample(ranged.join(inside, "range", "left_semi"), 8.0 * rate * (again + 1), total, count, seed + again + 1)
        parts = max(2, round(2 * max(over["bytes"].sum() / total, over["copies"].sum() / count) * ranges))
        bounds = np.unique(np.concatenate([bounds, _splitters(more, parts)]), axis=0)
    base = held.assign(bytes_before=held["bytes"].cumsum() - held["bytes"], rows_before=held["copies"].cumsum() - held["copies"])
    starts = F.broadcast(rows.sparkSession.createDataFrame(base[["range", "bytes_before", "rows_before"]], "range int, bytes_before long, rows_before long"))
    before = Window.partitionBy("range").orderBy("key", "id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumns({"b": F.coalesce(F.sum("bytes").over(before), F.lit(0)), "r": F.coalesce(F.sum("copies").over(before), F.lit(0))})
        .join(starts, "range")
        .select("given", "size", "crc", (F.col("bytes_before") + F.col("b")).alias("b"), (F.col("rows_before") + F.col("r")).alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
        .select("given", "size", "crc", (F.col("r") + F.col("copy")).alias("nth"), F.expr(f"cast(least((2 * (b + copy * size) + size) * {n_shards} div {2 * max(total, 1)}, {n_shards - 1}) as int)").alias("shard"))
    )
    placed = settle(placed, "shard-places")
    firsts = dict(placed.groupBy("shard").agg(F.min("nth")).collect())  # n_shards rows
    first = F.coalesce(*[F.when(F.col("shard") == s, F.lit(n)) for s, n in sorted(firsts.items())], F.lit(0))
    return placed.select(
        F.col("given").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("nth") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``_copy``: rows of equal keys counted from 0, first within input partitions and then over these, so that a key of very many rows is never sorted whole."""
    rows = settle(rows.withColumn("_part", F.spark_partition_id()), "repeated-rows")
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    held = held.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_part").alias("_part_"), "_before")
    same = F.col("_part") == F.col("_part_")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(F.lit(0)))
    return rows.withColumn("_nth", nth).join(held, same).withColumn("_copy", F.col("_before") + F.col("_nth") - 1).drop("_part", "_part_", "_nth", "_before", *[f"{k}_" for k in keys])


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place the rows of ``docs``, write them below ``path``, one folder a shard, ordered by slot, and return the placements.

    Rows meet their places by id and text (its length and two checksums, which the placement orders by); rows that repeat
    have places of their own, and which of equal rows gets which of them is left open.  Columns named ``shard`` and
    ``slot`` are replaced.
    """
    placed = settle(assign_shards(docs, n_shards, seed, id_col, text_col), "shard-rows")
    keys = ["_id", "_size", "_crc"]
    rows = docs.drop("shard", "slot").withColumns({"_id": F.col(id_col), "_size": utf8_length(F.col(text_col)) + 1, "_crc": F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))})
    places = placed.select(F.col(id_col).alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    often = settle(places.groupBy(*keys).count().where("count > 1").select(*[F.col(k).alias(f"{k}_") for k in keys]), "repeated-keys")

    def meet(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
        right = right.withColumnsRenamed({k: f"{k}_" for k in on})
        same = F.lit(True)
        for k in on:
            same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
        return left.join(right, same, how).drop(*[f"{k}_" for k in on])

    named = often.withColumnsRenamed({f"{k}_": k for k in keys})
    once = meet(meet(rows, named, keys, "left_anti"), meet(places, named, keys, "left_anti"), keys, "inner")
    again = meet(_numbered(meet(rows, named, keys, "left_semi"), keys), _numbered(meet(places, named, keys, "left_semi"), keys), [*keys, "_copy"], "inner")
    joined = once.unionByName(again.drop("_copy")).drop(*keys)
    joined.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed
