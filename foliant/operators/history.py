"""Histories: state at a time, and the spans in which it held, from an append-only log.

A key's log may be a large share of all rows, so its time line is cut into slices.  Inside a slice a window finds the last entry; what
a slice starts with is carried over from the slices before, of which there is one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def _slice(at: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(seconds * 1_000_000)).alias("slice_")


def state_at(probes: DataFrame, log: DataFrame, keys: list[str], at: str, value: str, order: str, seconds: int = DAY) -> DataFrame:
    """``probes`` with ``value``: that of the last log entry of the same key at or before ``at``, null without one.

    Entries of one time are in the order of ``order``.  Rows with a null ``at`` have no state and give none; null keys match
    nothing.  ``seconds`` is the length of a slice; it changes nothing but the size of groups.
    """
    state = F.struct(F.col(value).alias("v"))
    entries = log.dropna(subset=[at, *keys]).select(*keys, F.col(at).alias("at_"), F.lit(0).alias("probe_"), F.struct(F.col(at).alias("t"), F.col(order).alias("o"), state.alias("s")).alias("entry_"), F.lit(None).cast(probes.schema).alias("row_"))
    entry = entries.schema["entry_"].dataType
    asked = probes.select(*keys, F.col(at).alias("at_"), F.lit(1).alias("probe_"), F.lit(None).cast(entry).alias("entry_"), F.struct(*probes.columns).alias("row_"))
    both = entries.unionByName(asked).withColumn("slice_", _slice("at_", seconds))
    last = both.where("probe_ = 0").groupBy(*keys, "slice_").agg(F.max("entry_").alias("last_"))
    slices = both.select(*keys, "slice_").distinct().join(last, [*keys, "slice_"], "left")
    earlier = Window.partitionBy(*keys).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)  # one row a slice
    carried = slices.select(*keys, "slice_", F.max("last_").over(earlier).alias("carried_"))
    upto = Window.partitionBy(*keys, "slice_").orderBy("at_", "probe_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("own_", F.max("entry_").over(upto)).where("probe_ = 1")
    joined = own.join(carried, [*keys, "slice_"], "left")
    known = F.coalesce("own_", "carried_")
    return joined.select("row_.*", F.when(F.col("at_").isNotNull(), known["s"]["v"]).alias(value))


def spans(log: DataFrame, keys: list[str], at: str, value: str, order: str, seconds: int = DAY) -> DataFrame:
    """(keys, value, valid_from, valid_to): how long each entry held; the end is open (null) for a key's last entry.

    Entries that are replaced at the very time they begin at held for no time and are left out.
    """
    rows = log.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("valid_from"), F.col(order).alias("order_"), F.col(value).alias(value), _slice(at, seconds))
    first = rows.groupBy(*keys, "slice_").agg(F.min("valid_from").alias("first_"))
    later = Window.partitionBy(*keys).orderBy("slice_").rowsBetween(1, 1)
    after = first.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("slice_").alias("s_"), F.min("first_").over(later).alias("after_"))
    same = F.col("slice_") == F.col("s_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    following = Window.partitionBy(*keys, "slice_").orderBy("valid_from", "order_")
    held = rows.withColumn("next_", F.lead("valid_from").over(following)).join(after, same)
    held = held.withColumn("valid_to", F.coalesce("next_", "after_"))
    return held.where("valid_to is null or valid_to > valid_from").select(*keys, value, "valid_from", "valid_to")
