"""Exact order statistics by distributed selection: range counts close in on a position, and no values are gathered.

Each pass counts the values of every group by ``BINS`` ranges between the bounds of the position sought, and goes on in the range
that holds it, with that range's own least and greatest value as bounds, until both are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.sources.scratch import settle

BINS = 1024
#: Positions sought (groups by names) up to which they are broadcast to the rows.
MOST_SENT = 100_000


def nearest_rank(share: float) -> Column:
    """Position of a nearest-rank percentile among ``n`` values from 0: halves go to even."""
    return F.greatest(F.least(F.bround((F.col("n") - 1) * F.lit(share), 0).cast("long"), F.col("n") - 1), F.lit(0).cast("long"))


def select_positions(rows: DataFrame, group: list[str], value: str, positions: dict[str, Column]) -> DataFrame:
    """(group, n, one column for each position): the values at positions, counted from 0 among a group's ``n`` sorted values.

    ``positions`` are expressions of ``n``; those outside 0 to n - 1 give null.  Null and NaN values take no part, a group without
    others has no row; null group keys are a group; ties are values like others.
    """
    v = F.col(value)
    kept = rows.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], v.alias("v"))
    keys = [f"g{i}" for i in range(len(group))]
    sizes = settle(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-sizes")
    sought = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), p.cast("long").alias("need")) for name, p in positions.items()]))
    open_ = sizes.withColumn("s", sought).select(*keys, "s.*", "lo", "hi", "n").where("need >= 0 and need < n").drop("n")
    done = open_.where("lo = hi")
    open_ = settle(open_.where("lo < hi"), "quantile-open")
    while not open_.isEmpty():
        named = open_.withColumnsRenamed({k: f"{k}_" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & kept[k].eqNullSafe(named[f"{k}_"])
        side = F.broadcast(named) if open_.count() <= MOST_SENT else named
        within = kept.join(side, same & (kept["v"] >= named["lo"]) & (kept["v"] <= named["hi"]))
        # rises with v, is 0 at lo and BINS - 1 at hi, so that every pass closes in
        bin_ = F.least(F.floor((F.col("v").cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double")) * BINS), F.lit(BINS - 1))
        apart = F.when(F.col("hi").cast("double") > F.col("lo").cast("double"), bin_).otherwise(F.when(F.col("v") == F.col("lo"), 0).otherwise(1))  # whole numbers that no double tells apart
        counts = within.groupBy(*keys, "name", "need", apart.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "name").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most BINS rows
        found = counts.withColumn("before", before).where("before <= need and need < before + c").select(*keys, "name", (F.col("need") - F.col("before")).alias("need"), "lo", "hi")
        found = settle(found, "quantile-pass")
        done, open_ = done.unionByName(found.where("lo = hi")), found.where("lo < hi")
    wide = done.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in positions])
    sizes = sizes.select(*[F.col(k).alias(f"{k}_") for k in keys], "n")
    same = F.lit(True)
    for k in keys:
        same = same & sizes[f"{k}_"].eqNullSafe(wide[k])
    joined = sizes.join(wide, same, "left") if keys else sizes.crossJoin(wide)  # one row each without keys
    return joined.where("n > 0").select(*[F.col(f"{k}_").alias(g) for k, g in zip(keys, group, strict=True)], "n", *positions)


def percentile_cont(rows: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, one column for each share): percentiles that interpolate between the two nearest values."""
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    positions = {f"{name}_{side}": f(at(p)) for name, p in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    found = select_positions(rows, group, value, positions)
    mixed = [(F.col(f"{name}_low") + (F.col(f"{name}_high") - F.col(f"{name}_low")) * (at(p) - F.floor(at(p)))).alias(name) for name, p in shares.items()]
    return found.select(*group, "n", *mixed)
