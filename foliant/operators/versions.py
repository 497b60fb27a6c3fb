"""Versioned tables: switching the latest version, upserts, reconciliation, migration, repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def switch_latest(rows: DataFrame, current: DataFrame, key: str = "source", version: str = "doc_version") -> DataFrame:
    """``is_latest`` of every row: its version is its key's current one; keys without a current version have none."""
    cur = current.select(F.col(key).alias("k_"), F.col(version).alias("v_"))
    return rows.join(cur, rows[key] == cur["k_"], "left").withColumn("is_latest", F.coalesce(F.col(version) == F.col("v_"), F.lit(False))).drop("k_", "v_")


def current_versions(rows: DataFrame, key: str = "source", version: str = "doc_version") -> DataFrame:
    return rows.groupBy(key).agg(F.max(version).alias(version))


def next_versions(rows: DataFrame, key: str = "source", version: str = "doc_version") -> DataFrame:
    return rows.groupBy(key).agg((F.coalesce(F.max(version), F.lit(0)) + 1).alias("next_version"))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``changes`` replace rows of equal keys: an anti join and a union, as a table rewrite."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def reconcile(source: DataFrame, target: DataFrame, key: str, version: str) -> DataFrame:
    """(key, state): missing in the target, stale there, orphaned there, or in step; one full outer join."""
    s, t = source.select(key, F.col(version).alias("sv")), target.select(key, F.col(version).alias("tv"))
    state = F.when(F.col("tv").isNull(), "missing").when(F.col("sv").isNull(), "orphan").when(F.col("tv") < F.col("sv"), "stale").otherwise("ok")
    return s.join(t, key, "full").select(key, state.alias("state"))


def stuck(rows: DataFrame, key: str = "source", version: str = "doc_version", flag: str = "is_latest") -> DataFrame:
    """Keys that have rows but none that is latest, with the version to repair to."""
    return rows.groupBy(key).agg(F.bool_or(F.coalesce(flag, F.lit(False))).alias("any_"), F.max(version).alias("repair_to")).where("not any_").select(key, "repair_to")


def owners(rows: DataFrame, by_id: DataFrame, by_source: DataFrame) -> DataFrame:
    """Rows (doc_id, source) with their owner by id, else by source."""
    out = rows.join(by_id.select("doc_id", F.col("owner").alias("o1")), "doc_id", "left").join(by_source.select("source", F.col("owner").alias("o2")), "source", "left")
    return out.withColumn("owner", F.coalesce("o1", "o2")).drop("o1", "o2")


def rollup(chunks: DataFrame, doc: str = "source") -> DataFrame:
    """Chunk rows (doc, seq, content, doc_version, tokens) to one document row: newest version, up to three summaries and 32 chunk numbers in order, union of tokens.

    Ranks come first, and tasks keep what can be among the first three or 32 of a document, so no document's texts are gathered.
    """
    def first(rows: DataFrame, order: list[str], most: int) -> DataFrame:
        return rows.withColumn("r_", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).where(F.col("r_") <= most)

    listed = F.array_sort(F.collect_list(F.struct("r_", "x"))).alias("x")
    summaries = first(chunks.select(doc, "seq", "content"), ["seq", "content"], 3).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("r_", F.substring("content", 1, 500).alias("x")))).alias("x"))
    ids = first(chunks.select(doc, F.col("seq").alias("x")).where("x is not null").distinct(), ["x"], 32).groupBy(doc).agg(listed)
    out = chunks.groupBy(doc).agg(F.max("doc_version").alias("doc_version"), F.count(F.lit(1)).alias("chunks"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tokens")))).alias("tokens"))
    for name, part in (("summaries", summaries), ("chunk_ids", ids)):
        part = part.select(F.col(doc).alias("d_"), F.col("x.x").alias(name))
        out = out.join(part, out[doc].eqNullSafe(part["d_"]), "left").drop("d_")
    none = F.array()
    return out.select(doc, "doc_version", "chunks", F.coalesce("summaries", none).alias("summaries"), F.coalesce("chunk_ids", none).alias("chunk_ids"), "tokens")


def nearest_rank(values: Column, p: float) -> Column:
    """Percentile at position round((n - 1) p), halves to even, of a sorted array."""
    return F.element_at(values, (F.bround((F.size(values) - 1) * F.lit(p)) + 1).cast("int"))


def budget_prefix(rows: DataFrame, part: list[str], order: list[Column], size: Column, budget: int, least: int = 50) -> DataFrame:
    """Rows within a running budget of characters, in order; the row that overruns it is cut when over ``least`` remain."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("used", F.coalesce(F.sum(size).over(w), F.lit(0))).withColumn("take", F.least(size, F.lit(budget) - F.col("used")))
    return out.where((F.col("take") == size) | (F.col("take") > least))
