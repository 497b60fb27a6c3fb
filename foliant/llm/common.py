"""Helpers that the operators share: settled tables, input columns, hashing expressions."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII blanks of the word rule ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is absent in a local session, as in tests, a temporary folder is set; a cluster without it
    has no folder that all see, and is told so.
    """
    set_one = spark.conf.get("spark.checkpoint.dir", None)
    if set_one:
        return set_one.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application so that it can be removed afterwards."""
    return f"{shared_dir(spark)}/foliant/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"


#: Most bytes of one Arrow batch between Spark and Python: very long texts don't add up in a worker.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limit to ``BATCH_BYTES``; a lower limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    at_most = spark.conf.get(name, None)
    if not at_most or not at_most.rstrip("bB").isdigit() or not 0 < int(at_most.rstrip("bB")) <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over batches, giving freed memory back to the system at the end of each task: Python workers live on."""

    @functools.wraps(run)
    def to_end(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
                trim(0)

    return to_end


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, lost executors don't matter."""
    bound_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out where an input has fewer partitions than the cluster has cores; larger inputs stay as they are."""
    bound_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(seed: int, *cols: Column) -> Column:
    """A uniform number in [0, 1) that depends on the columns and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) / F.lit(float(1 << 53))


def utf8_length(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


#: Bits of an id filter: sixteen an id, up to a fixed 32 MB; a fuller filter only lets more rows through.
MOST_FILTER_BITS = 28


def may_hold(ids: DataFrame, id_col: str = "id") -> Callable[[Column], Column]:
    """A test "this id may be in ``ids``", without false negatives: a bitmap of hashes, built by an aggregate."""
    bits = min(MOST_FILTER_BITS, max(10, int(np.ceil(np.log2(16 * ids.count() + 1)))))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(F.col(id_col)), F.lit(64)).cast("int"))
    words = ids.groupBy(F.shiftright(place(F.col(id_col)), 6).alias("w")).agg(F.bit_or(one).alias("x")).toPandas()
    bitmap = np.zeros((1 << bits) // 64, np.int64)
    bitmap[words["w"].to_numpy(np.int64)] = words["x"].to_numpy(np.int64)
    shared = ids.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def held(at: pd.Series) -> pd.Series:
        x = at.to_numpy(np.int64)
        return pd.Series((shared.value[x >> 6] >> (x & 63)) & 1 == 1)

    return lambda c: held(place(c))


#: Keys of rows that share their id or have none begin here.
NEW_KEYS = 1 << 62


def with_keys(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` with a key that no two rows share, and that column's name: the id (as a long) of rows that alone have it, else a number from ``NEW_KEYS`` on.

    Rows whose id repeats or is null are numbered in a written table; all others stay where they are.
    """
    name = "_key"
    while name in docs.columns:
        name += "_"
    own = F.col(id_col).cast("long")
    ids = docs.select(own.alias("id"))
    again = settle(ids.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if again.isEmpty() and ids.where("id is null").isEmpty():
        return docs.withColumn(name, own), name
    odd = own.isNull() | may_hold(again)(own)  # a false alarm only gets another key
    numbered_ = settle(docs.where(odd).withColumn(name, F.lit(NEW_KEYS) + F.monotonically_increasing_id()), "numbered-rows")
    return docs.where(~odd).withColumn(name, own).unionByName(numbered_), name


def drop_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the ids in ``gone`` (one column): rows that the id filter clears never move, the rest meet in an anti join."""
    gone = settle(gone.toDF("_gone").where("_gone is not null").distinct(), "gone-ids")
    maybe = F.coalesce(may_hold(gone, "_gone")(F.col(id_col)), F.lit(True))
    return docs.where(~maybe).unionByName(docs.where(maybe).join(gone, docs[id_col] == F.col("_gone"), "left_anti"))


#: Rows of a table of spans up to which it is broadcast: about 5 MB.
BROADCAST_SPANS = 100_000


def ranked_spans(rows: DataFrame, order: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """Sort ``rows`` by their column ``part`` and ``order``, nulls first: the sorted table and its spans.

    ``order`` must tell all rows apart.  Rows are dealt out by ranges of all these columns, so a part may hold any share
    of them.  A span (run, part, first, held, start) is what one task holds of one part: its first position ``at``, its
    rows, and the rows of the part before it.  ``numbered`` turns both into ranks.
    """
    keys = ["part", *order]
    placed = settle(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), label)
    spans = placed.groupBy(F.shiftright("at", 33).alias("run"), "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy("part").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    return placed, settle(spans.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0))), f"{label}-spans")


def numbered(placed: DataFrame, spans: DataFrame, *more: str) -> DataFrame:
    """The sorted table with each row's ``rank`` in its part, from 0, and the columns ``more`` of its span."""
    side = spans.select(F.col("run").alias("run_"), F.col("part").alias("part_"), (F.col("start") - F.col("first")).alias("shift_"), *more)
    side = F.broadcast(side) if spans.count() <= BROADCAST_SPANS else side
    joined = placed.join(side, (F.shiftright("at", 33) == side["run_"]) & placed["part"].eqNullSafe(side["part_"]))
    return joined.withColumn("rank", F.col("at") + F.col("shift_")).drop("at", "run_", "part_", "shift_")
