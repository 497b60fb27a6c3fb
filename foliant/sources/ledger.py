"""A table that is written in batches, each exactly once: a data source with a ledger.

A batch writes its files below ``data/batch=<id>/attempt=<id>``; only when all its tasks have ended does a commit put a line for it in
the ledger, and only files of attempts in the ledger are ever read.  So a run that is killed anywhere and repeated gives every row
once: batches in the ledger are left out, others are written anew under another attempt.  Rows carry a version, and a row
replaces a stored one only if its own is higher.

Tasks write through the file systems that Arrow knows (local and mounted folders, object stores), by URI.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from foliant.sources.scratch import settle

LEDGER = "batch string, attempt string, rows long"
#: A copy that holds this share of the source's rows needs no new one.
NEAR_COMPLETE = 0.99


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class LedgerWriter(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str):
        self.path, self.batch, self.attempt = path.rstrip("/"), batch, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, top = _store(self.path)
        folder = f"{top}/data/batch={self.batch}/attempt={self.attempt}"
        file, rows, writer = f"{folder}/{uuid.uuid4().hex}.parquet", 0, None
        for b in iterator:
            if writer is None:
                fs.create_dir(folder, recursive=True)
                writer = pq.ParquetWriter(file, b.schema, filesystem=fs)
            writer.write_batch(b)
            rows += b.num_rows
        if writer is not None:
            writer.close()
        return Written(file if rows or writer is not None else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, top = _store(self.path)
        fs.create_dir(f"{top}/ledger", recursive=True)
        line = {"batch": self.batch, "attempt": self.attempt, "rows": sum(m.rows for m in messages if m)}
        hidden = f"{top}/ledger/_{self.batch}-{self.attempt}"  # readers pass over names that begin so
        with fs.open_output_stream(hidden) as f:
            f.write(json.dumps(line).encode())
        fs.move(hidden, f"{top}/ledger/{self.batch}.json")

    def abort(self, messages: list[Written | None]) -> None:
        fs, top = _store(self.path)
        folder = f"{top}/data/batch={self.batch}/attempt={self.attempt}"
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            fs.delete_dir(folder)


class LedgerSource(DataSource):
    """``df.write.format("ledger").option("path", ...).option("batch", ...).mode("append")``"""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def writer(self, schema: StructType, overwrite: bool) -> LedgerWriter:
        if not re.fullmatch(r"[A-Za-z0-9.-]+", self.options.get("batch", "")):
            raise ValueError("option batch: letters, digits, dots and hyphens")
        return LedgerWriter(self.options["path"], self.options["batch"])


def _exists(path: str) -> bool:
    fs, top = _store(path)
    return fs.get_file_info(top).type == pafs.FileType.Directory


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: (batch, attempt, rows); empty where nothing has been committed."""
    at = f"{path.rstrip('/')}/ledger"
    return spark.read.schema(LEDGER).json(at) if _exists(at) else spark.createDataFrame([], LEDGER)


def read_ledger(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows of committed batches (with their ``batch``), earlier versions included."""
    at = f"{path.rstrip('/')}/data"
    empty = spark.createDataFrame([], StructType(list(schema.fields)).add("batch", "string"))
    if not _exists(at):
        return empty
    rows = spark.read.schema(StructType(list(schema.fields)).add("batch", "string").add("attempt", "string")).parquet(at)
    done = F.broadcast(committed(spark, path).select("batch", "attempt"))  # one row a batch
    return rows.join(done, ["batch", "attempt"], "left_semi").select(*empty.columns)


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of highest version of each key; of equal ones that of the batch that sorts last."""
    columns = [c for c in rows.columns if c not in (key, "batch")]
    best = F.max_by(F.struct(*columns), F.struct(version, "batch")).alias("r")
    return rows.groupBy(key).agg(best).select(key, *[F.col("r")[c].alias(c) for c in columns])


def write_batches(rows: DataFrame, path: str, job: str, key: str, version: str, batches: int = 16, pause: float = 0.0) -> dict[str, int]:
    """Write ``rows`` in ``batches`` parts by a hash of the key; counts of rows written and batches skipped.

    A batch of this ``job`` that the ledger holds is skipped.  A row is written if no stored row of its key has its version or a
    higher one; of rows that repeat a key the highest version is.  Rows with a null key or version are not written.  ``pause``
    seconds pass between batches.
    """
    spark = rows.sparkSession
    spark.dataSource.register(LedgerSource)
    done = {r["batch"] for r in committed(spark, path).where(F.col("batch").startswith(f"{job}-")).select("batch").collect()}  # at most ``batches`` rows
    part = F.pmod(F.xxhash64(key), F.lit(batches))
    sound = rows.where(F.col(key).isNotNull() & F.col(version).isNotNull())
    count = {"written": 0, "skipped": 0}
    for n in range(batches):
        batch = f"{job}-{n:05d}"
        if batch in done:
            count["skipped"] += 1
            continue
        own = sound.where(part == n)
        stored = read_ledger(spark, path, rows.schema).where(part == n).groupBy(F.col(key).alias("_key")).agg(F.max(version).alias("_stored"))
        new = latest(own.withColumn("batch", F.lit("")), key, version).select(*rows.columns)
        new = new.join(stored, new[key] == stored["_key"], "left").where(F.col("_stored").isNull() | (F.col(version) > F.col("_stored"))).select(*rows.columns)
        settled = settle(new, "ledger-batch")  # read before anything is written to where it comes from
        settled.write.format("ledger").option("path", path).option("batch", batch).mode("append").save()
        count["written"] += settled.count()
        time.sleep(pause)
    return count


def near_complete(source_rows: int, target_rows: int) -> bool:
    """Whether a copy may be left as it is: it holds 99 % of the source or more."""
    return source_rows == 0 or target_rows >= NEAR_COMPLETE * source_rows
