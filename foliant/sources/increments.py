"""Rows of a growing table as a stream, by a column that rises with every change.

The offset of a stream is the highest value seen, kept in the stream's checkpoint.  A run reads from that value on, including it:
rows that were added later with the very same value would be lost otherwise.  What was read before at that value is dropped by key;
state holds the keys of the last values only, as the stream's watermark passes the others.  Files whose statistics end
below the offset are not opened.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from foliant.sources.ledger import _store

BEFORE_ALL = -(1 << 62)
_EPOCH = datetime.datetime(1970, 1, 1)


def _micros(value: object) -> int:
    if not isinstance(value, datetime.datetime):
        return BEFORE_ALL if value is None else int(value)  # type: ignore[call-overload]
    plain = value.astimezone(datetime.UTC).replace(tzinfo=None) if value.tzinfo else value
    return (plain - _EPOCH) // datetime.timedelta(microseconds=1)


class Span(InputPartition):
    def __init__(self, file: str, low: int, high: int):
        self.file, self.low, self.high = file, low, high


class IncrementReader(DataSourceStreamReader):
    def __init__(self, path: str, column: str, schema: StructType):
        self.path, self.column, self.names, self.schema = path, column, schema.names, to_arrow_schema(schema, timestamp_utc=True)

    def _files(self) -> list[tuple[str, int, int]]:
        """(file, lowest, highest value) from the statistics that files carry; without them the column is read."""
        fs, top = _store(self.path)
        out = []
        for file in pads.dataset(top, filesystem=fs, format="parquet").files:
            with pq.ParquetFile(file, filesystem=fs) as f:
                at = next(i for i in range(f.metadata.num_columns) if f.metadata.schema.column(i).path == self.column)
                stats = [f.metadata.row_group(g).column(at) for g in range(f.num_row_groups)]
                if all(c.physical_type != "INT96" and c.is_stats_set and c.statistics.has_min_max for c in stats):  # the old form of timestamps has none that can be read
                    ends = [(c.statistics.min, c.statistics.max) for c in stats]
                else:
                    found = pc.min_max(f.read(columns=[self.column])[self.column]).as_py()
                    ends = [(found["min"], found["max"])]
            ends = [(_micros(low), _micros(high)) for low, high in ends if low is not None]
            if ends:
                out.append((file, min(low for low, _ in ends), max(high for _, high in ends)))
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": BEFORE_ALL}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"at": max((high for _, _, high in self._files()), default=BEFORE_ALL)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return [Span(f, start["at"], end["at"]) for f, low, high in self._files() if high >= start["at"] and low <= end["at"]]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(self.path)
        for b in pads.dataset(partition.file, filesystem=fs, format="parquet").to_batches(columns=self.names):
            at = b.column(self.names.index(self.column))
            at = pc.cast(pc.cast(at, pa.timestamp("us")), pa.int64()) if pa.types.is_timestamp(at.type) else pc.cast(at, pa.int64())
            kept = b.filter(pc.fill_null(pc.and_(pc.greater_equal(at, partition.low), pc.less_equal(at, partition.high)), False))
            yield pa.RecordBatch.from_arrays([pc.cast(kept.column(n), self.schema.field(n).type, safe=False) for n in self.names], schema=self.schema)

    def commit(self, end: dict) -> None:
        pass


class IncrementSource(DataSource):
    """``spark.readStream.format("increments").schema(...).option("path", ...).option("column", ...)``"""

    @classmethod
    def name(cls) -> str:
        return "increments"

    def streamReader(self, schema: StructType) -> IncrementReader:  # noqa: N802
        return IncrementReader(self.options["path"].rstrip("/"), self.options["column"], schema)


def new_rows(spark: SparkSession, path: str, schema: StructType, key: str, at: str, late: str = "1 second") -> DataFrame:
    """A stream of the rows of a Parquet folder, each key once for each run of values; ``at`` is a timestamp that rises with changes.

    Rows with a null ``at`` are never read.  Rows added more than ``late`` behind the highest value seen are taken for old ones.
    """
    spark.dataSource.register(IncrementSource)
    rows = spark.readStream.format("increments").schema(schema).option("path", path).option("column", at).load()
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key, at])


def overdue(rows: DataFrame, status: str, since: str, now: F.Column, minutes: int = 30) -> DataFrame:
    """Rows with their next status: dispatched ones that were not answered in time are open again, all others stay."""
    late = (F.col(status) == "DISPATCHED") & (F.col(since) < now - F.make_interval(mins=F.lit(minutes)))
    return rows.withColumn(status, F.when(late, "PENDING").otherwise(F.col(status)))
