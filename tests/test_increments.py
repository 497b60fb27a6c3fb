import datetime

from pyspark.sql import functions as F

from foliant.plans import streams
from foliant.sources import increments as N

SCHEMA = "id long, at timestamp, text string"


def t(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_rows_added_between_runs_come_once(spark, tmp_path):
    """Rows with the very value at which an earlier run ended, with smaller and larger keys, are not lost and not read twice."""
    path, run = f"{tmp_path}/t", f"{tmp_path}/run"

    def add(rows, parts=1):
        spark.createDataFrame(rows, SCHEMA).coalesce(parts).write.mode("append").parquet(path)

    def go():
        schema = spark.createDataFrame([], SCHEMA).schema
        out = streams._drained(spark, N.new_rows(spark, path, schema, "id", "at"), "append", run)
        return sorted(r.id for r in out.collect())

    add([(i, t(i // 10), f"r{i}") for i in range(10, 50)])
    assert go() == list(range(10, 50))
    assert go() == list(range(10, 50))  # nothing new
    add([(3, t(4), "tie, smaller key"), (99, t(4), "tie, larger key"), (100, t(5), "later"), (101, None, "never")])
    assert go() == [3, *range(10, 50), 99, 100]
    add([(200 + i, t(5 + i), "more") for i in range(300)])
    add([(999, t(304), "tie again")])
    assert go() == [3, *range(10, 50), 99, 100, *range(200, 500), 999]


def test_files_below_the_offset_are_not_opened(spark, tmp_path):
    path = f"{tmp_path}/t"
    for k in range(4):
        spark.createDataFrame([(k, t(k), "x")], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    reader = N.IncrementReader(path, "at", spark.createDataFrame([], SCHEMA).schema)
    end = reader.latestOffset()
    assert end == {"at": N._micros(t(3))} and len(reader.partitions(reader.initialOffset(), end)) == 4
    assert len(reader.partitions({"at": N._micros(t(2))}, end)) == 2


def test_overdue_dispatches_open_again(spark):
    rows = spark.createDataFrame([(1, "DISPATCHED", t(0)), (2, "DISPATCHED", t(3000)), (3, "DONE", t(0)), (4, None, t(0)), (5, "DISPATCHED", None)], "id int, status string, at timestamp")
    got = {r.id: r.status for r in N.overdue(rows, "status", "at", F.lit(t(3600)), 30).collect()}
    assert got == {1: "PENDING", 2: "DISPATCHED", 3: "DONE", 4: None, 5: "DISPATCHED"}
