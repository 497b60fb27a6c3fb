import os

import pytest
from pyspark.sql import functions as F

from foliant.sources import ledger as L

SCHEMA = "id long, v int, text string"


def stored(spark, path, df):
    return sorted((r.id, r.v, r.text) for r in L.latest(L.read_ledger(spark, path, df.schema), "id", "v").collect())


def test_a_killed_run_repeated_gives_each_row_once(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([(i, 1, f"t{i}") for i in range(200)], SCHEMA)
    real, calls = L.settle, []

    def dies(frame, label):
        calls.append(label)
        if len(calls) == 4:
            raise KeyboardInterrupt
        return real(frame, label)

    monkeypatch.setattr(L, "settle", dies)
    with pytest.raises(KeyboardInterrupt):
        L.write_batches(df, path, "job1", "id", "v", 8)
    assert L.committed(spark, path).count() == 3
    monkeypatch.setattr(L, "settle", real)
    assert L.write_batches(df, path, "job1", "id", "v", 8)["skipped"] == 3
    assert L.read_ledger(spark, path, df.schema).count() == 200 and stored(spark, path, df) == [(i, 1, f"t{i}") for i in range(200)]
    assert L.write_batches(df, path, "job1", "id", "v", 8) == {"written": 0, "skipped": 8}


def test_a_failed_batch_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.dataSource.register(L.LedgerSource)
    df = spark.range(100).repartition(4)
    write = lambda frame, batch: frame.write.format("ledger").option("path", path).option("batch", batch).mode("append").save()
    write(df, "a-1")
    bad = df.select((F.col("id") / F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(1)).alias("id"))
    with pytest.raises(Exception, match="lost"):
        write(bad, "a-2")
    with pytest.raises(Exception, match="batch"):
        write(df, "../x")
    os.makedirs(f"{path}/data/batch=a-3/attempt=zz")  # an attempt that never came to its commit
    df.coalesce(1).write.parquet(f"{path}/data/batch=a-3/attempt=zz/x.parquet")
    assert [(r.batch, r.rows) for r in L.committed(spark, path).collect()] == [("a-1", 100)]
    assert L.read_ledger(spark, path, df.schema).count() == 100


def test_versions_decide(spark, tmp_path):
    path = f"{tmp_path}/t"
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    first = make([(1, 1, "a"), (2, 5, "b"), (3, 2, "low"), (3, 3, "high"), (None, 1, "x"), (4, None, "y")])
    assert L.write_batches(first, path, "j1", "id", "v", 3)["written"] == 3
    second = make([(1, 2, "newer"), (2, 5, "same version"), (3, 1, "older"), (5, 1, "new")])
    assert L.write_batches(second, path, "j2", "id", "v", 3)["written"] == 2
    assert stored(spark, path, first) == [(1, 2, "newer"), (2, 5, "b"), (3, 3, "high"), (5, 1, "new")]
    assert L.write_batches(first.limit(0), f"{tmp_path}/e", "j", "id", "v", 2) == {"written": 0, "skipped": 0} and L.read_ledger(spark, f"{tmp_path}/e", first.schema).count() == 0
    assert L.read_ledger(spark, f"{tmp_path}/none", first.schema).collect() == [] and L.near_complete(1000, 990) and not L.near_complete(1000, 989)
