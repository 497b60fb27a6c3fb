"""Written tables in the folder that driver and executors share: lineage ends there, and lost executors don't matter."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session without it, as in tests, gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = f"{shared_dir(df.sparkSession)}/foliant/{df.sparkSession.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
