"""A training-corpus pipeline over ``documents``.

Toxic documents go, one document of every group of near copies stays, documents that hold benchmark passages go, sources
are mixed to their target weights, and the mix is dealt out to shards.  Each stage is one operator of ``foliant.llm``
applied to everything that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.common import settle
from foliant.llm.decontamination import drop_contaminated
from foliant.llm.jaccard import drop_near_copies
from foliant.llm.mixing import mix_documents
from foliant.llm.sharding import assign_shards, write_shards
from foliant.llm.toxicity import drop_toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; the model is fitted on ``labels`` and the documents at hand."""
    return drop_toxic(docs, _table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    return drop_near_copies(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a ``benchmark`` item."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return assign_shards(docs)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Training, the fitted budget and the sampled splitters have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again: the shard and slot of every row of the mix."""
    return STAGES[-1][1](spark, _mixed(spark, sf_dir), sf_dir)


def write_corpus(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """``run``, and the mixed documents themselves written below ``path``, one folder a shard; returns the placements."""
    return write_shards(_mixed(spark, sf_dir), path)
