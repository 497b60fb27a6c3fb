"""Registry of the engine's queries and of the SQL that gives the same rows.

A query is a function ``(spark, sf_dir) -> DataFrame`` registered with ``@query(sql)``; ``sql`` is the same result in
portable SQL over views of the tables, or None where SQL has no form for it (then tests hold it against plain Python).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["search_clean_chunk_bm25"](spark, sf_dir)


from . import access, analytics, context, corpus, governance, pipelines, ranking, recalls, results, retrieval, streams, text  # noqa: E402, F401  registration
