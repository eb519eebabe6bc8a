"""The registered queries: name to callable, and name to equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import assistant_queries, corpus_queries, dataset_queries, record_queries, rule_queries, scalar_queries, search_queries, stream_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (scalar_queries, search_queries, corpus_queries, dataset_queries, stream_queries, assistant_queries, rule_queries, record_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hybrid_retrieve"](spark, sf_dir)
