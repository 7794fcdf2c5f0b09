"""The library's registered queries and their SQL. Names begin with the id of the operator in the coverage list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passagemill.plans import search_queries, store_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
for _module in (search_queries, text_queries, store_queries):
    for _name, (_query, _sql) in _module.ALL.items():
        QUERIES[_name] = _query
        if _sql:
            SQL[_name] = _sql


def entry(spark: SparkSession) -> DataFrame:
    """Hybrid search over the smallest tables."""
    return QUERIES["p4_hybrid_search"](spark, "/root/testdata/sf0.001")
