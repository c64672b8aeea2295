"""All queries over the driver's tables, with DuckDB SQL written by another formula."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigmafold.plans import change_queries, graph_queries, law_queries, wire_queries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _module in (law_queries, change_queries, wire_queries, graph_queries):
    for _name, (_query, _sql) in _module.FOUND.items():
        QUERIES[_name] = _query
        if _sql is not None:
            ORACLES[_name] = _sql
