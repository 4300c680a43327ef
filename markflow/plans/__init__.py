"""Queries of the engine over the driver's tables, each with the same question in DuckDB SQL where SQL can say it."""

from . import graph_queries, hierarchy_queries, rule_queries, store_queries, stream_queries, taint_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "graph_queries", "hierarchy_queries", "rule_queries", "store_queries", "stream_queries", "taint_queries"]
