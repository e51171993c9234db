"""Registered queries: the operators and the benchmark's query shapes over the supplied tables, each with its SQL."""

from factloom.queries.registry import ORACLE_SQL, QUERIES
from factloom.queries import benchmark, fold_queries, import_queries, more_queries, pattern_queries, search_queries, state_queries, store_queries  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]
