"""The registry, and the supplied tables as facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.functions.codec import of_spark, encoding
from factloom.plans.algebra import vars_
from factloom.sources.facts import Attribute, TableSource

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "labels": "doc_id", "benchmark": "item_id", "documents": "doc_id", "embeddings": "vec_id"}
REFERENCES = {
    "nation": {"n_regionkey": "region"},
    "customer": {"c_nationkey": "nation"},
    "supplier": {"s_nationkey": "nation"},
    "orders": {"o_custkey": "customer"},
    "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
    "events": {"user_id": "user"},
}

s, o, o1, o2, o3, o4, o5 = vars_("s o o1 o2 o3 o4 o5")


def query(sql: str | None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its DuckDB SQL."""
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered")
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph(spark: SparkSession, sf_dir: str, *names: str) -> TableSource:
    """Facts of keyed tables, read by attribute."""
    return TableSource({n: (table(spark, sf_dir, n), KEYS[n], REFERENCES.get(n, {})) for n in names})


def lineitems(spark: SparkSession, sf_dir: str) -> TableSource:
    """Facts of lineitem, which has no key: an entity is its row's content."""
    return TableSource({"lineitem": (table(spark, sf_dir, "lineitem"), None, REFERENCES["lineitem"])})


def attr(column: str, kind: str) -> Attribute:
    """The attribute ``table.column`` by the encoding of its values."""
    return Attribute(column, encoding(kind), column)


__all__ = ["KEYS", "ORACLE_SQL", "QUERIES", "REFERENCES", "attr", "graph", "lineitems", "o", "o1", "o2", "o3", "o4", "o5", "of_spark", "query", "s", "table"]
