"""Folds over bindings: outer and anti joins, existence, grouping, top-k and statistics.

The query algebra has neither negation nor aggregation; these take and give ordinary DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.facts import FactSource


def _shared(left: DataFrame, right: DataFrame) -> list[str]:
    on = [c for c in left.columns if c in right.columns]
    if not on:
        raise ValueError("the sides share no variable")
    return on


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left row with each matching right row, or alone with nulls: a left outer join on the shared variables."""
    return left.join(right, _shared(left, right), "left")


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows without a match on the shared variables; if none is shared nothing is removed, as in SPARQL."""
    on = [c for c in left.columns if c in right.columns]
    return left.join(right.select(*on), on, "left_anti") if on else left


def having(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows with a match on the shared variables, each once (EXISTS as a set of witnesses)."""
    on = _shared(left, right)
    return left.join(right.select(*on), on, "left_semi")


def bag_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distinct(df: DataFrame, *names: str) -> DataFrame:
    return (df.select(*names) if names else df).distinct()


def count_all(df: DataFrame, name: str = "count") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def count_distinct(df: DataFrame, *names: str, approximate: bool = False, name: str = "count") -> DataFrame:
    """Number of distinct values or tuples. Counted by grouping first, so that no task holds them all."""
    if approximate:
        return df.agg(F.approx_count_distinct(F.struct(*names)).alias(name))
    return df.select(*names).distinct().agg(F.count("*").alias(name))


def group(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in aggregates.items()])


def top_counts(df: DataFrame, key: str, k: int = 10, name: str = "count") -> DataFrame:
    """The k most frequent values, ties by value."""
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), key).limit(k)


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark keeps k rows a group in each task before the shuffle (window group limit)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", place).where(F.col("rank") <= k)


def take(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """n rows, the first in an order if one is given."""
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def max_by_key(df: DataFrame, by: Sequence[str], row: str, *order: str) -> DataFrame:
    """The ``row`` of the greatest order key in each group, ties to the greater row."""
    key = F.struct(*order, row)
    return df.groupBy(*by).agg(F.max_by(F.col(row), key).alias(row)) if by else df.agg(F.max_by(F.col(row), key).alias(row))


def group_concat(df: DataFrame, by: Sequence[str], text: str, separator: str = " ", name: str = "text") -> DataFrame:
    """The texts of each group joined by the separator, in code point order."""
    return df.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(text)), separator).alias(name))


def axis_counts(source: FactSource) -> DataFrame:
    """Numbers of facts, entities, attributes and values. One pass; the three axes are made distinct as one column."""
    facts = source.facts()
    axis = facts.select(F.explode(F.array(F.struct(F.lit("e").alias("x"), F.col("e").alias("k")), F.struct(F.lit("a").alias("x"), F.col("a").alias("k")), F.struct(F.lit("v").alias("x"), F.col("v").alias("k")))).alias("s")).select("s.*")
    seen = axis.groupBy("x", "k").agg(F.count("*").alias("n"))
    return seen.agg(F.sum(F.when(F.col("x") == "e", F.col("n"))).alias("facts"), F.count_if(F.col("x") == "e").alias("entities"), F.count_if(F.col("x") == "a").alias("attributes"), F.count_if(F.col("x") == "v").alias("values"))


def literals(source: FactSource) -> DataFrame:
    """Facts whose value is a literal."""
    return source.facts().where(F.col("v").startswith("="))


def domain(source: FactSource, *axes: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """Distinct keys on the axes (``e``, ``a``, ``v``), within [low, high] by code point."""
    facts = source.facts()
    out = None
    for x in axes:
        part = facts.select(F.col(x).alias("k"))
        out = part if out is None else out.unionByName(part)
    if low is not None:
        out = out.where(F.col("k") >= low)
    if high is not None:
        out = out.where(F.col("k") <= high)
    return out.distinct()


def distinct_pairs(source: FactSource, first: str, second: str, where: Column | None = None) -> DataFrame:
    """Number of distinct pairs of two axes."""
    facts = source.facts() if where is None else source.facts().where(where)
    return count_distinct(facts, first, second)


def describe(df: DataFrame, aggregates: Mapping[str, Column]) -> DataFrame:
    return df.agg(*[c.alias(n) for n, c in aggregates.items()])
