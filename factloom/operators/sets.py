"""Set algebra over facts, keyed rows, covers of commits and id sets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.sources.facts import COLUMNS

_KEY = ["e", "a", "v"]


def union(*facts: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), [f.select(*COLUMNS) for f in facts]).dropDuplicates(_KEY)


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*COLUMNS).join(right.select(*_KEY), _KEY, "left_semi").dropDuplicates(_KEY).select(*COLUMNS)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select(*COLUMNS).join(right.select(*_KEY), _KEY, "left_anti").dropDuplicates(_KEY).select(*COLUMNS)


def contains(facts: DataFrame, probes: DataFrame) -> DataFrame:
    """The probes (e, a, v) that are facts."""
    return probes.join(facts.select(*_KEY), _KEY, "left_semi")


def fingerprint(facts: DataFrame) -> DataFrame:
    """One row: number of facts, and a token that is equal for equal sets whatever their order (two 64-bit sums of
    hashes). Computed with partial aggregates, after making the facts distinct."""
    f = facts.select(*_KEY).distinct()
    # sums modulo 2^62, in decimal, can't overflow; an exclusive or joins them
    h = F.xxhash64(*_KEY)
    return f.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.coalesce(F.sum(F.pmod(h, F.lit(2**61 - 1)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s"))


def digests(facts: DataFrame, prefix: int = 2) -> DataFrame:
    """(prefix of the fact's hash, n, digest): equal sets have equal rows, so two stores compare these before facts.
    A longer prefix splits a differing part further."""
    h = F.sha2(F.concat_ws("\x1f", *_KEY), 256)
    rows = facts.select(*_KEY).distinct().select(F.substring(h, 1, prefix).alias("prefix"), F.xxhash64(*_KEY).alias("h"))
    return rows.groupBy("prefix").agg(F.count("*").alias("n"), F.bit_xor("h").alias("digest"))


def missing(mine: DataFrame, theirs: DataFrame, prefix: int = 2) -> DataFrame:
    """Facts of ``theirs`` that ``mine`` lacks. Only parts whose digests differ are compared fact by fact."""
    a, b = digests(mine, prefix), digests(theirs, prefix)
    differ = b.join(a, ["prefix", "n", "digest"], "left_anti").select("prefix")
    h = F.substring(F.sha2(F.concat_ws("\x1f", *_KEY), 256), 1, prefix)
    return difference(theirs.withColumn("prefix", h).join(differ, "prefix", "left_semi"), mine)


# Keyed rows: a map from key columns to a value, as a DataFrame.


def put(rows: DataFrame, changes: DataFrame, *key: str) -> DataFrame:
    """The rows with those of ``changes`` in place of, or added to, the ones of equal keys."""
    return rows.join(changes.select(*key), list(key), "left_anti").unionByName(changes)


def remove(rows: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    return rows.join(keys.select(*key), list(key), "left_anti")


def get(rows: DataFrame, keys: DataFrame, *key: str) -> DataFrame:
    return rows.join(keys.select(*key), list(key), "left_semi")


def prefix_scan(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    return rows.where(F.col(key).startswith(prefix))


def infixes(rows: DataFrame, key: str, prefix: str, length: int) -> DataFrame:
    """Distinct strings of ``length`` that follow the prefix in some key."""
    return prefix_scan(rows, key, prefix).select(F.substring(key, len(prefix) + 1, length).alias("infix")).distinct()


def count_range(rows: DataFrame, key: str, low: object, high: object) -> DataFrame:
    return rows.where(F.col(key).between(low, high)).agg(F.count("*").alias("count"))


def successor(rows: DataFrame, key: str, after: object) -> DataFrame:
    """One row: the least key greater than ``after``, null if there is none."""
    return rows.where(F.col(key) > after).agg(F.min(key).alias(key))


class ResetRequired(Exception):
    """The earlier cover holds members that the later one lacks, so its additions say nothing."""


@dataclass(frozen=True)
class Cover:
    """A set of members (commit ids) as a DataFrame of one column ``member``."""

    df: DataFrame

    def union(self, other: "Cover") -> "Cover":
        return Cover(self.df.unionByName(other.df).distinct())

    def intersection(self, other: "Cover") -> "Cover":
        return Cover(self.df.join(other.df, "member", "left_semi").distinct())

    def difference(self, other: "Cover") -> "Cover":
        return Cover(self.df.join(other.df, "member", "left_anti").distinct())

    def is_subset(self, other: "Cover") -> bool:
        return self.difference(other).df.isEmpty()

    def additions_since(self, earlier: "Cover") -> "Cover":
        if not earlier.is_subset(self):
            raise ResetRequired
        return self.difference(earlier)


def id_set(facts: DataFrame, attribute: str) -> DataFrame:
    """Distinct entity-valued values of one attribute, as a column ``id``."""
    return facts.where((F.col("a") == attribute) & ~F.col("v").startswith("=")).select(F.col("v").alias("id")).distinct()


def join_id_sets(*sets: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), sets).distinct()


