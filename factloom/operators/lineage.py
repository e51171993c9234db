"""Records of how members of a collection follow from each other, and encodings whose values are joined.

A record says that an output is the union of its inputs (merge), a function of one input (derive), or of each element of
one (map). Its id follows from kind, function and inputs, the inputs of a merge as a set, so whoever finds the same
equation writes the same record.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.shared import cut

KINDS = ("merge", "derive", "map")


def records(df: DataFrame, kind: str, output: Column, inputs: Column, function: str = "") -> DataFrame:
    """(record, kind, function, output, inputs) of rows; ``inputs`` is an array of members."""
    if kind not in KINDS:
        raise ValueError(f"a record is one of {KINDS}")
    members = F.array_sort(F.array_distinct(inputs)) if kind == "merge" else inputs
    parts = F.concat(F.lit(f"{kind}\x1f{function}\x1f"), F.array_join(F.transform("inputs", lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), ""))
    rows = df.select(output.alias("output"), members.alias("inputs")).where("output is not null and inputs is not null").distinct()
    return rows.select(F.sha2(parts, 256).alias("record"), F.lit(kind).alias("kind"), F.lit(function).alias("function"), "output", "inputs")


def conflicts(found: DataFrame) -> DataFrame:
    """(record, n): equations to which several outputs were written."""
    return found.groupBy("record").agg(F.count_distinct("output").alias("n")).where("n > 1")


def sources(found: DataFrame) -> DataFrame:
    """(output, source): the members that nothing makes from which each output follows, through any number of records."""
    step = cut(found.select("output", F.explode("inputs").alias("input")).distinct())
    made = cut(step.select("output").distinct())
    seen = new = step.select("output", F.col("input").alias("source"))
    while True:
        new = cut(new)
        if new.isEmpty():
            break
        more = new.join(step.select(F.col("output").alias("source"), F.col("input").alias("next")), "source").select("output", F.col("next").alias("source")).distinct()
        new = more.join(seen, ["output", "source"], "left_anti")
        seen = cut(seen.unionByName(more).distinct())
    return seen.join(made.withColumnRenamed("output", "source"), "source", "left_anti").select("output", "source").distinct()


def pending(found: DataFrame, function: str, members: DataFrame) -> DataFrame:
    """Members (one column) to which the function hasn't been applied."""
    done = found.where((F.col("kind") == "derive") & (F.col("function") == function)).select(F.col("inputs")[0].alias("member"))
    return members.toDF("member").distinct().join(done, "member", "left_anti")


@dataclass(frozen=True)
class Lattice:
    """An encoding whose values are joined: an aggregate that is commutative, associative and idempotent."""

    name: str
    join: Callable[[Column], Column]

    def joined(self, df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
        return df.groupBy(*by).agg(self.join(F.col(value)).alias(value))

    def preserves(self, df: DataFrame, by: Sequence[str], value: str, part: Column) -> DataFrame:
        """Groups whose join differs from the join of the joins of their parts; none if the aggregate is a join."""
        own = self.joined(df, by, value).withColumnRenamed(value, "whole")
        parts = self.joined(df.withColumn("__part", part), [*by, "__part"], value).drop("__part")
        again = self.joined(parts.unionByName(parts), by, value)
        return own.join(again, list(by)).where(~F.col("whole").eqNullSafe(F.col(value))).select(*by)


GREATEST = Lattice("greatest", F.max)
LEAST = Lattice("least", F.min)
UNION = Lattice("union", lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(c)))))
EITHER = Lattice("either", F.bool_or)
