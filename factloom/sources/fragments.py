"""Fragments: facts with what describes them, the blobs that they refer to, and the ids that they are handed on by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from factloom.operators import sets
from factloom.sources import blobs as b


@dataclass(frozen=True)
class Fragment:
    """facts and meta are fact tables, blobs has handle, bytes and at, exports has one column ``id``."""

    facts: DataFrame
    meta: DataFrame
    blobs: DataFrame
    exports: DataFrame

    def __add__(self, other: "Fragment") -> "Fragment":
        """Part by part the union of sets: in any order, and again, the same."""
        return Fragment(sets.union(self.facts, other.facts), sets.union(self.meta, other.meta), b.union(self.blobs, other.blobs), sets.join_id_sets(self.exports, other.exports))

    def root(self) -> str | None:
        """The one export, None if there are several or none."""
        rows = self.exports.distinct().limit(2).collect()
        return rows[0]["id"] if len(rows) == 1 else None

    def describe(self, meta: DataFrame) -> "Fragment":
        """The fragment with more facts about its attributes."""
        return Fragment(self.facts, sets.union(self.meta, meta), self.blobs, self.exports)

    def exported(self) -> DataFrame:
        """The facts of the exports themselves."""
        return self.facts.join(self.exports.withColumnRenamed("id", "e"), "e", "left_semi").select(*self.facts.columns)
