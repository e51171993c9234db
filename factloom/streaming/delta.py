"""Incremental queries: bindings that use at least one new fact, in batch and on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from factloom.plans.algebra import And, Constraint, Head, Or, Pattern, Var, find
from factloom.sources.facts import COLUMNS, FactSource, UnionSource


def pattern_changes(clauses: And | list[Pattern], full: FactSource, delta: FactSource, *others: Constraint) -> Or:
    """Semi-naive expansion: an arm for each clause, which reads ``delta`` there and ``full`` (new facts included)
    elsewhere. The arms' union is a set over all variables, so a binding with several new facts comes once."""
    parts = clauses.parts if isinstance(clauses, And) else clauses
    patterns = [p for p in parts if isinstance(p, Pattern)]
    rest = [p for p in parts if not isinstance(p, Pattern)] + list(others)
    if not patterns:
        raise ValueError("a change query needs a clause")
    arms = []
    for i in range(len(patterns)):
        # the clause on the delta comes first, so that joins start from the few new rows
        own = [Pattern(delta, patterns[i].e, patterns[i].a, patterns[i].v)]
        arms.append(And(*own, *(Pattern(full, p.e, p.a, p.v) for k, p in enumerate(patterns) if k != i), *rest))
    return Or(*arms)


def delta_source(full: FactSource, before: FactSource) -> FactSource:
    return FactSource(full.facts().join(before.facts().select("e", "a", "v"), ["e", "a", "v"], "left_anti"))


def stream(spark: SparkSession, incoming: DataFrame, path: str, query: Callable[[FactSource, FactSource], Constraint], head: Iterable[Var | Head | tuple], sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs a change query over a stream of facts.

    Each micro-batch's facts that ``path`` lacks are the delta; the query's new bindings go to ``sink`` and the facts are
    appended under the batch's number. A batch that is run again after a failure first takes its own folder out of the
    full set, so it finds the same delta and overwrites the same folder."""

    def batch(df: DataFrame, number: int) -> None:
        session = df.sparkSession
        try:
            held = session.read.option("basePath", path).parquet(path).where(f"batch <> {number}").select(*COLUMNS)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            held = session.createDataFrame([], df.select(*COLUMNS).schema)
        new = df.select(*COLUMNS).dropDuplicates(["e", "a", "v"]).join(held.select("e", "a", "v"), ["e", "a", "v"], "left_anti").select(*COLUMNS)
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")
        delta = session.read.parquet(f"{path}/batch={number}")
        sink(find(head, query(UnionSource(held, delta), FactSource(delta))), number)

    writer = incoming.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
