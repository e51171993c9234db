"""Spans of work as facts, and a clock that a run decides itself."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.facts import Attribute, entities

NAME, PARENT = Attribute.named("span.name", "text"), Attribute.named("span.parent", "id")
BEGIN, END, TOOK = Attribute.named("span.begin", "int"), Attribute.named("span.end", "int"), Attribute.named("span.took", "int")
SPANS = "span string, parent string, name string, begin bigint, end bigint"


@dataclass
class VirtualClock:
    """A clock that moves only when it is told to, or by ``tick`` at each reading: reruns agree."""

    now: int = 0
    tick: int = 0

    def read(self) -> int:
        self.now += self.tick
        return self.now

    def advance(self, by: int) -> int:
        if by < 0:
            raise ValueError("a clock doesn't go back")
        self.now += by
        return self.now


def virtual_times(number: Column, start: int, tick: int) -> Column:
    """The readings of a virtual clock, by number, for rows."""
    return F.lit(start) + number.cast("bigint") * tick


@dataclass
class Telemetry:
    """Spans of a driver's work, which may be inside each other."""

    clock: VirtualClock
    done: list[tuple] = field(default_factory=list)
    open: list[str] = field(default_factory=list)

    @contextmanager
    def span(self, name: str) -> Iterator[str]:
        began, parent = self.clock.read(), self.open[-1] if self.open else None
        own = f"span/{began}-{len(self.done)}-{len(self.open)}"
        self.open.append(own)
        try:
            yield own
        finally:
            self.open.pop()
            self.done.append((own, parent, name, began, self.clock.read()))

    def facts(self, spark: SparkSession) -> DataFrame:
        return span_facts(spark.createDataFrame(self.done, SPANS))


def span_facts(spans: DataFrame) -> DataFrame:
    """Facts of spans (span, parent, name, begin, end): name, parent, times and how long they took."""
    return entities(spans, F.col("span"), {NAME: F.col("name"), PARENT: F.col("parent"), BEGIN: F.col("begin"), END: F.col("end"), TOOK: F.col("end") - F.col("begin")})
