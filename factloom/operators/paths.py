"""Closure of regular paths: the pairs of vertices between which some path spells a word of the expression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.shared import cut
from factloom.plans.paths import Automaton, PathExpr, parse
from factloom.sources.facts import FactSource


def edges_of(source: FactSource, automaton: Automaton) -> DataFrame:
    """(src, label, dst) of the facts that some step can use; every fact is an edge from its entity to its value."""
    labels = {s.label for _, _, s in automaton.moves}
    if None in labels:
        facts = source.facts()
    else:
        facts = reduce(lambda x, y: x.unionByName(y), [source.scan(x) for x in sorted(labels)])
    return facts.select(F.col("e").alias("src"), F.col("a").alias("label"), F.col("v").alias("dst"))


def arcs(edges: DataFrame, automaton: Automaton) -> DataFrame:
    """The summary of a set of edges: distinct (src, p, dst, q), an edge taken from state p to q. Summaries of parts of
    the edges, united, are the summary of all of them."""
    parts = []
    for p, q, s in automaton.moves:
        df = edges
        if s.label is not None:
            df = df.where(F.col("label") == s.label)
        elif s.excluded:
            df = df.where(~F.col("label").isin(*s.excluded))
        src, dst = ("dst", "src") if s.reverse else ("src", "dst")
        parts.append(df.select(F.col(src).alias("src"), F.lit(p).alias("p"), F.col(dst).alias("dst"), F.lit(q).alias("q")))
    return reduce(lambda x, y: x.unionByName(y), parts).distinct()


def merge_summaries(*summaries: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), summaries).distinct()


def close(summary: DataFrame, automaton: Automaton, vertices: DataFrame | None = None, sources: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """Distinct (src, dst) that the automaton accepts over a summary.

    Lengths double: the pairs of at most n arcs, extended by those of just n, are those of at most 2n, so the rounds are
    the logarithm of the longest shortest path; it ends when a round finds nothing new. With ``sources`` (one column
    ``src``) only paths from these vertices are followed, and with ``rounds``, which bounds the length of a path, arc by
    arc: each round extends the pairs that the last one found by an arc. A nullable automaton adds (v, v) for each of
    ``vertices`` (one column), which must then be given."""
    step = cut(summary)
    if sources is None and rounds is None:
        return _accepted(_doubled(step), automaton, vertices, None)
    start = step.where("p = 0").select("src", F.col("dst").alias("at"), "q")
    if sources is not None:
        start = start.join(sources.toDF("src").distinct(), "src", "left_semi")
    seen = new = cut(start.distinct())
    done = 1
    by_state = step.select(F.col("src").alias("at"), F.col("p").alias("q"), F.col("dst").alias("next"), F.col("q").alias("next_q"))
    while not new.isEmpty() and (rounds is None or done < rounds):
        reached = new.join(by_state, ["at", "q"]).select("src", F.col("next").alias("at"), F.col("next_q").alias("q")).distinct()
        new = cut(reached.join(seen, ["src", "at", "q"], "left_anti"))
        # each round's new rows stay in their own files; now and then they are written as one
        seen = seen.unionByName(new)
        done += 1
        if done % 8 == 0:
            seen = cut(seen)
    return _accepted(seen, automaton, vertices, sources)


def _doubled(step: DataFrame) -> DataFrame:
    """(src, at, q): what paths from the start state reach, by doubling their lengths."""
    seen = step.where("p = 0").select("src", F.col("dst").alias("at"), "q").distinct()
    jump = step.select(F.col("src").alias("at"), F.col("p").alias("q"), F.col("dst").alias("next"), F.col("q").alias("next_q"))
    jump = jump.join(step.select(F.col("q").alias("q")).distinct(), "q", "left_semi").select("at", "q", "next", "next_q")  # a state that no arc leads to is never extended
    known = rows = -1
    while True:
        seen = cut(seen, max(rows, 0))
        now = seen.count()
        if now == known or jump.isEmpty():
            return seen
        known, rows = now, 4 * now
        more = seen.join(jump, ["at", "q"]).select("src", F.col("next").alias("at"), F.col("next_q").alias("q"))
        seen = seen.unionByName(more).distinct()
        then = jump.select(F.col("at").alias("next"), F.col("q").alias("next_q"), F.col("next").alias("far"), F.col("next_q").alias("far_q"))
        jump = cut(jump.join(then, ["next", "next_q"]).select("at", "q", F.col("far").alias("next"), F.col("far_q").alias("next_q")).distinct(), rows)


def _accepted(seen: DataFrame, automaton: Automaton, vertices: DataFrame | None, sources: DataFrame | None) -> DataFrame:
    out = seen.where(F.col("q").isin(*automaton.accepting)).select("src", F.col("at").alias("dst"))
    if automaton.nullable:
        if vertices is None:
            raise ValueError("an expression that matches the empty path needs the vertices")
        own = vertices.toDF("src").distinct()
        if sources is not None:
            own = own.join(sources.toDF("src").distinct(), "src", "left_semi")
        out = out.unionByName(own.select("src", F.col("src").alias("dst")))
    elif len(automaton.accepting) == 1:
        return out  # rows of one state are distinct as they are
    return out.distinct()


SUMMARY = "src string, p int, dst string, q int"


@dataclass(frozen=True)
class PathCollection:
    """Stored summaries of one expression: a folder with the automaton's moves and a folder of arcs for each part.

    Parts are joined by union, so they may be added in any order, again, and by several writers; the folder of a part is
    named by its content. ``audit`` finds parts that no such automaton could have written."""

    spark: SparkSession
    path: str

    @staticmethod
    def create(spark: SparkSession, path: str, expression: str) -> "PathCollection":
        spark.createDataFrame([(expression, parse(expression).compile().states)], "expression string, states int").write.mode("errorifexists").parquet(f"{path}/automaton")
        return PathCollection(spark, path)

    def automaton(self) -> Automaton:
        return parse(self.spark.read.parquet(f"{self.path}/automaton").first()["expression"]).compile()

    def add(self, edges: DataFrame) -> str:
        """Stores the arcs of some edges (src, label, dst); equal parts are one."""
        part = arcs(edges, self.automaton())
        h = F.sha2(F.concat_ws("\x1f", "src", "p", "dst", "q"), 256)
        parts = part.groupBy(F.substring(h, 1, 4).alias("k")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(h)), ""), 256).alias("d"))
        name = parts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("k", "d"))), ""), 256)).first()[0][:32]
        part.write.mode("overwrite").parquet(f"{self.path}/arcs/part={name}")
        return name

    def summary(self) -> DataFrame:
        return self.spark.read.schema(SUMMARY + ", part string").parquet(f"{self.path}/arcs").select("src", "p", "dst", "q").distinct()

    def audit(self) -> DataFrame:
        """(part, n): arcs of states between which the automaton has no move, or with null ends."""
        allowed = self.spark.createDataFrame([(p, q) for p, q, _ in self.automaton().moves], "p int, q int").distinct()
        rows = self.spark.read.schema(SUMMARY + ", part string").parquet(f"{self.path}/arcs")
        bad = rows.join(F.broadcast(allowed), ["p", "q"], "left_anti").unionByName(rows.where("src is null or dst is null"), allowMissingColumns=True)
        return bad.groupBy("part").agg(F.count("*").alias("n"))

    def close(self) -> "PathIndex":
        return PathIndex(cut(close(self.summary(), self.automaton())))


@dataclass
class PathIndex:
    """A closed path relation with its views; ``pairs`` has the distinct (src, dst)."""

    pairs: DataFrame

    @staticmethod
    def build(source: FactSource, path: PathExpr | str, sources: DataFrame | None = None) -> "PathIndex":
        automaton = (parse(path) if isinstance(path, str) else path).compile()
        edges = edges_of(source, automaton)
        vertices = None
        if automaton.nullable:
            facts = source.facts()
            vertices = facts.select("e").unionByName(facts.select(F.col("v").alias("e")))
        return PathIndex(cut(close(arcs(edges, automaton), automaton, vertices, sources)))

    def write(self, path: str) -> None:
        """Stores the pairs as Parquet, sorted by start, so that ``reachable_from`` reads row groups."""
        self.pairs.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").write.mode("errorifexists").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> "PathIndex":
        return PathIndex(spark.read.schema("src string, dst string").parquet(path))

    def contains(self, src: str, dst: str) -> bool:
        return not self.pairs.where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def reachable_from(self, *src: str) -> DataFrame:
        return self.pairs.where(F.col("src").isin(*src)).select("dst").distinct()

    def reaching(self, *dst: str) -> DataFrame:
        return self.pairs.where(F.col("dst").isin(*dst)).select("src").distinct()

    def starts(self) -> DataFrame:
        return self.pairs.select("src").distinct()

    def ends(self) -> DataFrame:
        return self.pairs.select("dst").distinct()

    def diagonal(self) -> DataFrame:
        return self.pairs.where("src = dst").select("src")

    def constraint(self, start, end):
        """The relation (start, end) for a query."""
        from factloom.plans.algebra import Relation

        if start == end:
            return Relation(self.diagonal(), [start])
        return Relation(self.pairs, [start, end])
