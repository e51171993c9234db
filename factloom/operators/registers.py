"""Version registers: which states of a register nothing dominates.

Domination ranges over all states of the facts, not only the candidates; a state without coordinates is never
dominated; states of equal order all survive unless ties are broken by id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.facts import FactSource


class Order:
    """An order on states; ``dominated`` gives the distinct states (column ``state``) that others dominate."""

    def dominated(self) -> DataFrame | None:
        raise NotImplementedError


class Unordered(Order):
    def dominated(self) -> None:
        return None


@dataclass
class ObservationOrder(Order):
    """A state is dominated once another observes it; with ``first``, once it observes another."""

    source: FactSource
    attribute: str
    first: bool = False

    def dominated(self) -> DataFrame:
        return self.source.scan(self.attribute).select(F.col("e" if self.first else "v").alias("state")).distinct()


@dataclass
class StatedOrder(Order):
    """States of one identity are ordered by a value: the greatest survive, or with ``first`` the least. A state may
    state several identities or orders; it is dominated if it is in any pair of them."""

    source: FactSource
    identity: str
    order: str
    first: bool = False
    tiebreak_by_id: bool = False
    by: str = "v"

    def coordinates(self) -> DataFrame:
        """(state, register, at): the states that have both an identity and an order."""
        names = self.source.scan(self.identity).select(F.col("e").alias("state"), F.col("v").alias("register"))
        return names.join(self.source.scan(self.order).select(F.col("e").alias("state"), F.col(self.by).alias("at")), "state")

    def dominated(self) -> DataFrame:
        # The winner of each register by partial aggregates, then a comparison with it: no register is sorted in a task.
        best = F.min if self.first else F.max
        rows = self.coordinates()
        key = F.struct("at", "state") if self.tiebreak_by_id else F.struct("at")
        winners = rows.groupBy("register").agg(best(key).alias("best"))
        lost = (key > F.col("best")) if self.first else (key < F.col("best"))
        return rows.join(winners, "register").where(lost).select("state").distinct()


def resolve(order: Order, candidates: DataFrame) -> DataFrame:
    """The candidates (one column) that nothing dominates, as a set."""
    name = candidates.columns[0]
    gone = order.dominated()
    out = candidates if gone is None else candidates.join(gone.withColumnRenamed("state", name), name, "left_anti")
    return out.distinct()


def latest(source: FactSource, observes: str, candidates: DataFrame) -> DataFrame:
    return resolve(ObservationOrder(source, observes), candidates)


def maximal(df: DataFrame, var: str, order: Order) -> DataFrame:
    """Rows whose variable nothing dominates; multiplicities stay."""
    gone = order.dominated()
    return df if gone is None else df.join(gone.withColumnRenamed("state", var), var, "left_anti")


def sole(df: DataFrame, register: str, state: str) -> DataFrame:
    """(register, kind, state, fork) of the surviving states of each register: kind ``sole`` with the state, or ``fork``
    with the sorted array of them. Registers without survivors have no row; ``empty`` is theirs after an outer join."""
    got = df.groupBy(register).agg(F.sort_array(F.collect_set(state)).alias("all"))
    one = F.size("all") == 1
    return got.select(register, F.when(F.size("all") == 0, "empty").when(one, "sole").otherwise("fork").alias("kind"), F.when(one, F.col("all")[0]).alias("state"), F.when(F.size("all") > 1, F.col("all")).alias("fork"))


@dataclass(frozen=True)
class Heads:
    """The lattice of heads: states seen (``subjects``) and states observed (``targets``), both kept for ever, so that an
    old fact that arrives late never brings a retired head back. Joining is commutative, associative and idempotent."""

    subjects: DataFrame
    targets: DataFrame

    @staticmethod
    def derive(source: FactSource, observes: str) -> "Heads":
        edges = source.scan(observes)
        return Heads(edges.select(F.col("e").alias("state")).distinct(), edges.select(F.col("v").alias("state")).distinct())

    def join(self, other: "Heads") -> "Heads":
        return Heads(self.subjects.unionByName(other.subjects).distinct(), self.targets.unionByName(other.targets).distinct())

    def states(self) -> DataFrame:
        """Heads: states that observe something and that nothing observes. The members of a cycle retire each other."""
        return self.subjects.join(self.targets, "state", "left_anti").distinct()


@dataclass(frozen=True)
class Lww:
    """Last-write-wins registers: identity rows (state, register) and order rows (state, at), which may arrive apart."""

    identities: DataFrame
    orders: DataFrame

    @staticmethod
    def derive(source: FactSource, identity: str, order: str, by: str = "v") -> "Lww":
        return Lww(source.scan(identity).select(F.col("e").alias("state"), F.col("v").alias("register")).distinct(), source.scan(order).select(F.col("e").alias("state"), F.col(by).alias("at")).distinct())

    def join(self, other: "Lww") -> "Lww":
        return Lww(self.identities.unionByName(other.identities).distinct(), self.orders.unionByName(other.orders).distinct())

    def complete(self) -> DataFrame:
        """(state, register, at) of the states with both halves; two of either half in a state raise when read."""
        def one(df: DataFrame, col: str) -> DataFrame:
            got = df.groupBy("state").agg(F.min(col).alias(col), F.max(col).alias("other"))
            clash = F.raise_error(F.concat(F.lit(f"two values of {col} for "), F.col("state")))
            return got.select("state", F.when(F.col(col) == F.col("other"), F.col(col)).otherwise(clash.cast(df.schema[col].dataType)).alias(col))
        return one(self.identities, "register").join(one(self.orders, "at"), "state")

    def winners(self) -> DataFrame:
        """(register, state, at): of each register the state of the greatest (order, id)."""
        return self.complete().groupBy("register").agg(F.max(F.struct("at", "state")).alias("w")).select("register", "w.state", "w.at")

    def unresolved(self) -> DataFrame:
        """States that have only one half so far."""
        a, b = self.identities.select("state").distinct(), self.orders.select("state").distinct()
        return a.join(b, "state", "left_anti").unionByName(b.join(a, "state", "left_anti"))


def history(order: StatedOrder) -> DataFrame:
    """(register, state, at, rank): all states of each register, the latest first."""
    return order.coordinates().withColumn("rank", F.row_number().over(Window.partitionBy("register").orderBy(F.desc("at"), F.desc("state"))))
