"""The query algebra and its compilation to DataFrames.

A query is a tree of constraints over variables. Compiling gives a DataFrame with a column of keys for each variable
(``codec``), with bag semantics: a row for each complete binding, hidden variables included. ``find`` projects the head
without removing repetitions. Only ``Or`` and membership sets are sets.

Ranges, equalities and constants on a variable are pushed into the scans that bind it before any join is built; clauses
are joined from the one that Catalyst holds for the smallest, in an order in which each shares a variable with those before
it, if there is one. Catalyst and adaptive execution choose the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.codec import Encoding, Id, constant_key, encoding
from factloom.sources.facts import Attribute, FactSource


@dataclass(frozen=True)
class Var:
    """A variable. Those whose name begins with ``_`` are local: they can't stand in a head."""

    name: str

    def is_(self, value: object) -> "Is":
        return Is(self, value)


def vars_(names: str) -> tuple[Var, ...]:
    return tuple(Var(n) for n in names.split())


@dataclass(frozen=True)
class Limits:
    """What is known of a variable's value, pushed into the scans that bind it."""

    filters: tuple[Callable[[Column, Column, Column], Column], ...] = ()

    def on(self, key: Column, int_: Column | None = None, num: Column | None = None) -> list[Column]:
        """The conditions on a variable bound to ``key``; in the value position of a scan there are typed columns too."""
        return [f(key, int_, num) for f in self.filters]


Known = dict[str, Limits]


@runtime_checkable
class Constraint(Protocol):
    """A part of a query; users may write their own.

    A relation gives ``to_df``, a DataFrame of its variables' columns. A constraint that only filters returns None from
    ``to_df`` and gives ``filter``; it needs its variables bound by others."""

    def variables(self) -> list[str]: ...

    def to_df(self, known: Known) -> DataFrame | None: ...


class _Base:
    def variables(self) -> list[str]:
        raise NotImplementedError

    def to_df(self, known: Known) -> DataFrame | None:
        return None

    def filter(self, df: DataFrame) -> DataFrame:
        return df

    def known(self) -> Known:
        return {}


@dataclass(frozen=True)
class Pattern(_Base):
    """One clause: entity, attribute and value, each a variable or a constant."""

    source: FactSource
    e: object
    a: object
    v: object

    def variables(self) -> list[str]:
        return list(dict.fromkeys(x.name for x in (self.e, self.a, self.v) if isinstance(x, Var)))

    def to_df(self, known: Known) -> DataFrame:
        if isinstance(self.a, Var):
            df = self.source.facts()
        else:
            df = self.source.scan(self.a.key if isinstance(self.a, Attribute) else str(self.a))
        seen: dict[str, Column] = {}
        for term, name in ((self.e, "e"), (self.a, "a"), (self.v, "v")):
            col = F.col(name)
            if isinstance(term, Var):
                if term.name in seen:
                    df = df.where(seen[term.name] == col)  # a repeated variable is an equality
                else:
                    seen[term.name] = col
                    for limit in known.get(term.name, Limits()).on(col, *((F.col("int"), F.col("num")) if name == "v" else ())):
                        df = df.where(limit)
            elif name == "e":
                df = df.where(col == (term.value if isinstance(term, Id) else str(term)))
            elif name == "v":
                df = df.where(col == constant_key(_typed(self.a, term)))
        return df.select(*[c.alias(n) for n, c in seen.items()])


def _typed(attribute: object, value: object) -> object:
    """A plain int for a float attribute is that float, and likewise for decimals."""
    if isinstance(attribute, Attribute) and isinstance(value, int) and not isinstance(value, bool):
        from decimal import Decimal

        return float(value) if attribute.encoding.name == "float" else Decimal(value) if attribute.encoding.name == "decimal" else value
    return value


def pattern(source: FactSource, *clauses: tuple[object, dict]) -> "And":
    """Entity clauses (entity, {attribute: value, ...}); a list of values is one clause each."""
    parts = []
    for entity, pairs in clauses:
        for a, v in pairs.items():
            parts.extend(Pattern(source, entity, a, x) for x in (v if isinstance(v, list) else [v]))
    return And(*parts)


class And(_Base):
    """All parts hold: joins on shared variables."""

    def __init__(self, *parts: Constraint) -> None:
        self.parts = [q for p in parts for q in (p.parts if type(p) is And else [p])]

    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for p in self.parts for v in p.variables()))

    def known(self) -> Known:
        out: Known = {}
        for p in self.parts:
            for v, limits in getattr(p, "known", dict)().items():
                out[v] = Limits(out.get(v, Limits()).filters + limits.filters)
        return out

    def to_df(self, known: Known) -> DataFrame:
        mine = self.known()
        both = {v: Limits(known.get(v, Limits()).filters + mine.get(v, Limits()).filters) for v in {*known, *mine}}
        relations, filters = [], []
        for p in _starred(self.parts):
            df = p.to_df(both)
            (filters if df is None else relations).append((p, df))
        bound = {v for p, _ in relations for v in p.variables()}
        for p, _ in list(filters):
            if any(v not in bound for v in p.variables()):
                source = getattr(p, "propose", None)
                df = source(both) if source else None
                if df is None:
                    raise ValueError(f"variables {[v for v in p.variables() if v not in bound]} are bound by nothing")
                relations.append((p, df))
                filters = [x for x in filters if x[0] is not p]
                bound |= set(p.variables())
        if not relations:
            raise ValueError("a query needs a part that binds")
        if len(relations) > 2:  # the smallest first, by Catalyst's estimate, then the smallest that shares a variable
            relations = sorted(relations, key=lambda x: _estimate(x[1]))
        rest = relations[1:]
        df, have = relations[0][1], set(relations[0][0].variables())
        while rest:
            i = max(range(len(rest)), key=lambda k: (len(have & set(rest[k][0].variables())) > 0, -k))
            part, other = rest.pop(i)
            on = [v for v in part.variables() if v in have]
            df = df.join(other, on, "inner") if on else df.crossJoin(other)
            have |= set(part.variables())
        for p, _ in filters:
            df = p.filter(df)
        return df


@dataclass
class _Star(_Base):
    """Clauses on one entity of one table, answered by one scan."""

    clauses: list[Pattern]

    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for c in self.clauses for v in c.variables()))

    def to_df(self, known: Known) -> DataFrame:
        df = self.clauses[0].source.star([_key_of(c.a) for c in self.clauses])
        entity = self.clauses[0].e
        seen: dict[str, Column] = {}
        if isinstance(entity, Var):
            seen[entity.name] = F.col("e")
            for limit in known.get(entity.name, Limits()).on(F.col("e")):
                df = df.where(limit)
        else:
            df = df.where(F.col("e") == (entity.value if isinstance(entity, Id) else str(entity)))
        for i, c in enumerate(self.clauses):
            col = F.col(f"v{i}")
            if not isinstance(c.v, Var):
                df = df.where(col == constant_key(_typed(c.a, c.v)))
            elif c.v.name in seen:
                df = df.where(seen[c.v.name] == col)
            else:
                seen[c.v.name] = col
                for limit in known.get(c.v.name, Limits()).on(col, F.col(f"int{i}"), F.col(f"num{i}")):
                    df = df.where(limit)
        return df.select(*[c.alias(n) for n, c in seen.items()])


def _estimate(df: DataFrame) -> int:
    """Bytes of a relation as the optimizer estimates them, from statistics where there are any."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _key_of(attribute: object) -> str:
    return attribute.key if isinstance(attribute, Attribute) else str(attribute)


def _starred(parts: Sequence[Constraint]) -> list[Constraint]:
    """Puts clauses of one source, entity and table together, where the source can scan them at once."""
    groups: dict[tuple, list[Pattern]] = {}
    out: list[object] = []
    for p in parts:
        table = getattr(p.source, "table_of", None) if isinstance(p, Pattern) and not isinstance(p.a, Var) else None
        name = table(_key_of(p.a)) if table else None
        if name is None:
            out.append(p)
            continue
        key = (id(p.source), name, p.e.name if isinstance(p.e, Var) else ("constant", str(p.e)))
        if key not in groups:
            out.append(key)
            groups[key] = []
        groups[key].append(p)
    return [(_Star(groups[x]) if len(groups[x]) > 1 else groups[x][0]) if isinstance(x, tuple) else x for x in out]


class Or(_Base):
    """Any arm holds: the set union over all variables of the arms, which must be the same in each."""

    def __init__(self, *arms: Constraint) -> None:
        if not arms:
            raise ValueError("or_ needs an arm")
        first = set(arms[0].variables())
        for arm in arms[1:]:
            if set(arm.variables()) != first:
                raise ValueError(f"arms bind different variables: {sorted(first)} and {sorted(arm.variables())}")
        self.arms = arms

    def variables(self) -> list[str]:
        return self.arms[0].variables()

    def to_df(self, known: Known) -> DataFrame:
        names = self.variables()
        df = None
        for arm in self.arms:
            part = And(arm).to_df(known).select(*names)
            df = part if df is None else df.unionByName(part)
        return df.distinct()


@dataclass
class Has(_Base):
    """Membership of a variable in a set: a DataFrame's one column of keys, or Python values. It filters by a semi join,
    and binds the distinct members where nothing else binds the variable."""

    var: Var
    members: DataFrame | Sequence[object]
    spark: SparkSession | None = None

    def variables(self) -> list[str]:
        return [self.var.name]

    def _set(self) -> DataFrame:
        if isinstance(self.members, DataFrame):
            return self.members.toDF(self.var.name)
        spark = self.spark or SparkSession.getActiveSession()
        return spark.createDataFrame([(constant_key(m),) for m in self.members], f"`{self.var.name}` string")

    def known(self) -> Known:
        if isinstance(self.members, DataFrame) or len(self.members) > 64:
            return {}
        keys = [constant_key(m) for m in self.members]
        return {self.var.name: Limits((lambda k, i, n: k.isin(keys),))}

    def propose(self, known: Known) -> DataFrame:
        df = self._set().distinct()
        for limit in known.get(self.var.name, Limits()).on(F.col(self.var.name)):
            df = df.where(limit)
        return df

    def filter(self, df: DataFrame) -> DataFrame:
        return df.join(self._set(), self.var.name, "left_semi")


class OwnedIds:
    """The ids that a writer made or took over; only it adds facts to them."""

    def __init__(self, spark: SparkSession, *ids: str) -> None:
        self.spark, self._ids = spark, list(ids)

    def adopt(self, *ids: str) -> None:
        self._ids.extend(ids)

    def has(self, var: Var) -> Has:
        """The variable is one of them; they bind it where nothing else does."""
        return Has(var, [Id(i) for i in dict.fromkeys(self._ids)], self.spark)


def local_ids(var: Var, owner: OwnedIds) -> Has:
    return owner.has(var)


def similar(candidates: DataFrame, var: Var) -> "Relation":
    """A frozen set of candidates (the first column, keys) that binds a variable, each once."""
    return Relation(candidates.select(candidates.columns[0]), [var], distinct=True)


@dataclass
class Is(_Base):
    """A variable has a constant value."""

    var: Var
    value: object

    def variables(self) -> list[str]:
        return [self.var.name]

    def known(self) -> Known:
        key = constant_key(self.value)
        return {self.var.name: Limits((lambda k, i, n: k == key,))}

    def propose(self, known: Known) -> DataFrame:
        return SparkSession.getActiveSession().range(1).select(F.lit(constant_key(self.value)).alias(self.var.name))

    def filter(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.var.name) == constant_key(self.value))


@dataclass
class Equal(_Base):
    """Two variables have the same value."""

    left: Var
    right: Var

    def variables(self) -> list[str]:
        return [self.left.name, self.right.name]

    def filter(self, df: DataFrame) -> DataFrame:
        return df.where(F.col(self.left.name) == F.col(self.right.name))


@dataclass
class Range(_Base):
    """A variable lies in [low, high], either end None for open. ``order``: ``value`` compares numbers and times by
    value (the bounds' type says which) and texts by code point; ``key`` compares keys bytewise."""

    var: Var
    low: object = None
    high: object = None
    order: str = "value"

    def variables(self) -> list[str]:
        return [self.var.name]

    def known(self) -> Known:
        return {self.var.name: Limits((self._limit,))}

    def _limit(self, key: Column, int_: Column | None = None, num: Column | None = None) -> Column:
        sample = self.low if self.low is not None else self.high
        if sample is None:
            return F.lit(True)
        prefix = constant_key(sample)[:3] if not isinstance(sample, Id) else ""
        numbers = prefix in ("=i:", "=d:", "=f:", "=n:") and self.order == "value"
        col, of = key, constant_key
        if numbers:
            whole = prefix in ("=i:", "=d:")
            col = int_ if whole else num
            if col is None:
                col = F.substring(key, 4, 2147483647).try_cast("bigint" if whole else "double")
            of = (lambda x: int(constant_key(x)[3:])) if whole else float
        out = key.startswith(prefix) if prefix else ~key.startswith("=")
        if self.low is not None:
            out = out & (col >= F.lit(of(self.low)))
        if self.high is not None:
            out = out & (col <= F.lit(of(self.high)))
        return out

    def filter(self, df: DataFrame) -> DataFrame:
        return df.where(self._limit(F.col(self.var.name)))


@dataclass
class Where(_Base):
    """A predicate on the columns of complete bindings, after all joins. ``strict``: a null result is an error; otherwise
    the row goes."""

    predicate: Callable[[dict[str, Column]], Column]
    over: Sequence[Var]
    strict: bool = False

    def variables(self) -> list[str]:
        return [v.name for v in self.over]

    def filter(self, df: DataFrame) -> DataFrame:
        keep = self.predicate({v.name: F.col(v.name) for v in self.over})
        if self.strict:
            keep = F.when(keep.isNull(), F.raise_error(F.lit("predicate failed")).cast("boolean")).otherwise(keep)
        return df.where(keep)


@dataclass
class Relation(_Base):
    """Any DataFrame of key columns as a relation: closures, candidates, index results. With ``distinct`` it is made a
    set first."""

    df: DataFrame
    names: Sequence[Var]
    distinct: bool = False

    def variables(self) -> list[str]:
        return [v.name for v in self.names]

    def to_df(self, known: Known) -> DataFrame:
        df = self.df.toDF(*self.variables())
        for v in self.variables():
            for limit in known.get(v, Limits()).on(F.col(v)):
                df = df.where(limit)
        return df.distinct() if self.distinct else df


def and_(*parts: Constraint) -> And:
    return And(*parts)


def or_(*arms: Constraint) -> Or:
    return Or(*arms)


def entity_range(var: Var, low: str | None, high: str | None) -> Where:
    """Ids within [low, high] by code point; also for attributes. Pushed to the scan where the variable is bound."""
    return _IdRange(var, low, high)


@dataclass
class _IdRange(_Base):
    var: Var
    low: str | None
    high: str | None

    def variables(self) -> list[str]:
        return [self.var.name]

    def _limit(self, key: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (key >= self.low)
        if self.high is not None:
            out = out & (key <= self.high)
        return out

    def known(self) -> Known:
        return {self.var.name: Limits((lambda k, i, n: self._limit(k),))}

    def filter(self, df: DataFrame) -> DataFrame:
        return df.where(self._limit(F.col(self.var.name)))


@dataclass(frozen=True)
class Head:
    """A head column: the variable, what it decodes to, and whether failures are kept as (value, error)."""

    var: Var
    kind: str | Encoding | None = None
    fallible: bool = False


def rows(where: Constraint) -> DataFrame:
    """All complete bindings, a key column a variable."""
    return And(where).to_df({})


def find(head: Iterable[Var | Head | tuple], where: Constraint) -> DataFrame:
    """Projects the head, one row a binding, repetitions kept.

    A head item is a variable (its key: an id, or a literal's key), or a variable with an encoding's name, (var, "int"):
    rows whose value isn't of the encoding are skipped. ``Head(var, kind, fallible=True)`` keeps them, as a struct of
    value and error. An empty head gives a row without columns for each binding.
    """
    items = [x if isinstance(x, Head) else Head(*x) if isinstance(x, tuple) else Head(x) for x in head]
    names = [x.var.name for x in items]
    if len(set(names)) < len(names):
        raise ValueError(f"a head names a variable twice: {names}")
    if any(n.startswith("_") for n in names):
        raise ValueError("a local variable can't stand in a head")
    df = rows(where)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"nothing binds {missing}")
    out, need = [], []
    for x in items:
        col = F.col(x.var.name)
        if x.kind is not None:
            enc = x.kind if isinstance(x.kind, Encoding) else encoding(x.kind)
            value = enc.decode(col)
            if x.fallible:
                value = F.struct(value.alias("value"), F.when(value.isNull(), F.concat(F.lit(f"not {enc.name}: "), col)).alias("error"))
            else:
                need.append(value.isNotNull())
            col = value
        out.append(col.alias(x.var.name))
    for n in need:
        df = df.where(n)
    return df.select(*out)


def count(where: Constraint) -> int:
    """Number of bindings."""
    return rows(where).count()


def exists(where: Constraint) -> bool:
    """Whether there is any binding; stops at the first."""
    return not rows(where).limit(1).isEmpty()
