"""Fact tables: the canonical DataFrame, its construction from rows and entities, and its storage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.codec import Encoding, encoding, of_spark
from factloom.operators.shared import ROWS, distinct, parts

FACT_SCHEMA = "e string, a string, v string, int bigint, num double"
COLUMNS = ["e", "a", "v", "int", "num"]


@dataclass(frozen=True)
class Attribute:
    """An attribute: a key in the column ``a`` and the encoding of its values.

    The key of a named attribute is its name; attributes from an anchor or an IRI have a key derived from (kind, anchor
    or IRI, encoding), so that another encoding makes another attribute.
    """

    key: str
    encoding: Encoding
    name: str = ""
    doc: str = ""
    many: bool = False

    @staticmethod
    def named(name: str, kind: str, **options) -> "Attribute":
        return Attribute(name, encoding(kind), name, **options)

    @staticmethod
    def derived(anchor: str, kind: str, name: str = "", **options) -> "Attribute":
        import hashlib

        return Attribute(hashlib.sha256(f"{len(anchor)}:{anchor}{kind}".encode()).hexdigest()[:32], encoding(kind), name or anchor, **options)


@dataclass
class Catalog:
    """Attributes by name."""

    attributes: dict[str, Attribute] = field(default_factory=dict)

    def add(self, *attributes: Attribute) -> "Catalog":
        for x in attributes:
            if self.attributes.setdefault(x.name, x) != x:
                raise ValueError(f"attribute {x.name} is declared twice")
        return self

    def __getitem__(self, name: str) -> Attribute:
        return self.attributes[name]

    def merge(self, other: "Catalog") -> "Catalog":
        return Catalog(dict(self.attributes)).add(*other.attributes.values())

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(x.key, x.name, x.encoding.name, x.many, x.doc) for x in self.attributes.values()]
        return spark.createDataFrame(rows, "a string, name string, encoding string, many boolean, doc string")

    def facts(self, spark: SparkSession) -> DataFrame:
        """The descriptions themselves as facts about the attributes."""
        return entities(self.to_df(spark).withColumnRenamed("a", "attribute"), F.col("attribute"), {
            Attribute.named("attribute.name", "text"): F.col("name"),
            Attribute.named("attribute.encoding", "text"): F.col("encoding"),
            Attribute.named("attribute.doc", "text"): F.when(F.col("doc") != "", F.col("doc")),
        })


def _unary(f):
    return lambda x: f(x)


def fact_structs(values: Mapping[Attribute, Column]) -> Column:
    """The array of (a, v, int, num) of an entity's values. Null values are left out; an attribute declared ``many``
    takes an array, each element of which is a fact."""
    parts = []
    for a, value in values.items():
        enc = a.encoding

        def one(x: Column, a: Attribute = a, enc: Encoding = enc) -> Column:
            return F.struct(F.lit(a.key).alias("a"), enc.key(x).alias("v"), enc.int(x).alias("int"), enc.num(x).alias("num"))

        parts.append(F.transform(F.coalesce(value, F.array().cast(f"array<{enc.sql_type}>")), _unary(one)) if a.many else F.array(one(value)))
    return F.filter(F.concat(*parts), lambda x: x["v"].isNotNull())


def entities(df: DataFrame, entity: Column | None, values: Mapping[Attribute, Column]) -> DataFrame:
    """Facts of one entity a row. With ``entity`` None the id follows from the facts: equal content, in any order and
    with repetitions, has one id. Only a content id needs its facts at once; either way nothing is shuffled."""
    if entity is None:
        if any(a.many for a in values):
            entity = intrinsic_id(fact_structs(values))
        else:
            df, entity = with_row_id(df, values)
    if len(values) == 1 and not next(iter(values)).many:
        # one attribute: no array to take apart, and a filter on the value is a filter on the column
        (a, value), = values.items()
        rows = df.select(entity.cast("string").alias("e"), F.lit(a.key).alias("a"), a.encoding.key(value).alias("v"), a.encoding.int(value).alias("int"), a.encoding.num(value).alias("num"))
        return rows.where("e is not null and v is not null")
    rows = df.select(entity.cast("string").alias("e"), fact_structs(values).alias("facts"))
    return rows.where("e is not null").select("e", F.inline("facts")).select(*COLUMNS)


def with_row_id(df: DataFrame, values: Mapping[Attribute, Column], salt: str = "") -> tuple[DataFrame, Column]:
    """``intrinsic_id`` of an entity with at most one value an attribute, without building arrays: the order of the facts
    is that of the attributes, known beforehand. Keys and rows are columns of their own, so that none is computed twice."""
    order = sorted(values.items(), key=lambda x: f"{len(x[0].key)}:{x[0].key}".encode())
    df = df.withColumns({f"__row{i}": F.concat(F.lit(f"{len(a.key)}:{a.key}"), a.encoding.key(v)) for i, (a, v) in enumerate(order)})
    parts = [F.when(F.col(f"__row{i}").isNotNull(), F.concat(F.length(f"__row{i}").cast("string"), F.lit(":"), F.col(f"__row{i}"))).otherwise("") for i in range(len(order))]
    df = df.withColumn("__id", F.substring(F.sha2(F.concat(F.lit(salt), *parts), 256), 33, 32)).drop(*[f"__row{i}" for i in range(len(order))])
    return df, F.col("__id")


def intrinsic_id(facts: Column, salt: str = "") -> Column:
    """Id of an entity from its facts: the last 16 bytes, in hexadecimal, of the SHA-256 of its sorted distinct facts."""
    rows = F.array_sort(F.array_distinct(F.transform(facts, lambda x: F.concat(F.length(x["a"]).cast("string"), F.lit(":"), x["a"], x["v"]))))
    return F.substring(F.sha2(F.concat(F.lit(salt), F.array_join(F.transform(rows, lambda r: F.concat(F.length(r).cast("string"), F.lit(":"), r)), "")), 256), 33, 32)


def table_values(df: DataFrame, name: str, references: Mapping[str, str] | None = None) -> dict[Attribute, Column]:
    """The attributes ``name.column`` of a relational table and their values; foreign keys point to entities."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if f.name in (references or {}):
            out[Attribute.named(f"{name}.{f.name}", "id")] = F.concat(F.lit(references[f.name] + "/"), F.col(f.name).cast("string"))
        elif not kind.startswith("array"):
            out[Attribute.named(f"{name}.{f.name}", of_spark(kind).name)] = F.col(f.name)
    return out


def table_entity(df: DataFrame, name: str, key: str | Sequence[str] | None, values: Mapping[Attribute, Column]) -> tuple[DataFrame, Column]:
    """The rows and their entity: ``name/key``, or the id of the row's content if there is no key."""
    if key is None:
        return with_row_id(df, values)
    keys = [key] if isinstance(key, str) else list(key)
    return df, F.concat(F.lit(name + "/"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))


def table_facts(df: DataFrame, name: str, key: str | Sequence[str] | None, references: Mapping[str, str] | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Facts of a relational table: attribute ``name.column`` for each column, entity ``name/key`` for each row, or the
    id of the row's content if there is no key. ``references`` names the columns that are foreign keys and the table
    they point to: their values are entities. ``columns``: only their facts."""
    values = table_values(df, name, references)
    df, entity = table_entity(df, name, key, values)
    return entities(df, entity, {a: v for a, v in values.items() if columns is None or a.name.partition(".")[2] in columns})


class FactSource:
    """What patterns read: anything with ``facts()``, the canonical DataFrame of distinct facts."""

    def __init__(self, df: DataFrame, distinct: bool = True) -> None:
        """``distinct``: whether the rows are distinct facts already, as those from keyed tables are."""
        self._df = df.select(*COLUMNS)
        self._distinct = distinct

    def facts(self) -> DataFrame:
        return self._df if self._distinct else self._df.dropDuplicates(["e", "a", "v"])

    def scan(self, attribute: str) -> DataFrame:
        """Facts of one attribute: the filter reaches the scan, and only its rows are made distinct."""
        df = self._df.where(F.col("a") == attribute)
        return df if self._distinct else df.dropDuplicates(["e", "a", "v"])


class UnionSource(FactSource):
    """One logical set over several segments."""

    def __init__(self, *segments: DataFrame) -> None:
        df = segments[0].select(*COLUMNS)
        for s in segments[1:]:
            df = df.unionByName(s.select(*COLUMNS))
        super().__init__(df, distinct=False)


class TableSource(FactSource):
    """Facts read from relational tables by attribute. A pattern on one attribute reads the table's one column and its
    key, so that filters on the value reach the file scan, and clauses that share an entity are one scan without a join."""

    def __init__(self, tables: Mapping[str, tuple[DataFrame, str | None, Mapping[str, str]]]) -> None:
        """tables: name -> (rows, key column, foreign keys). The key must be unique; without one, an entity is its row's
        content, and equal rows are one entity."""
        self.tables = {n: (df if key is not None else df.distinct(), key, refs) for n, (df, key, refs) in tables.items()}
        self._thin = {n: _by_content(df) for n, (df, key, _) in tables.items() if key is None}

    def facts(self) -> DataFrame:
        out = None
        for name, (df, key, refs) in self.tables.items():
            part = table_facts(df, name, key, refs)
            out = part if out is None else out.unionByName(part)
        return out

    def table_of(self, attribute: str) -> str | None:
        name, _, column = attribute.partition(".")
        return name if name in self.tables and column in self.tables[name][0].columns else None

    def scan(self, attribute: str) -> DataFrame:
        name = self.table_of(attribute)
        if name is None:
            some = next(iter(self.tables.values()))[0].sparkSession
            return some.createDataFrame([], FACT_SCHEMA)
        df, key, refs = self.tables[name]
        return table_facts(df, name, key, refs, [attribute.partition(".")[2]])

    def star(self, attributes: Sequence[str]) -> DataFrame | None:
        """Rows of one table with a non-null value in each of the attributes, as e, and v0, int0, num0, v1, ... in their
        order; None if they aren't all of one table. Entities are unique, so this is the join of their scans."""
        names = {self.table_of(a) for a in attributes}
        if len(names) != 1 or None in names:
            return None
        name, = names
        df, key, refs = self.tables[name]
        values = table_values(df, name, refs)
        by = {a.key: (a.encoding, v) for a, v in values.items()}
        if any(a not in by for a in attributes):
            return None
        df, entity = table_entity(self._thin.get(name, df), name, key, values)
        columns = [entity.alias("e")]
        for i, a in enumerate(attributes):
            enc, value = by[a]
            columns += [enc.key(value).alias(f"v{i}"), enc.int(value).alias(f"int{i}"), enc.num(value).alias(f"num{i}")]
        out = df.select(*columns)
        if key is not None:  # the id of a content is never null; without this filter, one that nothing asks for isn't made
            out = out.where("e is not null")
        for i in range(len(attributes)):
            out = out.where(F.col(f"v{i}").isNotNull())
        return out


def _by_content(df: DataFrame) -> DataFrame:
    """The distinct rows of ``df``, by two 64-bit hashes of the row, so that columns that nothing asks for are neither
    shuffled nor compared."""
    h = [F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns]).alias(f"__h{seed}") for seed in (0, 1)]
    return df.select("*", *h).groupBy("__h0", "__h1").agg(*[F.any_value(F.col(f"`{c}`")).alias(c) for c in df.columns]).drop("__h0", "__h1")


def write_archive(facts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes facts as Parquet, a folder an attribute, each file sorted by value and entity, so that a pattern reads one
    folder and a range its row groups. Rows of an attribute are spread by value range; hot ones over many files."""
    facts = facts.select(*COLUMNS)
    rows = facts.count()
    n = parts(facts.sparkSession, rows)
    spread = distinct(facts, rows, "e", "a", "v").repartitionByRange(*[n] * (rows > ROWS), "a", F.coalesce("int", F.lit(0)), F.coalesce("num", F.lit(0.0)), "v", "e")
    spread.sortWithinPartitions("a", "int", "num", "v", "e").write.mode(mode).partitionBy("a").parquet(path)


def read_archive(spark: SparkSession, *paths: str) -> FactSource:
    """The facts of one or more archives; facts in several of them count once."""
    schema = "e string, v string, int bigint, num double, a string"
    parts = [spark.read.schema(schema).parquet(p) for p in paths]
    return FactSource(parts[0]) if len(parts) == 1 else UnionSource(*parts)


def merge_archives(spark: SparkSession, paths: Sequence[str], out: str) -> None:
    write_archive(UnionSource(*[read_archive(spark, p).facts() for p in paths]).facts(), out)


def validate(facts: DataFrame) -> DataFrame:
    """Rows that break the canonical form, with the reason: null or empty parts, or repeated facts."""
    empty = facts.where("e is null or a is null or v is null or e = '' or a = ''").select("e", "a", "v", F.lit("null or empty").alias("reason"))
    again = facts.groupBy("e", "a", "v").count().where("count > 1").select("e", "a", "v", F.lit("repeated").alias("reason"))
    return empty.unionByName(again)


def ordered_scan(source: FactSource, attribute: str, start: Column | None = None, descending: bool = False, order: str = "v") -> DataFrame:
    """Facts of one attribute in the order of value and entity, from ``start`` on if given (a value of ``order``)."""
    df = source.scan(attribute)
    if start is not None:
        df = df.where((F.col(order) <= start) if descending else (F.col(order) >= start))
    return df.orderBy(F.desc(order), F.desc("e")) if descending else df.orderBy(order, "e")


def ordered(source: FactSource) -> DataFrame:
    return source.facts().orderBy("e", "a", "v")
