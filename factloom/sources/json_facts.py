"""JSON to facts and back.

The strict parser (Python, Arrow batches) refuses what a lenient one repairs: duplicate keys, lone surrogates, numbers
that no double holds, and nesting beyond a limit. A refused document gives no facts but an error.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.codec import constant_key
from factloom.sources.facts import COLUMNS, FactSource

MAX_DEPTH = 128


class Refused(ValueError):
    pass


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for k, v in pairs:
        if k in out:
            raise Refused(f"key {k!r} is given twice")
        out[k] = v
    return out


def _constant(name: str) -> float:
    raise Refused(f"{name} is no JSON number")


def _depth(text: str) -> int:
    nested = level = 0
    inside = skip = False
    for c in text:
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "[{":
            level += 1
            nested = max(nested, level)
        elif c in "]}":
            level -= 1
    return nested


def loads(text: str, depth: int = MAX_DEPTH) -> object:
    """Strict parsing; numbers stay text, in ``_Number``."""
    if text.count("[") + text.count("{") > depth and _depth(text) > depth:
        raise Refused(f"nested deeper than {depth}")
    try:
        value = json.loads(text, object_pairs_hook=_pairs, parse_int=_Number, parse_float=_Number, parse_constant=_constant)
    except json.JSONDecodeError as e:
        raise Refused(str(e)) from None
    if "\\u" in text:
        _no_surrogates(value)
    return value


class _Number(str):
    def double(self) -> float:
        x = float(self)
        if x in (float("inf"), float("-inf")):
            raise Refused(f"{self} is beyond a double")
        return x


def _no_surrogates(v: object) -> None:
    if isinstance(v, str):
        try:
            v.encode()
        except UnicodeEncodeError:
            raise Refused("a lone surrogate") from None
    elif isinstance(v, dict):
        for k, x in v.items():
            _no_surrogates(k)
            _no_surrogates(x)
    elif isinstance(v, list):
        for x in v:
            _no_surrogates(x)


def _id(rows: list[tuple[str, str]], salt: str) -> str:
    parts = sorted({f"{len(a)}:{a}{v}" for a, v in rows})
    return hashlib.sha256((salt + "".join(f"{len(p)}:{p}" for p in parts)).encode()).hexdigest()[32:]


def object_facts(text: str, salt: str = "", depth: int = MAX_DEPTH) -> tuple[list[str], list[tuple]]:
    """(roots, facts (e, a, v, int, num)) of an object, or of an array of objects. Attributes are the keys; numbers are
    doubles, nulls nothing, arrays repeated facts, nested objects entities. Ids follow from content."""
    facts: dict[tuple[str, str, str], tuple] = {}

    def entity(obj: dict) -> str:
        rows: list[tuple[str, str, float | None]] = []

        def put(key: str, v: object) -> None:
            if v is None:
                return
            if isinstance(v, list):
                for x in v:
                    put(key, x)
            elif isinstance(v, dict):
                rows.append((key, entity(v), None))
            elif isinstance(v, bool):
                rows.append((key, f"=b:{str(v).lower()}", None))
            elif isinstance(v, _Number):
                rows.append((key, constant_key(v.double() + 0.0), v.double()))
            else:
                rows.append((key, f"=t:{v}", None))

        for k, v in obj.items():
            put(k, v)
        e = _id([r[:2] for r in rows], salt)
        for a, v, n in rows:
            facts[e, a, v] = (e, a, v, None, n)
        return e

    value = loads(text, depth)
    objects = value if isinstance(value, list) else [value]
    if not all(isinstance(o, dict) for o in objects):
        raise Refused("the root is neither an object nor an array of objects")
    return [entity(o) for o in objects], list(facts.values())


_ROWS = "array<struct<e:string,a:string,v:string,int:bigint,num:double>>"
_KINDS = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64())


def fact_array(facts: list[tuple]) -> pa.StructArray:
    columns = zip(*facts) if facts else ((),) * len(COLUMNS)
    return pa.StructArray.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS)], COLUMNS)


def _parsed(docs: DataFrame, key: Column, text: Column, parse) -> DataFrame:
    base = docs.select(key.cast("string").alias("doc"), text.alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = pc.dictionary_encode(b.column("text"))  # a text that a batch has many times is parsed once
            all_roots, all_facts, ends, errors = [], [], [0], []
            for t in texts.dictionary.to_pylist():
                try:
                    roots, facts = parse(t)
                    errors.append(None)
                except Refused as e:
                    roots, facts = [], []
                    errors.append(str(e))
                all_roots.append(roots)
                all_facts += facts
                ends.append(len(all_facts))
            # a null text has an empty place of its own
            place = pc.fill_null(texts.indices, len(errors))
            columns = [pa.array(all_roots + [[]], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array([*ends, ends[-1]], pa.int32()), fact_array(all_facts)), pa.array(errors + [None], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc"), *[c.take(place) for c in columns]], names=["doc", "roots", "facts", "error"])

    return base.mapInArrow(run, f"doc string, roots array<string>, facts {_ROWS}, error string")


def import_objects(docs: DataFrame, key: Column, text: Column, salt: str = "", depth: int = MAX_DEPTH) -> DataFrame:
    """(doc, roots, facts, error) of each document; ``facts_of`` gives the facts. A null text has none."""
    return _parsed(docs, key, text, lambda t: object_facts(t, salt, depth))


def facts_of(imported: DataFrame) -> DataFrame:
    """The distinct facts of an import. Where several clauses read them, ``cut`` saves parsing for each."""
    return imported.select(F.inline("facts")).dropDuplicates(["e", "a", "v"])


def flat_facts(docs: DataFrame, key: Column, text: Column, schema: str, prefix: str = "") -> DataFrame:
    """Facts of flat objects of a known schema, without Python: the lenient JVM parser, one entity a document."""
    from factloom.functions.codec import of_spark
    from factloom.sources.facts import Attribute, entities

    rows = docs.select(key.cast("string").alias("key"), F.from_json(text, schema).alias("j"))
    fields = rows.schema["j"].dataType.fields
    return entities(rows, F.col("key"), {Attribute(prefix + f.name, of_spark(f.dataType.simpleString()), prefix + f.name): F.col(f"j.`{f.name}`") for f in fields})


def attributes_seen(facts: DataFrame) -> DataFrame:
    """(a, encoding, n): what an import has met, as rows of a catalog."""
    letter = F.when(F.col("v").startswith("="), F.substring("v", 2, 1)).otherwise("")
    names = F.create_map(*[F.lit(x) for x in ("t", "text", "f", "float", "b", "bool", "i", "int", "", "id")])
    return facts.groupBy("a", F.coalesce(F.try_element_at(names, letter), F.lit("other")).alias("encoding")).agg(F.count("*").alias("n"))


# Lossless trees: every value is a node with a kind; arrays keep their order, numbers their text.


def tree_facts(text: str, salt: str = "tree", depth: int = MAX_DEPTH) -> tuple[list[str], list[tuple]]:
    """Root node and facts of the tree of one JSON value. A node has ``json.kind`` and, by kind, ``json.text`` (string,
    number as written, boolean), or ``json.member`` / ``json.item`` entries, which have ``json.key`` or ``json.index``
    and ``json.value``. Equal trees are one node."""
    facts: dict[tuple[str, str, str], tuple] = {}

    def made(rows: list[tuple[str, str, int | None]]) -> str:
        e = _id([r[:2] for r in rows], salt)
        for a, v, i in rows:
            facts[e, a, v] = (e, a, v, i, None if i is None else float(i))
        return e

    def node(v: object) -> str:
        if isinstance(v, dict):
            return made([("json.kind", "=t:object", None), *(("json.member", made([("json.key", f"=t:{k}", None), ("json.value", node(x), None)]), None) for k, x in v.items())])
        if isinstance(v, list):
            return made([("json.kind", "=t:array", None), *(("json.item", made([("json.index", f"=i:{i}", i), ("json.value", node(x), None)]), None) for i, x in enumerate(v))])
        kind, t = ("null", None) if v is None else ("boolean", str(v).lower()) if isinstance(v, bool) else ("number", str(v)) if isinstance(v, _Number) else ("string", v)
        return made([("json.kind", f"=t:{kind}", None), *([("json.text", f"=t:{t}", None)] if t is not None else [])])

    return [node(loads(text, depth))], list(facts.values())


def import_trees(docs: DataFrame, key: Column, text: Column, depth: int = MAX_DEPTH) -> DataFrame:
    return _parsed(docs, key, text, lambda t: tree_facts(t, depth=depth))


def array_node(children: DataFrame) -> DataFrame:
    """(doc, array, facts) rows of the array node of each group of (doc, index, child); an array is one value."""
    def node(children: list[str]) -> tuple[str, list[tuple]]:
        facts: dict = {}
        rows = [("json.kind", "=t:array", None)]
        for i, child in enumerate(children):
            entry = [("json.index", f"=i:{i}", i), ("json.value", child, None)]
            e = _id([r[:2] for r in entry], "tree")
            for a, v, n in entry:
                facts[e, a, v] = (e, a, v, n, None if n is None else float(n))
            rows.append(("json.item", e, None))
        e = _id([r[:2] for r in rows], "tree")
        for a, v, _ in rows:
            facts[e, a, v] = (e, a, v, None, None)
        return e, list(facts.values())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, arrays, all_facts = [], [], []

        def batch() -> pa.RecordBatch:
            facts = fact_array(all_facts)
            out = pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(arrays, pa.string()), *facts.flatten()], names=["doc", "array", *COLUMNS])
            docs.clear(), arrays.clear(), all_facts.clear()
            return out

        def ended(doc: str | None, children: list[str]) -> None:
            array, facts = node(children)
            docs.extend([doc] * len(facts))
            arrays.extend([array] * len(facts))
            all_facts.extend(facts)

        doc, held = None, []  # rows come by document, one after another, however batches cut them
        for b in it:
            for d, child in zip(b.column("doc").to_pylist(), b.column("child").to_pylist()):
                if held and d != doc:
                    ended(doc, held)
                    held = []
                    if len(all_facts) > 10_000:
                        yield batch()
                doc = d
                held.append(child)
        if held:
            ended(doc, held)
        if all_facts:
            yield batch()

    rows = children.select("doc", "index", "child").repartition("doc").sortWithinPartitions("doc", "index").select("doc", "child")
    return rows.mapInArrow(run, "doc string, array string, e string, a string, v string, int bigint, num double")


def export(source: FactSource, roots: DataFrame, names: dict[str, str] | None = None, depth: int = 8) -> DataFrame:
    """(root, json) of each root (one column): fields sorted by name, several values an array in key order, an entity
    an object. An entity met again on its own path is {"$ref": id}; so is one beyond ``depth``. Non-finite numbers are
    null. Levels are joined from the deepest up, so each is one join and one aggregate."""
    facts = source.facts()
    if names:
        label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
        facts = facts.withColumn("a", F.coalesce(F.try_element_at(label, F.col("a")), F.col("a")))
    start = roots.toDF("root").distinct()
    level = start.select("root", F.col("root").alias("e"), F.array("root").alias("path"))
    levels = []
    for _ in range(depth):
        rows = level.join(facts, "e").withColumn("nested", ~F.col("v").startswith("=") & ~F.array_contains("path", F.col("v")))
        levels.append(rows)
        level = rows.where("nested").select("root", F.col("v").alias("e"), F.concat("path", F.array("v")).alias("path")).distinct()

    body = F.substring("v", 4, 2147483647)
    letter = F.substring("v", 2, 1)
    number = F.when(body.isin("NaN", "Infinity", "-Infinity"), "null").otherwise(F.regexp_replace(body, r"\.0$", ""))
    ref = F.concat(F.lit('{"$ref":'), F.to_json(F.struct(F.col("v").alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("v").alias("x")))) - 6), F.lit("}"))
    quoted = F.to_json(F.struct(body.alias("x")))
    quoted = quoted.substr(F.lit(6), F.length(quoted) - 6)
    plain = F.when(~F.col("v").startswith("="), ref).when(letter.isin("i", "f", "n", "u"), number).when(letter == "b", body).otherwise(quoted)
    done = None
    for rows in reversed(levels):
        if done is None:
            text = rows.withColumn("text", plain)
        else:
            text = rows.join(done, [rows["root"] == done["r"], F.when(rows["nested"], F.concat("path", F.array("v"))) == done["p"]], "left").withColumn("text", F.coalesce("made", plain))
        field = text.groupBy("root", "path", "a").agg(F.sort_array(F.collect_list(F.struct("v", "text"))).alias("all"))
        values = F.transform("all", lambda x: x["text"])
        name = F.to_json(F.struct(F.col("a").alias("x")))
        name = name.substr(F.lit(6), F.length(name) - 6)
        field = field.select("root", "path", "a", F.concat(name, F.lit(":"), F.when(F.size("all") == 1, values[0]).otherwise(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")))).alias("field"))
        made = field.groupBy("root", "path").agg(F.sort_array(F.collect_list(F.struct("a", "field"))).alias("all"))
        done = made.select(F.col("root").alias("r"), F.col("path").alias("p"), F.concat(F.lit("{"), F.array_join(F.transform("all", lambda x: x["field"]), ","), F.lit("}")).alias("made"))
    top = done.where(F.size("p") == 1)
    return start.join(top, start["root"] == top["r"], "left").select("root", F.coalesce("made", F.lit("{}")).alias("json"))
