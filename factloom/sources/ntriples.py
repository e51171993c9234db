"""RDF N-Triples to facts.

Lines are parsed by one regular expression in the JVM, those with escapes by the same one in Arrow batches; a malformed
line is skipped. The rest is expressions. Ids
follow from IRIs, so equal IRIs are equal entities everywhere. A literal becomes a value of the encoding of its datatype, or a text if it can't be read
as one. A literal with a language is an entity of its own, with the text and the language as facts, the same for equal
content. Blank nodes are resolved by content, from the leaves up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalar
from factloom.functions.codec import encoding
from factloom.operators.shared import cut, distinct
from factloom.sources.facts import COLUMNS

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TEXT, RDF_LANG = "rdf.text", "rdf.lang"
_IRI = r"<([^\x00-\x20<>\"{}|^`]*)>"
_BNODE = r"_:(\w(?:[\w.\-]*[\w\-])?)"
_LITERAL = r'"((?:[^"\\\n\r]++|\\.)*)"(?:\^\^<([^\x00-\x20<>]*)>|@([a-zA-Z]+(?:-[a-zA-Z0-9]+)*))?'
_LINE = re.compile(rf"[ \t]*(?:{_IRI}|{_BNODE})[ \t]*{_IRI}[ \t]*(?:{_IRI}|{_BNODE}|{_LITERAL})[ \t]*\.[ \t]*(?:#.*)?$")

_INTS = ["integer", "int", "long", "short", "byte", "negativeInteger", "nonPositiveInteger"]
_UNSIGNED = ["nonNegativeInteger", "positiveInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte"]


def uri_to_id(uri: Column) -> Column:
    """Id of an IRI: 16 bytes in hexadecimal."""
    return F.substring(F.sha2(uri, 256), 33, 32)


_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))")
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str | None:
    """Undoes the escapes of N-Triples; None for one that isn't any, or that names no character."""
    def one(m: re.Match) -> str:
        if m[3] is not None:
            return _PLAIN[m[3]]
        code = int(m[1] or m[2], 16)
        if 0xD800 <= code < 0xE000:
            raise ValueError
        return chr(code)

    try:
        return _ESCAPE.sub(one, text) if "\\" in text else text
    except (KeyError, ValueError, OverflowError):
        return None


@dataclass(frozen=True)
class Imported:
    """facts; uris (id, uri) of all IRIs; terms: a row for each line parsed."""

    facts: DataFrame
    uris: DataFrame
    terms: DataFrame

    @property
    def triples(self) -> int:
        """Number of lines parsed, counted when asked for."""
        return self.terms.count()


_NAMES = ["subject", "subject_b", "predicate", "object", "object_b", "literal", "datatype", "lang"]


def parse_line(line: str) -> tuple | None:
    """The terms of a line in the order of ``_NAMES``, unescaped; None if it is no triple."""
    m = _LINE.match(line)
    if m is None:
        return None
    terms = [x if x is None else unescape(x) if i in (0, 2, 3, 5) else x for i, x in enumerate(m.groups())]
    return None if any(x is None and y is not None for x, y in zip(terms, m.groups())) else tuple(terms)


#: Between the terms of a line that the JVM took apart; a line that holds it goes to Python.
_PART = "\x01"
_JVM_LINE = (
    r"\A[ \t]*(?:(<[^\x00-\x20<>\"{}|^`]*+>)|_:([\w](?:[\w.\-]*[\w\-])?))[ \t]*+(<[^\x00-\x20<>\"{}|^`]*+>)[ \t]*+"
    r"(?:(<[^\x00-\x20<>\"{}|^`]*+>)|_:([\w](?:[\w.\-]*[\w\-])?)|(\"[^\"\n\r]*+\")(?:\^\^(<[^\x00-\x20<>]*+>)|@([a-zA-Z]++(?:-[a-zA-Z0-9]++)*+))?)"
    r"[ \t]*\.[ \t]*(?:#[^\n]*)?\z"
).replace(r"\w", r"\p{L}\p{N}_")


def _terms(lines: DataFrame) -> DataFrame:
    """lines (doc, value) -> doc and the terms of the lines that are triples."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(d, *t) for d, v in zip(b.column("doc").to_pylist(), b.column("value").to_pylist()) if (t := parse_line(v)) is not None]
            columns = zip(*rows) if rows else [[]] * (len(_NAMES) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["doc", *_NAMES])

    odd = F.contains("value", F.lit("\\")) | F.contains("value", F.lit(_PART))
    slow = lines.where(odd).mapInArrow(run, ", ".join(f"{n} string" for n in ["doc", *_NAMES]))
    # one match a line: the groups are written out in one string, which holds a mark only if the line matched
    parts = F.split(F.regexp_replace("value", F.lit(_JVM_LINE), F.lit(_PART.join(f"${i}" for i in range(1, 9)))), F.lit(_PART))
    taken = lines.where(~odd).select("doc", parts.alias("p")).where(F.size("p") == 8)
    def term(i: int, ends: int) -> Column:
        x = F.element_at("p", i + 1)
        return F.when(x != "", F.substring(x, 2, F.length(x) - 2) if ends else x)
    fast = taken.select("doc", *[term(i, ends).alias(n) for i, (n, ends) in enumerate(zip(_NAMES, (1, 0, 1, 1, 0, 1, 1, 0)))])
    return fast.unionByName(slow)


def readings(text: Column, datatype: Column) -> Column:
    """struct of a literal's reading as each encoding that its datatype may ask for, null where it doesn't or the text
    doesn't fit."""
    short = F.when(datatype.startswith(XSD), F.substring(datatype, len(XSD) + 1, 1000))
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint"))
    exact = F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), text.try_cast("decimal(38,18)"))
    spelled = F.replace(F.replace(text, F.lit("INF"), F.lit("Infinity")), F.lit("+"), F.lit(""))
    number = F.when(text.rlike(r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$"), spelled.try_cast("double"))
    truth = F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False))
    raw = F.when((short == "hexBinary") & text.rlike(r"^([0-9a-fA-F]{2})*$"), F.try_to_binary(text, F.lit("hex"))).when(short == "base64Binary", F.try_to_binary(text, F.lit("base64")))
    return F.struct(
        F.when(short.isin(*_INTS) | (short.isin(*_UNSIGNED) & ~text.startswith("-")), whole).alias("as_int"),
        F.when(short == "decimal", exact).alias("as_decimal"),
        F.when(short.isin("double", "float"), number).alias("as_float"),
        F.when(short == "boolean", truth).alias("as_bool"),
        scalar.parse_time(text, short).alias("as_interval"),
        F.when(short.isin("duration", "dayTimeDuration"), scalar.parse_duration(text)).alias("as_duration"),
        raw.alias("as_bytes"),
        F.when(short == "anyURI", uri_to_id(text)).alias("as_id"),
    )


def literal_struct(text: Column) -> Column:
    """struct(v, int, num) of a literal from the columns of its readings; a text if there is none."""
    out = None
    for name in ("int", "decimal", "float", "bool", "interval", "duration", "bytes", "id"):
        e, value = encoding(name), F.col(f"as_{name}")
        made = F.struct(e.key(value).alias("v"), e.int(value).alias("int"), e.num(value).alias("num"))
        out = F.when(value.isNotNull(), made) if out is None else out.when(value.isNotNull(), made)
    e = encoding("text")
    return out.otherwise(F.struct(e.key(text).alias("v"), e.int(text).alias("int"), e.num(text).alias("num")))


def parse(lines: DataFrame, resolve_blank: bool = True) -> Imported:
    """Facts of lines (value string, and doc, the document that blank node labels belong to, if there are several)."""
    if "doc" not in lines.columns:
        lines = lines.withColumn("doc", F.lit(""))
    # lines of a few files are dealt to many tasks
    t = cut(_terms(lines.select("doc", "value").hint("rebalance", "value")))
    rows = t.count()
    # taken apart by a generator, so that a reading is computed once and not for each column that follows from it
    read = t.select("*", F.inline(F.array(readings(F.col("literal"), F.col("datatype")))))
    text = F.col("literal")
    lang = F.lower("lang")
    lang_id = F.substring(F.sha2(F.concat(lang, F.lit("\x00"), text), 256), 33, 32)
    nothing = F.lit(None)
    plain_id = lambda c: F.struct(c.alias("v"), nothing.cast("bigint").alias("int"), nothing.cast("double").alias("num"))
    value = F.when(F.col("object").isNotNull(), plain_id(uri_to_id(F.col("object"))))
    value = value.when(F.col("object_b").isNotNull(), plain_id(F.concat(F.lit("_:"), F.col("doc"), F.lit("\x1f"), F.col("object_b"))))
    value = value.when(F.col("lang").isNotNull(), plain_id(lang_id)).otherwise(literal_struct(text))
    subject = F.coalesce(uri_to_id(F.col("subject")), F.concat(F.lit("_:"), F.col("doc"), F.lit("\x1f"), F.col("subject_b")))
    main = read.select(subject.alias("e"), F.col("predicate").alias("a"), F.inline(F.array(value)))
    tagged = t.where("lang is not null").select(lang_id.alias("e"), text.alias("text"), lang.alias("lang")).distinct()
    tk = encoding("text")
    more = tagged.select("e", F.lit(RDF_TEXT).alias("a"), tk.key(F.col("text")).alias("v")).unionByName(tagged.select("e", F.lit(RDF_LANG).alias("a"), tk.key(F.col("lang")).alias("v")))
    facts = distinct(main.unionByName(more.withColumns({"int": nothing.cast("bigint"), "num": nothing.cast("double")})), rows, "e", "a", "v")
    if resolve_blank and not t.where("subject_b is not null or object_b is not null").isEmpty():
        facts = resolve_blank_nodes(facts)
    iris = t.select(F.explode(F.array("subject", "predicate", "object")).alias("uri")).where("uri is not null").distinct()
    return Imported(facts.select(*COLUMNS), iris.select(uri_to_id(F.col("uri")).alias("id"), "uri"), t)


class BlankNodeCycle(Exception):
    """Blank nodes refer to each other in a circle, so none has an id by content."""


def resolve_blank_nodes(facts: DataFrame) -> DataFrame:
    """Replaces blank nodes (``_:`` ids) by ids from their facts, from those that refer to no other blank node up. One
    that is never a subject gets an id from its document and label. A circle raises BlankNodeCycle."""
    blank = lambda c: F.col(c).startswith("_:")
    if facts.where(blank("e") | blank("v")).isEmpty():
        return facts
    facts = cut(facts)
    subjects = facts.where(blank("e")).select("e").distinct()
    orphans = facts.where(blank("v")).select(F.col("v").alias("node")).distinct().join(subjects.withColumnRenamed("e", "node"), "node", "left_anti")
    ids = cut(orphans.select("node", F.substring(F.sha2(F.col("node"), 256), 33, 32).alias("id")))
    open_ = cut(facts.where(blank("e")))
    while not open_.isEmpty():
        named = ids.select(F.col("node").alias("v"), "id")
        open_ = cut(open_.join(named, "v", "left").select("e", "a", F.coalesce("id", "v").alias("v"), "int", "num"))
        ready = open_.groupBy("e").agg(F.max(blank("v")).alias("waits"), F.sort_array(F.collect_set(F.concat(F.length("a").cast("string"), F.lit(":"), F.col("a"), F.col("v")))).alias("rows")).where("not waits")
        new = cut(ready.select(F.col("e").alias("node"), F.substring(F.sha2(F.array_join(F.transform("rows", lambda r: F.concat(F.length(r).cast("string"), F.lit(":"), r)), ""), 256), 33, 32).alias("id")))
        if new.isEmpty():
            raise BlankNodeCycle
        open_ = cut(open_.join(new.select(F.col("node").alias("e")), "e", "left_anti"))
        ids = cut(ids.unionByName(new))
    names = ids.select("node", "id")
    out = facts.join(names.select(F.col("node").alias("e"), F.col("id").alias("ei")), "e", "left").join(names.select(F.col("node").alias("v"), F.col("id").alias("vi")), "v", "left")
    return out.select(F.coalesce("ei", "e").alias("e"), "a", F.coalesce("vi", "v").alias("v"), "int", "num").dropDuplicates(["e", "a", "v"])


def read(spark: SparkSession, *paths: str) -> Imported:
    """Facts of files; each file's blank nodes are its own."""
    lines = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("doc"))
    return parse(lines)


def write(facts: DataFrame, uris: DataFrame, path: str) -> None:
    """Writes facts whose entities, and attributes' names, are IRIs as N-Triples; values of other encodings as typed
    literals, ids without an IRI as ``urn:id:``."""
    to_lines(facts, uris).write.text(path)


def to_lines(facts: DataFrame, uris: DataFrame) -> DataFrame:
    names = uris.select("id", "uri")
    df = facts.join(names.select(F.col("id").alias("e"), F.col("uri").alias("eu")), "e", "left").join(names.select(F.col("id").alias("v"), F.col("uri").alias("vu")), "v", "left")
    def iri(known: Column, key: Column) -> Column:
        return F.concat(F.lit("<"), F.coalesce(known, F.concat(F.lit("urn:id:"), key)), F.lit(">"))
    def quoted(x: Column) -> Column:
        for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
            x = F.replace(x, F.lit(plain), F.lit(code))
        return F.concat(F.lit('"'), x, F.lit('"'))
    v, body = F.col("v"), F.substring("v", 4, 2147483647)
    def typed(name: str) -> Column:
        return F.concat(quoted(body), F.lit(f"^^<{XSD}{name}>"))
    out = F.when(~v.startswith("="), iri(F.col("vu"), v))
    for letter, name in (("i", "integer"), ("f", "double"), ("n", "decimal"), ("b", "boolean"), ("x", "hexBinary")):
        out = out.when(v.startswith(f"={letter}:"), typed(name))
    out = out.otherwise(quoted(body))
    return df.select(F.concat(iri(F.col("eu"), F.col("e")), F.lit(" "), F.concat(F.lit("<"), F.col("a"), F.lit(">")), F.lit(" "), out, F.lit(" .")).alias("value"))
