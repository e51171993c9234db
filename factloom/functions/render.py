"""User encodings of blobs, and how values are written for people."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.codec import encoding


@dataclass(frozen=True)
class BlobEncoding:
    """decode gives null for bytes that aren't of the encoding."""

    name: str
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


_BLOBS: dict[str, BlobEncoding] = {}


def register_blob(e: BlobEncoding) -> BlobEncoding:
    if _BLOBS.setdefault(e.name, e) is not e:
        raise ValueError(f"blob encoding {e.name} is registered")
    return e


def blob_encoding(name: str) -> BlobEncoding:
    return _BLOBS[name]


_utf8 = lambda b: F.try_validate_utf8(b.cast("string"))
register_blob(BlobEncoding("text", lambda c: F.encode(c, "UTF-8"), _utf8))
register_blob(BlobEncoding("json", lambda c: F.encode(F.to_json(c), "UTF-8"), lambda b: F.try_parse_json(_utf8(b))))
register_blob(BlobEncoding("longs", lambda c: F.unhex(F.array_join(F.transform(c, lambda x: F.lpad(F.hex(x), 16, "0")), "")), lambda b: F.when(F.octet_length(b) % 8 == 0, F.transform(F.when(F.octet_length(b) > 0, F.sequence(F.lit(0), (F.octet_length(b) / 8 - 1).cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substring(F.hex(b), i * 16 + 1, F.lit(16)), 16, -10).cast("bigint")))))


_FORMATS: dict[str, Callable[[Column], Column]] = {}


def register_formatter(kind: str, render: Callable[[Column], Column]) -> None:
    """How decoded values of an encoding are written."""
    _FORMATS[kind] = render


register_formatter("text", lambda v: v)
register_formatter("int", lambda v: v.cast("string"))
register_formatter("bool", lambda v: F.when(v, "yes").otherwise("no"))
register_formatter("float", lambda v: F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", ""))


def render(facts: DataFrame, kinds: tuple[str, ...] = ("text", "int", "bool", "float")) -> DataFrame:
    """(e, a, text): each fact's value by its encoding's formatter; ids and values of other encodings by their key."""
    out = None
    for k in kinds:
        value = encoding(k).decode(F.col("v"))
        made = _FORMATS[k](value)
        out = F.when(value.isNotNull(), made) if out is None else out.when(value.isNotNull(), made)
    return facts.select("e", "a", (out.otherwise(F.col("v")) if out is not None else F.col("v")).alias("text"))
