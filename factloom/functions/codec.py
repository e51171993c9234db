"""Values of facts: canonical keys for joins, typed columns for ranges, and decoding.

A value's key is one string, so that equality of values of any attribute is equality of keys. An entity id is its own
key; a literal's key is ``=``, a letter for its encoding, ``:``, and its canonical text. Two literals of different
encodings are never equal. ``int`` and ``num`` hold what ranges and arithmetic need.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Encoding:
    """letter: of the key ("" for ids). sql_type: what the value decodes to. order: the typed column of ranges."""

    name: str
    letter: str
    sql_type: str
    order: str | None

    def key(self, value: Column) -> Column:
        """Key of a column of values; null stays null."""
        if self.name == "id":
            return value.cast("string")
        if self.name == "bytes":
            text = F.hex(value)
        elif self.name == "time":
            text = F.unix_micros(value.cast("timestamp")).cast("string")
        elif self.name == "interval":
            text = F.concat_ws("/", value["lower"].cast("string"), value["upper"].cast("string"))
        elif self.name == "bool":
            text = value.cast("boolean").cast("string")
        elif self.name == "decimal":
            text = value.cast("decimal(38,18)").cast("string")
        elif self.name == "float":
            number = value.cast("double")
            text = F.when(number == 0, F.lit("0.0")).otherwise(number.cast("string"))  # -0.0 and 0.0 are one value
        elif self.name in ("int", "duration"):
            text = value.cast("bigint").cast("string")
        else:
            text = value.cast("string")
        return F.concat(F.lit(f"={self.letter}:"), text)

    def text(self, key: Column) -> Column:
        """Canonical text of a key of this encoding, null for keys of others."""
        if self.name == "id":
            return F.when(~key.startswith("="), key)
        return F.when(key.startswith(f"={self.letter}:"), F.substring(key, 4, 2147483647))

    def decode(self, key: Column) -> Column:
        """Value of a key, null where the key is of another encoding or can't be read."""
        t = self.text(key)
        if self.name == "bytes":
            return F.try_to_binary(t, F.lit("hex"))
        if self.name == "time":
            return F.timestamp_micros(t.try_cast("bigint"))
        if self.name == "interval":
            part = F.split(t, "/")
            return F.when(t.isNotNull(), F.struct(part[0].try_cast("bigint").alias("lower"), part[1].try_cast("bigint").alias("upper")))
        return t if self.sql_type == "string" else t.try_cast(self.sql_type)

    def int(self, value: Column) -> Column:
        """The bigint that orders values of this encoding, or null."""
        if self.name in ("int", "duration"):
            return value.cast("bigint")
        if self.name == "time":
            return F.unix_micros(value.cast("timestamp"))
        if self.name == "interval":
            return value["lower"].cast("bigint")
        return F.lit(None).cast("bigint")

    def num(self, value: Column) -> Column:
        if self.name in ("float", "decimal", "int"):
            return value.cast("double")
        return F.lit(None).cast("double")


ENCODINGS = {
    e.name: e
    for e in (
        Encoding("id", "", "string", None),
        Encoding("text", "t", "string", None),
        Encoding("int", "i", "bigint", "int"),
        Encoding("float", "f", "double", "num"),
        Encoding("decimal", "n", "decimal(38,18)", "num"),
        Encoding("bool", "b", "boolean", None),
        Encoding("time", "d", "timestamp", "int"),
        Encoding("interval", "v", "struct<lower:bigint,upper:bigint>", "int"),
        Encoding("duration", "u", "bigint", "int"),
        Encoding("bytes", "x", "binary", None),
    )
}
_USER: dict[str, Encoding] = {}


def register(encoding: Encoding) -> Encoding:
    """Adds an encoding of the user's own; its letter must be free."""
    if any(encoding.letter == e.letter or encoding.name == e.name for e in (*ENCODINGS.values(), *_USER.values())):
        raise ValueError(f"encoding {encoding.name} or its letter is taken")
    _USER[encoding.name] = encoding
    return encoding


def encoding(name: str) -> Encoding:
    try:
        return ENCODINGS.get(name) or _USER[name]
    except KeyError:
        raise ValueError(f"no encoding {name}") from None


def of_spark(kind: str) -> Encoding:
    """The encoding of a Spark type by its simple string."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return ENCODINGS["int"]
    if kind in ("float", "double"):
        return ENCODINGS["float"]
    if kind.startswith("decimal"):
        return ENCODINGS["decimal"]
    if kind.startswith("timestamp") or kind == "date":
        return ENCODINGS["time"]
    return ENCODINGS[{"string": "text", "boolean": "bool", "binary": "bytes"}[kind]]


@dataclass(frozen=True)
class Id:
    """A constant entity id in a pattern."""

    value: str


def constant_key(value: object) -> str:
    """Key of a Python constant: Id, bool, int, float, Decimal, str, bytes, date or datetime (UTC if naive)."""
    if isinstance(value, Id):
        return value.value
    if isinstance(value, bool):
        return f"=b:{str(value).lower()}"
    if isinstance(value, int):
        return f"=i:{value}"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return "=f:" + {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(value)]
        return "=f:" + _java_double(value)
    if isinstance(value, Decimal):
        return f"=n:{value.quantize(Decimal(1).scaleb(-18)):f}"
    if isinstance(value, bytes):
        return f"=x:{value.hex().upper()}"
    if isinstance(value, dt.datetime):
        at = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        return f"=d:{(at - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)}"
    if isinstance(value, dt.date):
        return constant_key(dt.datetime(value.year, value.month, value.day))
    if isinstance(value, str):
        return f"=t:{value}"
    raise TypeError(f"no encoding for {type(value).__name__}")


def _java_double(x: float) -> str:
    """A double as Spark casts it to a string: plain from 1e-3 to 1e7, else with an exponent."""
    if x == 0:
        return "0.0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    text = "".join(map(str, digits))
    point = len(text) + exponent
    head = "-" if sign else ""
    if 1e-3 <= abs(x) < 1e7:
        if point <= 0:
            return f"{head}0.{'0' * -point}{text}"
        if point >= len(text):
            return f"{head}{text}{'0' * (point - len(text))}.0"
        return f"{head}{text[:point]}.{text[point:]}"
    return f"{head}{text[0]}.{text[1:] or '0'}E{point - 1}"
