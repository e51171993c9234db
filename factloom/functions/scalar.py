"""Scalar functions on decoded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strlen(text: Column) -> Column:
    return F.char_length(text)


def strbefore(text: Column, needle: str) -> Column:
    """What stands before the first ``needle``; empty if it doesn't occur."""
    return F.when(F.instr(text, needle) > 0, F.substring_index(text, needle, 1)).otherwise(F.lit("")) if needle else F.lit("")


def strafter(text: Column, needle: str) -> Column:
    """What stands after the first ``needle``; empty if it doesn't occur."""
    if not needle:
        return text
    at = F.instr(text, needle)
    return F.when(at > 0, text.substr(at + len(needle), F.length(text))).otherwise(F.lit(""))


def strstarts(text: Column, prefix: str) -> Column:
    return text.startswith(prefix).cast("int")


def strends(text: Column, suffix: str) -> Column:
    return text.endswith(suffix).cast("int")


def contains(text: Column, needle: str | Column) -> Column:
    return F.contains(text, needle if isinstance(needle, Column) else F.lit(needle))


def regex(text: Column, expression: str) -> Column:
    return text.rlike(expression)


def year(at: Column) -> Column:
    return F.year(at)


def month(at: Column) -> Column:
    return F.month(at)


def day(at: Column) -> Column:
    return F.dayofmonth(at)


# Closed intervals of nanoseconds, struct(lower, upper).


def interval(lower: Column, upper: Column) -> Column:
    """An interval; null where the ends are reversed."""
    return F.when(lower <= upper, F.struct(lower.cast("bigint").alias("lower"), upper.cast("bigint").alias("upper")))


def midpoint(x: Column) -> Column:
    """The middle, rounded down; exact also where the sum of the ends would overflow."""
    return (x["lower"].cast("decimal(38,0)") + F.floor((x["upper"].cast("decimal(38,0)") - x["lower"].cast("decimal(38,0)")) / 2)).cast("bigint")


def width(x: Column) -> Column:
    return x["upper"].cast("decimal(38,0)") - x["lower"].cast("decimal(38,0)")


_DURATION = r"^(-?)P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,9}))?S)?)?$"


def parse_duration(text: Column) -> Column:
    """Nanoseconds of an xsd duration of days and smaller units; null for others (a month has no fixed length)."""
    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, _DURATION, i), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))
    fraction = F.rpad(F.regexp_extract(text, _DURATION, 6), 9, "0").try_cast("bigint")
    seconds = F.try_add(F.try_multiply(part(2), F.lit(86400)), part(3) * 3600 + part(4) * 60 + part(5))
    total = F.try_add(F.try_multiply(seconds, F.lit(10**9)), F.coalesce(fraction, F.lit(0).cast("bigint")))
    some = text.rlike(_DURATION) & text.rlike(r"\d[DHMS]") & ~text.rlike(r"T$")
    return F.when(some, F.when(F.regexp_extract(text, _DURATION, 1) == "-", -total).otherwise(total))


def parse_time(text: Column, kind: str | Column) -> Column:
    """Interval of nanoseconds, since 1970 in UTC, that an xsd dateTime, date, gYearMonth or gYear covers; null if it
    can't be read, or for another kind. A value without a time zone is taken as UTC. Precision is microseconds."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    zone = F.regexp_extract(text, r"(Z|[+-]\d\d:\d\d)$", 1)
    body = text.substr(F.lit(1), F.length(text) - F.length(zone))
    months, days = F.when(kind == "gYear", 12).when(kind == "gYearMonth", 1).otherwise(0), F.when(kind == "date", 1).otherwise(0)
    shape = F.when(kind == "date", r"^\d{4}-\d\d-\d\d$").when(kind == "gYearMonth", r"^\d{4}-\d\d$").when(kind == "gYear", r"^\d{4}$").when(kind == "dateTime", r"^-?\d{4,}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?$")
    first = F.concat(F.rpad(body, 10, "-01-01"), F.lit("T00:00:00"))  # 2020 and 2020-05 are filled up to their first day
    stamp = F.concat(F.when(kind == "dateTime", body).otherwise(first), F.when(zone == "", "Z").otherwise(zone)).try_cast("timestamp")
    lower = F.when(F.rlike(body, shape), F.try_multiply(F.unix_micros(stamp), F.lit(1000)))
    # whole days of the calendar, so that the zone plays no part in the length
    day = F.substring(first, 1, 10).try_cast("date")
    length = F.datediff(F.date_add(F.add_months(day, months), days), day).cast("bigint") * 86_400_000_000_000
    upper = F.when(kind == "dateTime", lower).otherwise(F.try_add(lower, length - 1))
    return F.when(lower.isNotNull() & upper.isNotNull(), F.struct(lower.alias("lower"), upper.alias("upper")))


# Exact rationals, struct(num, den) with den > 0, and money on top of them.

DEC = "decimal(38,0)"


def rational(num: Column, den: Column) -> Column:
    """num/den as a struct; null where den is 0. The sign goes to the numerator; terms aren't reduced."""
    n, d = num.cast(DEC), den.cast(DEC)
    return F.when(d > 0, F.struct(n.alias("num"), d.alias("den"))).when(d < 0, F.struct((-n).cast(DEC).alias("num"), (-d).cast(DEC).alias("den")))


def rational_key(x: Column) -> Column:
    """A struct that sorts as the rational does, to the precision of decimal division (whole part, then fraction);
    ``compare`` is exact."""
    whole = F.floor(x["num"] / x["den"])
    return F.struct(whole.cast(DEC).alias("whole"), ((x["num"] - whole * x["den"]).cast("decimal(38,18)") / x["den"]).alias("part"))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: exact comparison by cross products; null where one overflows 38 digits."""
    left, right = F.try_multiply(a["num"], b["den"]), F.try_multiply(b["num"], a["den"])
    return F.signum(F.try_subtract(left, right)).cast("int")


def money_add(a: Column, b: Column) -> Column:
    """Sum of two amounts of decimal(38,s); an overflow is an error."""
    return F.coalesce(F.try_add(a, b), F.raise_error(F.lit("amount overflow")).cast("decimal(38,18)"))


def money_sub(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_subtract(a, b), F.raise_error(F.lit("amount overflow")).cast("decimal(38,18)"))


def money_mul(a: Column, times: Column) -> Column:
    """Amount times a whole number."""
    return F.coalesce(F.try_multiply(a.cast("decimal(28,6)"), times.cast("decimal(9,0)")), F.raise_error(F.lit("amount overflow")).cast("decimal(38,6)"))


def money_mul_ratio(a: Column, num: int, den: int, digits: int = 2) -> Column:
    """Amount times num/den if that has at most ``digits`` decimals, else an error."""
    exact = (a.cast("decimal(28,6)") * num / den).cast("decimal(38,12)")
    rounded = F.round(exact, digits)
    return F.when(exact == rounded, rounded).otherwise(F.raise_error(F.lit("amount inexact")).cast("decimal(38,12)"))


def to_minor(amount: Column, digits: int = 2) -> Column:
    """Whole minor units (cents) of an amount; an error if there is a rest."""
    minor = amount * 10**digits
    return F.when(minor == F.floor(minor), minor.cast("bigint")).otherwise(F.raise_error(F.lit("amount inexact")).cast("bigint"))


def from_minor(minor: Column, digits: int = 2) -> Column:
    return (minor.cast("decimal(28,0)") / F.lit(10**digits).cast("decimal(10,0)")).cast("decimal(38,18)")


def digest(content: Column) -> Column:
    """SHA-256 in hexadecimal: the handle of a blob."""
    return F.sha2(content, 256)


def timestamp_distance(now: Column, then: Column, bits: int = 32) -> Column:
    """now - then on a clock that wraps at 2^bits."""
    return F.pmod(now - then, F.lit(1 << bits))


def classify(content: Column) -> Column:
    """``image``, ``pdf``, ``text`` or ``other`` of bytes, by their first bytes; image formats are tried first."""
    head = F.hex(F.substring(content, 1, 12))
    image = head.startswith("89504E470D0A1A0A") | head.startswith("FFD8FF") | head.startswith("47494638") | head.startswith("424D") | (head.startswith("52494646") & head.endswith("57454250"))
    text = F.is_valid_utf8(content.cast("string")) & ~F.contains(content.cast("string"), F.lit("\x00"))
    return F.when(image, "image").when(head.startswith("255044462D"), "pdf").when(text, "text").otherwise("other")


def tensor(dims: Column, values: Column) -> Column:
    """struct(dims, values); null where the values aren't as many as the dimensions say."""
    size = F.aggregate(dims, F.lit(1).cast("bigint"), lambda n, d: n * d)
    return F.when(size == F.size(values), F.struct(dims.alias("dims"), values.alias("values")))


def tensor_at(x: Column, *index: int) -> Column:
    """The element at an index of a tensor in row-major order; null outside."""
    at = F.lit(0).cast("bigint")
    inside = F.size(x["dims"]) == len(index)
    for k, i in enumerate(index):
        at = at * F.try_element_at(x["dims"], F.lit(k + 1)) + i
        inside = inside & (F.lit(i) < F.try_element_at(x["dims"], F.lit(k + 1)))
    return F.when(inside, F.try_element_at(x["values"], (at + 1).cast("int")))


def time_prefixed_id(at: Column, key: Column) -> Column:
    """An id of 32 hexadecimal digits: four bytes of the time in milliseconds, which wraps, and a hash of the key. Equal
    input has an equal id, so reruns agree."""
    ms = F.pmod(F.unix_millis(at), F.lit(1 << 32))
    return F.concat(F.lower(F.lpad(F.hex(ms), 8, "0")), F.substring(F.sha2(key.cast("string"), 256), 1, 24))


def counter_id(space: str, number: Column) -> Column:
    """An id of a namespace and a counter: the counter, exclusive-or a mask that follows from the namespace."""
    import hashlib

    mask = hashlib.sha256(space.encode()).hexdigest()
    low = number.cast("bigint").bitwiseXOR(F.lit(int(mask[16:32], 16) - (1 << 63)))
    return F.concat(F.lit(mask[:16]), F.lower(F.lpad(F.hex(low), 16, "0")))
