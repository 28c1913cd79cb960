"""Points in time as microseconds since 1970, from the formats a field may be declared to have.

``rfc3339`` (texts with or without an offset, without one UTC; dates; timestamps), ``epoch_s``, ``epoch_ms``, ``epoch_us``, or
a pattern with ``%`` signs. A text that does not fit is an error, a null stays null.
"""

from __future__ import annotations

import math
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StringType

DEFAULT = "rfc3339"
#: Microseconds of a unit. Fixed values.
UNITS = {"epoch_s": 1_000_000, "epoch_ms": 1_000, "epoch_us": 1}
#: What the signs of a pattern are in Spark's datetime patterns. Fixed values.
SIGNS = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "j": "DDD", "z": "xx", "%": "%"}


def declared(fields: list[str] | tuple[str, ...] | dict[str, str | None] | None) -> dict[str, str]:
    """Date fields with their formats; a field without one has the default."""
    if not fields:
        return {}
    return {f: (fmt or DEFAULT) for f, fmt in fields.items()} if isinstance(fields, dict) else dict.fromkeys(fields, DEFAULT)


def spark_pattern(pattern: str) -> str:
    out, literal = [], ""
    at = 0
    while at < len(pattern):
        c = pattern[at]
        if c == "%" and at + 1 < len(pattern) and pattern[at + 1] != "%":
            if pattern[at + 1] not in SIGNS:
                raise ValueError(f"unknown sign %{pattern[at + 1]} in date pattern {pattern!r}")
            out += [f"'{literal}'" if literal else "", SIGNS[pattern[at + 1]]]
            literal, at = "", at + 2
            continue
        at += 2 if c == "%" else 1
        literal += "''" if c == "'" else c
    return "".join([*out, f"'{literal}'" if literal else ""])


def canonical(text: Column) -> Column:
    """A date text as RFC 3339: a space or t before the time becomes T, a bare date is midnight, no offset is UTC, and an offset
    of hours only gets its minutes."""
    t = F.regexp_replace(F.trim(text), r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00Z")
    t = F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})[ tT]", "$1T")
    t = F.regexp_replace(t, r"z$", "Z")
    t = F.regexp_replace(t, r"^([^T]+T[^+\-Z]+)$", "$1Z")
    return F.regexp_replace(t, r"^([^T]+T[^+\-Z]+[+\-]\d{2})$", "$1:00")


def micros(value: Column, kind: DataType | None = None, fmt: str = DEFAULT) -> Column:
    """Microseconds since 1970 of a column of the format."""
    if fmt == "epoch_us":
        return value.cast("long")
    if fmt in UNITS:
        return F.rint(value.cast("double") * F.lit(float(UNITS[fmt]))).cast("long")
    if "%" in fmt:
        return F.unix_micros(F.to_timestamp(value, spark_pattern(fmt)))
    if fmt != DEFAULT:
        raise ValueError(f"unknown date format {fmt!r}")
    if isinstance(kind, NumericType):
        raise ValueError("a numeric date field needs a format epoch_s, epoch_ms or epoch_us")
    return F.unix_micros((canonical(value) if kind is None or isinstance(kind, StringType) else value).cast("timestamp"))


def literal_micros(value: str | float, fmt: str = DEFAULT) -> int:
    """A bound in a filter. Numbers are in the unit of the field, and microseconds where the field holds texts."""
    if not isinstance(value, str):
        if not math.isfinite(value):
            raise ValueError(f"{value!r} is no point in time")
        return round(value * UNITS[fmt]) if UNITS.get(fmt, 1) != 1 else int(value)
    if fmt in UNITS:
        return literal_micros(int(value) if value.lstrip("+-").isdigit() else float(value), fmt)
    when = datetime.strptime(value, fmt) if "%" in fmt else datetime.fromisoformat(value.strip())
    when = when if when.tzinfo else when.replace(tzinfo=UTC)
    past = when - datetime(1970, 1, 1, tzinfo=UTC)
    return (past.days * 86_400 + past.seconds) * 1_000_000 + past.microseconds
