"""The filter language: conditions on payload columns, some of which take their values from the query row.

A filter is a dict of ``must``, ``should`` and ``must_not`` lists. A condition names a ``field`` and one of

* ``match``: a value, or a list for any of its values;
* ``range``: a dict of gt, gte, lt, lte;
* ``match_text``: a phrase, all of whose tokens have to occur;
* ``match_from_query``, ``match_text_from_query``: a column of the query; ``range_from_query``: a dict of such columns.

A null never matches, so ``must_not`` keeps it. An empty filter keeps everything. ``dates`` names fields that hold points in
time, with their formats (see ``functions.dates``): their ranges compare microseconds, and bounds are texts or numbers in the
unit of the field; ``query_dates`` are those of the query. ``strict`` also refuses an empty list of values and a range of
date and number bounds together, and ``checked_queries`` refuses nulls in columns of the query that a filter reads.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DoubleType, FloatType, IntegerType, LongType, NullType, ShortType, StringType, StructType

from tessera.functions.dates import declared, literal_micros, micros
from tessera.functions.text import has_phrase, lowered, tokens

KINDS = ("match", "range", "match_text", "match_from_query", "range_from_query", "match_text_from_query")
_WHOLE = {ByteType: 7, ShortType: 15, IntegerType: 31, LongType: 63}
_TESTS = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}


def condition(schema: StructType, spec: dict, field: Column | None = None, query: dict[str, Column] | None = None, query_schema: StructType | None = None, dates: tuple[str, ...] | dict[str, str] = (), query_dates: tuple[str, ...] | dict[str, str] | None = None, strict: bool = False) -> Column:
    """One condition as a Column that is never null."""
    name = spec["field"]
    kinds = [k for k in KINDS if k in spec]
    if len(kinds) != 1:
        raise ValueError(f"condition on {name!r} has to have exactly one of {', '.join(KINDS)}")
    kind, value = kinds[0], spec[kinds[0]]
    if name not in schema.names:
        raise ValueError(f"no column {name!r}")
    of, column = schema[name].dataType, F.col(name) if field is None else field
    formats = declared(dates)
    there = formats if query_dates is None else declared(query_dates)
    if kind.endswith("from_query"):
        asked = list(value.values()) if isinstance(value, dict) else [value]
        if missing := [c for c in asked if query_schema is None or c not in query_schema.names]:
            raise ValueError(f"the query has no columns {missing}")
    if name in formats and not kind.startswith("range"):
        raise ValueError(f"date field {name!r} takes ranges only")
    if kind == "match":
        values = value if isinstance(value, list) else [value]
        if strict and not values:
            raise ValueError(f"no value for {name!r} to match")
        found = _match(of, column, values, name)
    elif kind == "range":
        if strict and len({isinstance(v, str) for v in value.values()}) > 1:
            raise ValueError(f"range on {name!r} mixes dates and numbers")
        found = _range(of, column, value, name, formats.get(name))
    elif kind == "match_text":
        found = _phrase(column, value)
    elif kind == "match_from_query":
        other, kind_there = query[value], query_schema[value].dataType
        listed = isinstance(kind_there, ArrayType)
        own = kind_there.elementType if listed else kind_there
        if "real" in (family(of), family(own)):
            raise ValueError(f"{name!r} and query column {value!r}: fractions cannot be matched")
        if family(own) != family(of) and "null" not in (family(of), family(own)):
            raise ValueError(f"{name!r} and query column {value!r} differ in type")
        found = F.array_contains(other, column) if listed else column == other
    elif kind == "range_from_query":
        if not value or set(value) - set(_TESTS):
            raise ValueError(f"range on {name!r} needs gt, gte, lt or lte")
        if query_dates is not None and (odd := [c for c in value.values() if (c in there) != (name in formats)]):
            raise ValueError(f"of {name!r} and query columns {odd} only one side holds dates")
        time = lambda c, kind, fmt: micros(c, kind, fmt).cast("double")
        x = time(column, of, formats[name]) if name in formats else column.cast("double")
        bounds = [(_TESTS[op], time(query[c], query_schema[c].dataType, there.get(c, formats[name])) if name in formats else query[c].cast("double")) for op, c in value.items()]
        found = reduce(and_, [test(x, y) & ~F.isnan(x) & ~F.isnan(y) for test, y in bounds])
    else:
        found = has_phrase(column, query[value])
    return F.coalesce(found, F.lit(False))


def evaluate(schema: StructType, spec: dict | None, field=lambda n: F.col(n), query: dict[str, Column] | None = None, query_schema: StructType | None = None, dates: tuple[str, ...] | dict[str, str] = (), query_dates: tuple[str, ...] | dict[str, str] | None = None, strict: bool = False) -> Column | None:
    """The whole filter: all of must, any of should (if there is one), none of must_not. None where there is nothing to test."""
    parts = {k: [condition(schema, c, field(c["field"]), query, query_schema, dates, query_dates, strict) for c in (spec or {}).get(k, [])] for k in ("must", "should", "must_not")}
    tests = parts["must"] + ([reduce(or_, parts["should"])] if parts["should"] else []) + [~c for c in parts["must_not"]]
    return reduce(and_, tests) if tests else None


def checked_queries(queries: DataFrame, spec: dict) -> DataFrame:
    """The same queries; the job fails at the first null, or number that is none, in a column that the filter reads."""
    for part in spec.values():
        for c in part:
            for kind in ("match_from_query", "match_text_from_query", "range_from_query"):
                read = c.get(kind, [])
                for name in read.values() if isinstance(read, dict) else [read] if read else []:
                    fine = F.col(name).isNotNull()
                    if isinstance(queries.schema[name].dataType, (FloatType, DoubleType)):
                        fine = fine & ~F.isnan(name)
                    queries = queries.filter(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit(f"a query has no value in {name!r}"))))
    return queries


def chosen(queries: DataFrame, column: str, values: list) -> DataFrame:
    """Queries whose column, as text, is one of the values; none of them is an error."""
    kept = queries.filter(F.col(column).cast("string").isin([str(v) for v in values]))
    if kept.isEmpty():
        raise ValueError(f"no query has {column!r} among {values}")
    return kept


def family(kind) -> str:
    """What values of a type may be matched with."""
    if type(kind) in _WHOLE:
        return "whole"
    for name, types in (("null", NullType), ("text", StringType), ("flag", BooleanType), ("real", (FloatType, DoubleType))):
        if isinstance(kind, types):
            return name
    raise ValueError(f"columns of type {kind.simpleString()} cannot be matched")


def _match(of, column: Column, values: list, name: str) -> Column:
    kind = family(of)
    fits = {"text": lambda v: isinstance(v, str), "flag": lambda v: isinstance(v, bool)}.get(kind, lambda v: isinstance(v, (int, float)) and not isinstance(v, bool))
    if not all(fits(v) for v in values):
        raise ValueError(f"values for {name!r} do not fit its type")
    if kind == "whole":  # a fraction, or a number out of range, equals no whole number
        limit = 1 << _WHOLE[type(of)]
        values = [int(v) for v in values if math.isfinite(v) and v == int(v) and -limit <= v < limit]
    return column.isin(values) if values else F.lit(False)


def _range(of, column: Column, bounds: dict, name: str, date: str | None) -> Column:
    if not bounds or set(bounds) - set(_TESTS):
        raise ValueError(f"range on {name!r} needs gt, gte, lt or lte")
    tests = []
    for op, v in bounds.items():
        if date:
            tests.append(_TESTS[op](micros(column, of, date), F.lit(literal_micros(v, date))))
        elif isinstance(v, str):
            raise ValueError(f"{name!r} is no date field")
        elif math.isnan(v):
            return F.lit(False)
        elif family(of) == "whole":
            tests.append(_whole_bound(column, op, v, 1 << _WHOLE[type(of)]))
        else:
            tests.append(_TESTS[op](column, F.lit(float(v))) & ~F.isnan(column))
    return reduce(and_, tests)


def _whole_bound(column: Column, op: str, v: float, limit: int) -> Column:
    """A bound on whole numbers, itself made whole, so that no number is rounded."""
    up = op in ("gt", "gte")
    if math.isinf(v):
        return column.isNotNull() if (v < 0) == up else F.lit(False)
    least = math.floor(v) + 1 if op == "gt" else math.ceil(v) if op == "gte" else None
    most = math.ceil(v) - 1 if op == "lt" else math.floor(v) if op == "lte" else None
    if up:
        return column.isNotNull() if least <= -limit else F.lit(False) if least >= limit else column >= F.lit(least)
    return column.isNotNull() if most >= limit - 1 else F.lit(False) if most < -limit else column <= F.lit(most)


def _phrase(column: Column, phrase: str) -> Column:
    if not any(c.isalnum() for c in phrase):
        raise ValueError("match_text needs a phrase with a token")
    words = sorted(set(re.findall(r"[^\W_]+", phrase.replace("\u03a3", "\u03c3").replace("\u0130", "i").lower())))
    wanted = F.array_distinct(tokens(F.lit(phrase)))
    # a text without one of them as letters somewhere needs no tokens
    return reduce(and_, [F.contains(lowered(column), F.lit(w)) for w in words if w.isascii()] or [F.lit(True)]) & (F.size(F.array_except(wanted, tokens(column))) == 0)
