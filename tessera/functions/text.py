"""Tokens, windows, templates and identifiers as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of letters and digits.
TOKEN = r"[\p{L}\p{N}]+"


def lowered(text: Column) -> Column:
    """Lower case letter by letter: a capital sigma or a dotted capital I does not depend on what stands around it."""
    odd = F.contains(text, F.lit("\u03a3")) | F.contains(text, F.lit("\u0130"))
    return F.lower(F.when(odd, F.translate(text, "\u03a3\u0130", "\u03c3i")).otherwise(text))


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order; null stays null."""
    return F.regexp_extract_all(lowered(text), F.lit(TOKEN), F.lit(0))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Every token of the phrase is a token of the text, in any order; a phrase without tokens, or null, never matches."""
    wanted = F.array_distinct(tokens(phrase))
    return F.coalesce((F.size(wanted) > 0) & (F.size(F.array_except(wanted, tokens(text))) == 0), F.lit(False))


def windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Array of (start, piece): whole texts of up to ``size`` characters, else windows from every ``size - overlap`` characters on."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("piece")))
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(size - overlap))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.substring(text, s + 1, F.lit(size)).alias("piece")))
    return F.when(F.length(text) <= size, whole).otherwise(cut)


def rendered(template: str, columns: list[str]) -> Column:
    """``{name}`` in a template becomes the column's text, a null becomes None; doubled braces stand for themselves."""
    parts: list[Column] = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif re.fullmatch(r"\{\w+\}", piece):
            if piece[1:-1] not in columns:
                raise ValueError(f"no column {piece[1:-1]!r} for template {template!r}")
            parts.append(F.coalesce(F.col(piece[1:-1]).cast("string"), F.lit("None")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def uuid_text(hexed: Column) -> Column:
    return F.regexp_replace(hexed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def point_id(file: Column, row: Column) -> Column:
    """Stable identifier of a row of a file: MD5 of ``file:row`` written as a UUID."""
    return uuid_text(F.md5(F.concat_ws(":", file.cast("string"), row.cast("string"))))


def epoch_micros(value: Column) -> Column:
    """Microseconds since 1970 of a timestamp or a date text; a text that is no date is an error under ANSI."""
    return F.unix_micros(value.cast("timestamp"))


def blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", F.lit(True))
