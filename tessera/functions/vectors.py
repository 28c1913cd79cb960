"""Vector arithmetic as Columns; arrays of numbers, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms are held above this, so a zero vector scores 0 and stays a candidate.
LEAST_NORM = 1e-12
METRICS = ("dot", "cosine", "euclidean")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    least = F.lit(LEAST_NORM)
    return dot(a, b) / F.greatest(norm(b), least) / F.greatest(norm(a), least)


def euclidean(a: Column, b: Column) -> Column:
    """Negated distance: larger is nearer, as with the other metrics."""
    return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def score(metric: str, a: Column, b: Column) -> Column:
    return {"dot": dot, "cosine": cosine, "euclidean": euclidean}[metric](a, b)


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))


def tokens_of(v: Column, width: int, count: int) -> Column:
    """A flat vector cut into ``count`` token vectors of ``width``."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(v, i * width + 1, width))


def maxsim(query: Column, doc: Column, metric: str = "dot") -> Column:
    """Sum over query tokens of the best token of the document; null where either side has no token."""
    q, d = (query, doc) if metric == "dot" else (F.transform(query, _clamped), F.transform(doc, _clamped))
    total = F.aggregate(F.transform(q, lambda a: F.array_max(F.transform(d, lambda b: dot(a, b)))), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(query) > 0) & (F.size(doc) > 0), total)


def _clamped(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(LEAST_NORM))
    return F.transform(a, lambda x: x / n)


def pooled(tokens: Column, how: str, unit: bool = False) -> Column:
    """Token vectors to one: mean, max, cls (first) or last; null without tokens."""
    first = F.element_at(tokens, 1)
    if how == "cls":
        out = first
    elif how == "last":
        out = F.element_at(tokens, -1)
    elif how == "max":
        out = F.aggregate(tokens, first, lambda s, t: F.zip_with(s, t, lambda x, y: F.greatest(x, y)))
    elif how == "mean":
        total = F.aggregate(tokens, F.transform(first, lambda x: x * 0), lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
        out = F.transform(total, lambda x: x / F.size(tokens))
    else:
        raise ValueError(f"unknown pooling {how!r}")
    out = normalised(out) if unit else out
    return F.when(F.size(tokens) > 0, out)
