"""Exact quantiles of groups of any size: values are counted, put in order by ranges, and the wanted ranks are looked up.

A task holds no group: what it knows of the others is one count for each group and task. Percentiles of a sort by hash or of all
values of a group in one state would hold as many values as the group has different ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import stored


def running_counts(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """keys, value, n, before: each different value of each group, how often it occurs and how many smaller ones there are.

    Nulls do not count; NaN is above all numbers. The different values of all groups are sorted together by ranges, so one group that
    holds all rows fills as many tasks as its values need.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    order = [*keys, value]
    sorted_ = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(sorted_.withColumn("__task", F.spark_partition_id()), "counts")
    parts = rows.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__task").alias("__t")).agg(F.sum("n").alias("__n"))
    earlier = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))]).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    same = rows["__task"] == parts["__t"]
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(parts[f"__k{i}"])
    inside = Window.partitionBy("__task", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, same)
    return placed.select(*[rows[k] for k in keys], rows[value], "n", (F.col("__before") + F.col("__in")).alias("before"))


def at_ranks(running: DataFrame, value: str, keys: list[str], ranks: dict[str, Column]) -> DataFrame:
    """keys and a column for each of ``ranks``: the value at that rank (from 0) of its group. Ranks are columns over ``total``, the number of
    values of the group."""
    totals = running.groupBy(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]).agg(F.sum("n").alias("total"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__g{i}"))
    met = running.join(totals, same) if keys else running.crossJoin(F.broadcast(totals))  # one row
    here = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))
    kept = None
    for r in ranks.values():
        kept = here(r) if kept is None else kept | here(r)
    picked = met.filter(kept)  # a few rows of each group
    return picked.groupBy(*keys).agg(*[F.max(F.when(here(r), F.col(value))).alias(name) for name, r in ranks.items()])


def nearest_rank(q: float) -> Column:
    """The rank from 0 of the smallest value that a share ``q`` of the values does not exceed."""
    return F.greatest(F.ceil(F.lit(q) * F.col("total")), F.lit(1)) - 1


def discrete(values: DataFrame, value: str, quantiles: dict[str, float], keys: list[str]) -> DataFrame:
    """keys and the values at the nearest ranks; a group without a value has no row."""
    return at_ranks(running_counts(values, value, keys), value, keys, {n: nearest_rank(q) for n, q in quantiles.items()})


def interpolated(running: DataFrame, value: str, quantiles: dict[str, float], keys: list[str]) -> DataFrame:
    """keys and quantiles by linear interpolation between the values at both sides of rank q * (total - 1), from ``running_counts``."""
    ranks, columns = {}, []
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("total") - 1)
        ranks |= {f"__low_{name}": F.floor(at), f"__high_{name}": F.ceil(at)}
    totals = running.groupBy(*keys).agg(F.sum("n").alias("total"))
    found = at_ranks(running, value, keys, ranks)
    same = [f"__t{i}" for i in range(len(keys))]
    totals = totals.select(*[F.col(k).alias(s) for k, s in zip(keys, same, strict=True)], "total")
    test = F.lit(True)
    for k, s in zip(keys, same, strict=True):
        test = test & F.col(k).eqNullSafe(F.col(s))
    both = found.join(totals, test) if keys else found.crossJoin(F.broadcast(totals))  # one row
    for name, q in quantiles.items():
        at = F.lit(q) * (F.col("total") - 1)
        low, high = F.col(f"__low_{name}").cast("double"), F.col(f"__high_{name}").cast("double")
        columns.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return both.select(*keys, *columns)
