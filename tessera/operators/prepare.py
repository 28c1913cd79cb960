"""From rows to embedding inputs and points: splitting, empty inputs, distribution of work, batches, upserts, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import blank, rendered, windows
from tessera.operators.quantiles import interpolated, running_counts
from tessera.sources.scratch import stored

POLICIES = ("skip", "null", "error")


def render(rows: DataFrame, templates: dict[str, str], exclude: list[str] | None = None) -> DataFrame:
    """Rendered columns from the whole row, then exclusion."""
    out = rows.withColumns({n: rendered(t, rows.columns) for n, t in templates.items()}) if templates else rows
    missing = set(exclude or []) - set(out.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)} to exclude")
    return out.drop(*(exclude or []))


def split_texts(rows: DataFrame, text: str, size: int, overlap: int = 0) -> DataFrame:
    """A row for each window of the text: the other columns, chunk (from 0), start, piece. Null texts give none."""
    return rows.filter(F.col(text).isNotNull()).select(*[c for c in rows.columns if c != text], F.posexplode(windows(F.col(text), size, overlap)).alias("chunk", "x")).select("*", "x.start", "x.piece").drop("x")


def with_empty_policy(rows: DataFrame, groups: dict[str, list[str]], policy: str = "skip") -> DataFrame:
    """Rows with a flag ``<group>_empty`` for each input group; a group is empty if all its columns are.

    skip: rows with any empty group go. null: they stay, but rows with every group empty go. error: the first one fails the job.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy has to be one of {POLICIES}")
    empty = {g: _all([blank(F.col(c)) for c in columns]) for g, columns in groups.items()}
    flagged = rows.withColumns({f"{g}_empty": e for g, e in empty.items()})
    flags = [F.col(f"{g}_empty") for g in groups]
    if policy == "skip":
        return flagged.filter(~_any(flags))
    if policy == "null":
        return flagged.filter(~_all(flags))
    return flagged.filter(F.when(_any(flags), F.raise_error(F.lit("empty input"))).otherwise(F.lit(True)))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def numbered(points: DataFrame, key: str, order: list[str]) -> DataFrame:
    """place: the number of a row within its key, from 0.

    Rows are put in order by ranges of (key, order), so a key that holds most rows is spread over as many tasks as it fills; what a
    task has to know of the others is one count for each key and task.
    """
    names = points.columns
    sorted_ = points.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__m", F.monotonically_increasing_id())
    rows = stored(sorted_.withColumns({"__task": F.shiftright("__m", 33), "__at": F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    parts = rows.groupBy(F.col(key).alias("__k"), F.col("__task").alias("__t")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__k").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("__before", before)
    met = rows.join(parts, rows[key].eqNullSafe(parts["__k"]) & (rows["__task"] == parts["__t"]))
    return met.select(*names, (F.col("__at") - F.col("__first") + F.col("__before")).alias("place"))


def batches(points: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """batch: a number within the key, at most ``size`` rows to each, keys never mixed."""
    return numbered(points, key, order).withColumn("batch", F.floor(F.col("place") / size)).drop("place")


def upserted(log: DataFrame, identifier: str, sequence: list[str]) -> DataFrame:
    """The last write of each identifier."""
    columns = [c for c in log.columns if c != identifier]
    return log.groupBy(identifier).agg(F.max_by(F.struct(*columns), F.struct(*sequence)).alias("x")).select(identifier, "x.*")


def not_loaded(points: DataFrame, loaded: DataFrame, identifier: str) -> DataFrame:
    """Points that a store does not have yet, for resuming."""
    return points.join(loaded.select(identifier).distinct(), identifier, "left_anti")


def strided(files: DataFrame, order: str, ranks: int) -> DataFrame:
    """File i goes to rank i mod ranks. ``files`` is a listing, a row for each file."""
    return files.withColumn("part", ((F.row_number().over(Window.orderBy(order)) - 1) % ranks).cast("int"))


def contiguous(files: DataFrame, order: str, ranks: int) -> DataFrame:
    """Runs of files in order; the first ones are longer by one where it does not divide."""
    return files.withColumn("part", (F.ntile(ranks).over(Window.orderBy(order)) - 1).cast("int"))


def row_windows(total: int, ranks: int) -> list[tuple[int, int]]:
    """(offset, limit) of each rank: equal shares rounded up, what is left for the last, never below 0."""
    share = -(-total // ranks)
    return [(share * r, max(0, min(share, total - share * r))) for r in range(ranks)]


def files_in_window(files: DataFrame, order: str, rows: str, offset: int, limit: int) -> DataFrame:
    """Files that overlap rows [offset, offset + limit) of the concatenation; file_start is a file's first row."""
    running = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("file_start", F.coalesce(F.sum(rows).over(running), F.lit(0)))
    return placed.filter((F.col("file_start") < offset + limit) & (F.col("file_start") + F.col(rows) > offset))


def length_stats(values: DataFrame, length: str) -> DataFrame:
    """n, mean, median, std (population), p95, p99 (interpolated), longest, and the log-normal fit mu, sigma of positive lengths.

    Lengths are counted once; all else follows from one row for each different length.
    """
    counts = stored(running_counts(values.select(F.col(length).alias("length")), "length", []), "lengths")
    length = "length"
    x, log, n = F.col(length).cast("double"), F.when(F.col(length) > 0, F.log(F.col(length).cast("double"))), F.col("n")
    logged = F.sum(F.when(log.isNotNull(), n))
    means = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__n"), (F.sum(x * n) / F.sum(n)).alias("mean"), (F.sum(log * n) / logged).alias("mu"), F.max(length).alias("longest"))
    about = counts.crossJoin(F.broadcast(means))  # one row
    square = lambda d, of: F.sqrt(F.sum(d * d * n) / of)
    spread = about.agg(square(x - F.col("mean"), F.sum(n)).alias("std"), square(log - F.col("mu"), logged).alias("sigma"))
    parts = interpolated(counts, length, {"median": 0.5, "p95": 0.95, "p99": 0.99}, [])
    return means.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(parts)).select(F.col("__n").alias("n"), "mean", "median", "std", "p95", "p99", "longest", "mu", "sigma")  # one row each


def lognormal_gap(values: DataFrame, length: str) -> DataFrame:
    """mu, sigma, ks: log-normal fit of positive lengths and its Kolmogorov-Smirnov statistic, the largest gap between the fitted
    and the observed distribution. Lengths are counted before they are put in order, so one row for each different length is."""
    counts = values.filter(F.col(length) > 0).groupBy(F.col(length).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    log = F.log("x")
    total = F.sum("n")
    fit = counts.agg(total.alias("n_all"), (F.sum(F.col("n") * log) / total).alias("mu"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("n") * log * log) / total - F.pow(F.sum(F.col("n") * log) / total, 2))).alias("sigma"))
    upto = F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.withColumn("upto", upto).crossJoin(F.broadcast(fit))  # one row
    # the normal distribution function by formula 7.1.26 of Abramowitz and Stegun, right to 1.5e-7
    z = (log - F.col("mu")) / F.greatest("sigma", F.lit(1e-300)) / F.lit(2**0.5)
    t = 1 / (1 + F.lit(0.3275911) * F.abs(z))
    tail = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429))))) * F.exp(-z * z)
    below = (1 + F.signum(z) * (1 - tail)) / 2
    gap = F.greatest(F.abs(below - F.col("upto") / F.col("n_all")), F.abs(below - (F.col("upto") - F.col("n")) / F.col("n_all")))
    return placed.agg(F.first("mu").alias("mu"), F.first("sigma").alias("sigma"), F.max(gap).alias("ks"))


def combined(rates: list[Column]) -> Column:
    """Texts a second of passes one after the other."""
    total = 1 / rates[0]
    for r in rates[1:]:
        total = total + 1 / r
    return 1 / total


def padding(values: DataFrame, length: str, batch: Column) -> DataFrame:
    """efficiency: mean over batches of the sum of lengths over the longest times the count."""
    per = values.groupBy(batch.alias("b")).agg((F.sum(length) / (F.max(length) * F.count(length))).alias("e"))
    return per.agg(F.avg("e").alias("efficiency"), F.count(F.lit(1)).alias("batches"))


def sampled_padding(values: DataFrame, length: str, key: str, size: int, batches: int, seed: int = 42) -> DataFrame:
    """As ``padding`` over at most ``batches`` batches of about ``size`` rows, drawn by a hash of ``key`` and ``seed``: the same in every run."""
    total = values.count()
    groups = max(1, -(-total // size))
    batch = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(groups))
    return padding(values.filter(batch < batches), length, batch)


def throughput(tflops: Column, parameters: Column, efficiency: Column, mean_tokens: Column) -> Column:
    """Texts a second of one pass."""
    return tflops * 1e12 / (2 * parameters) * efficiency / mean_tokens


def cost(rows: Column, rate: Column, price: Column, margin: float = 1.2) -> Column:
    """Price of the hours that ``rows`` take at ``rate`` a second."""
    return rows / rate / 3600 * price * margin
