"""Retrieval quality and load metrics over long tables of ranked results (query_id, rank, vec_id, score)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.quantiles import discrete

#: Scores count as tied within this, relative to 1 + |cutoff|.
EPSILON = 5e-6


def default_persistence(k: int) -> float:
    return min(0.01 ** (1 / k), 0.999999)


def tied(a: Column, b: Column, epsilon: float = EPSILON) -> Column:
    return F.abs(a - b) <= F.lit(epsilon) * (1 + F.abs(b))


def _distinct(found: DataFrame, k: int) -> DataFrame:
    """The first place of each id in each list, among the first k places; d: the rank among distinct ids."""
    first = found.filter(F.col("rank") <= k).groupBy("query_id", "vec_id").agg(F.min(F.struct("rank", "score")).alias("x")).select("query_id", "vec_id", "x.rank", "x.score")
    return first.withColumn("d", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def recall(found: DataFrame, truth: DataFrame, k: int, epsilon: float = EPSILON) -> DataFrame:
    """query_id, hits, near_ties, missing, denom, recall, recall_tolerant: a row for each query with a ground truth.

    denom is k if the truth has k places, else its distinct ids. A near tie is a returned id outside the truth whose score ties
    the truth's last; ``missing`` counts those that score above it.
    """
    gt = truth.filter(F.col("rank") <= k)
    sizes = gt.groupBy("query_id").agg(F.count(F.lit(1)).alias("places"), F.countDistinct("vec_id").alias("ids"), F.min("score").alias("cutoff"))
    ids = gt.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct()
    judged = _distinct(found, k).join(ids, ["query_id", "vec_id"], "left").join(sizes, "query_id")
    near = F.col("hit").isNull() & tied(F.col("score"), F.col("cutoff"), epsilon)
    above = F.col("hit").isNull() & ~tied(F.col("score"), F.col("cutoff"), epsilon) & (F.col("score") > F.col("cutoff"))
    counts = judged.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count(F.when(near, 1)).alias("near_ties"), F.count(F.when(above, 1)).alias("missing"))
    out = sizes.join(counts, "query_id", "left").fillna(0, ["hits", "near_ties", "missing"])
    denom = F.when(F.col("places") >= k, F.lit(k)).otherwise(F.col("ids")).cast("long")
    return out.select("query_id", "hits", "near_ties", "missing", denom.alias("denom"), (F.col("hits") / denom).alias("recall"), F.least(F.lit(1.0), (F.col("hits") + F.col("near_ties")) / denom).alias("recall_tolerant"))


def rank_biased_overlap(found: DataFrame, truth: DataFrame, k: int, p: float | None = None) -> DataFrame:
    """query_id, depth, overlap, rbo, rbo_norm, rbo_min, rbo_res, rbo_ext (Webber, Moffat and Zobel, TOIS 2010).

    Lists are cut at depth = min(distinct ids of the truth, k). An id counts from the depth at which both lists have it.
    """
    p = default_persistence(k) if p is None else p
    a, b = _distinct(found, k), _distinct(truth, k)
    depth = b.groupBy("query_id").agg(F.max("d").alias("depth"))
    both = a.select("query_id", "vec_id", F.col("d").alias("da")).join(b.select("query_id", "vec_id", F.col("d").alias("db")), ["query_id", "vec_id"])
    starts = both.join(depth, "query_id").withColumn("at", F.greatest("da", "db")).filter("at <= depth").groupBy("query_id", "at").agg(F.count(F.lit(1)).alias("n"))
    grid = depth.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("depth")))).join(starts, ["query_id", "at"], "left")
    running = Window.partitionBy("query_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = grid.withColumn("x", F.sum(F.coalesce("n", F.lit(0))).over(running))
    d = F.col("at").cast("double")
    sums = grid.groupBy("query_id", "depth").agg(
        F.sum(F.pow(F.lit(p), d - 1) * F.col("x") / d).alias("s"), F.max("x").alias("overlap"), F.sum(F.pow(F.lit(p), d) / d).alias("h"), F.sum(F.pow(F.lit(p), d) / d * F.col("x")).alias("sx")
    )
    q, n, x = 1 - p, F.col("depth").cast("double"), F.col("overlap").cast("double")
    tail = F.lit(-1.0) * F.log(F.lit(q)) - F.col("h")  # sum of p^d / d beyond the depth
    least = F.lit(q / p) * (F.col("sx") + x * tail)
    whole = F.pow(F.lit(p), n)
    extended = F.lit(q) * F.col("s") + whole * x / n
    rbo = F.lit(q) * F.col("s")
    # beyond the depth each place can add two ids to the overlap, until depth f, from which on all agree
    f = 2 * F.col("depth") - F.col("overlap").cast("int")
    beyond = F.when(f > F.col("depth"), F.sequence(F.col("depth") + 1, f)).otherwise(F.array().cast("array<int>"))
    term = lambda e: F.pow(F.lit(p), e.cast("double")) / e
    climb = F.aggregate(beyond, F.lit(0.0), lambda t, e: t + term(e) * 2 * (e - n))
    rest = tail - F.aggregate(beyond, F.lit(0.0), lambda t, e: t + term(e))
    residual = F.lit(q / p) * (climb + F.pow(F.lit(p), f.cast("double") + 1) / F.lit(q) - x * rest)
    return sums.select("query_id", "depth", F.col("overlap").cast("long").alias("overlap"), rbo.alias("rbo"), F.least(F.lit(1.0), rbo / (1 - whole)).alias("rbo_norm"), least.alias("rbo_min"), residual.alias("rbo_res"), extended.alias("rbo_ext"))


def tie_stats(scored: DataFrame, truth: DataFrame, k: int, epsilon: float = EPSILON, weight: str | None = None) -> DataFrame:
    """mean_ties, max_ties, tied_share, n over queries: how many candidates tie the k-th score. With ``weight`` a row of ``scored`` stands
    for as many candidates of one score."""
    cut = truth.filter(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))
    near = tied(F.col("score"), F.col("cutoff"), epsilon)
    times = F.count(F.when(near, 1)) if weight is None else F.coalesce(F.sum(F.when(near, F.col(weight))), F.lit(0))
    ties = scored.join(cut, "query_id").groupBy("query_id").agg(times.alias("ties"))
    return ties.agg(F.avg("ties").alias("mean_ties"), F.max("ties").alias("max_ties"), F.avg((F.col("ties") > 1).cast("double")).alias("tied_share"), F.count(F.lit(1)).alias("n"))


def latencies(samples: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, n, mean, p50, p95, p99 (nearest rank), slowest; zeros where a group has no value."""
    sums = samples.groupBy(*keys).agg(F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.max(value), F.lit(0.0)).alias("slowest"))
    ranks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = discrete(samples.select(*keys, F.col(value).alias("__value")), "__value", ranks, list(keys))
    if keys:
        found = found.withColumnsRenamed({k: f"__{k}" for k in keys})
        same = reduce(and_, [sums[k].eqNullSafe(found[f"__{k}"]) for k in keys])
        met = sums.join(found, same, "left")
    else:
        met = sums.crossJoin(F.broadcast(found))  # one row
    return met.select(*keys, "n", "mean", *[F.coalesce(r, F.lit(0.0)).alias(r) for r in ranks], "slowest")


def rates(firings: DataFrame, at: str, ok: Column, every_micros: int) -> DataFrame:
    """slot (number of the stretch of time), n, errors, per_second over firings with a time ``at`` in microseconds."""
    slot = F.floor(F.col(at) / F.lit(every_micros)).cast("long")
    out = firings.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~ok, 1)).alias("errors"))
    return out.withColumn("per_second", F.col("n") / F.lit(every_micros / 1e6))


def first_successes(firings: DataFrame, query: str, at: list[str], ok: Column) -> DataFrame:
    """The first successful firing of each query: the one that is scored."""
    order = Window.partitionBy(query).orderBy(*at)
    return firings.filter(ok).withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def bucket_means(values: DataFrame, value: str, short: Column) -> DataFrame:
    """bucket (full, short, total), n, mean: mean is null for an empty bucket."""
    parts = values.agg(*[F.struct(F.lit(name).alias("bucket"), F.count(F.when(test, F.col(value))).alias("n"), F.avg(F.when(test, F.col(value))).alias("mean")).alias(name) for name, test in (("full", ~short), ("short", short), ("total", F.lit(True)))])
    return parts.select(F.explode(F.array("full", "short", "total")).alias("x")).select("x.*")
