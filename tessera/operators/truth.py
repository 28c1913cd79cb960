"""Ground truth: checks, ranks with ties, orientation, ties beyond the cutoff, and what depends on them.

Truth is a long table (query_id, rank from 1, vec_id, score), best first, and may be deeper than k. Results of an engine
(``found``) have the same columns. Scores are larger-is-nearer, or raw distances that rise with the rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.evaluate import EPSILON, default_persistence, tied
from tessera.sources.shipping import sound_unions

#: Ties beyond the cutoff that are kept for one query; of more, none is.
MOST_TIES = 100_000


def lists_of(truth: DataFrame) -> DataFrame:
    """query_id, ids, scores: long truth as two lists, best first."""
    rows = truth.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("x"))
    return rows.select("query_id", F.col("x.vec_id").alias("ids"), F.col("x.score").alias("scores"))


def long_of(lists: DataFrame) -> DataFrame:
    """Lists to long rows. Null lists give none."""
    return lists.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def problem(ids: str = "ids", scores: str = "scores") -> Column:
    """What is wrong with a query's truth, judged on its whole depth, or null: a score that is null or not finite, an order that
    both rises and falls, lists of different lengths. A truth without scores has nothing to check."""
    s = F.col(scores)
    pairs = F.when(F.size(s) > 1, F.transform(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.signum(F.get(s, i) - F.get(s, i - 1)))).otherwise(F.array().cast("array<double>"))
    odd = F.exists(s, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        F.when(s.isNull() | F.col(ids).isNull(), F.lit(None))
        .when(odd, "scores must be finite")
        .when(F.exists(pairs, lambda x: x > 0) & F.exists(pairs, lambda x: x < 0), "scores are not sorted best first")
        .when(F.size(s) != F.size(ids), "ids and scores differ in length")
    )


def checked(lists: DataFrame) -> DataFrame:
    """The same rows; the job fails at the first query whose truth has a problem."""
    what = problem()
    said = F.concat(F.lit("ground truth of query "), F.col("query_id").cast("string"), F.lit(": "), what)
    return lists.filter(F.when(what.isNull(), F.lit(True)).otherwise(F.raise_error(said)))


def ranks(truth: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, place, tied_place (both from 0): the distinct ids of the first k places, and the place where the run of
    equal scores begins that an id belongs to. An id without a score is a run of its own."""
    first = truth.filter(F.col("rank") <= k).groupBy("query_id", "vec_id").agg(F.min(F.struct("rank", "score")).alias("x")).select("query_id", "vec_id", "x.rank", "x.score")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1)
    run = F.min("place").over(Window.partitionBy("query_id", "score"))
    return placed.select("query_id", "vec_id", "place", F.when(F.col("score").isNull(), F.col("place")).otherwise(run).alias("tied_place"))


def cutoff_ties(truth: DataFrame, k: int, most: int = MOST_TIES) -> DataFrame:
    """query_id, vec_id, tied_place: ids beyond the k-th place whose score equals the k-th, and that are not among the first k.

    They share the run of the k-th place. A query with more than ``most`` such entries keeps none of them.
    """
    inside = ranks(truth, k)
    last = truth.filter(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"), F.col("vec_id").alias("last_id"))
    start = last.join(inside.withColumnRenamed("vec_id", "last_id"), ["query_id", "last_id"]).select("query_id", "cutoff", "tied_place")
    beyond = truth.filter(F.col("rank") > k).join(start, "query_id").filter(F.col("score") == F.col("cutoff"))
    beyond = beyond.join(inside.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
    return beyond.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).filter(F.col("n") <= most).select("query_id", "vec_id", "tied_place").distinct()


def orientation(truth: DataFrame, k: int, higher_is_better: bool = True) -> DataFrame:
    """query_id, cutoff (larger is nearer), known, comparable.

    A truth whose scores rise with the rank is negated. Where all its scores are equal the sign decides, which is a guess
    (``known`` is false): for an engine of distances a positive score has to be a raw distance. A truth that rises through scores
    of 0 or more holds distances; against an engine for which more is better the two are not comparable.
    """
    last = F.max_by("score", F.when(F.col("rank") <= k, F.col("rank")))
    per = truth.groupBy("query_id").agg(last.alias("last"), F.min_by("score", "rank").alias("first"), F.max_by("score", "rank").alias("end"), F.count("score").alias("n")).filter("n > 0")
    rising = F.when(F.col("end") > F.col("first"), True).when(F.col("end") < F.col("first"), False)
    guessed = F.lit(not higher_is_better) & (F.col("last") > 0)
    turned = F.coalesce(rising, guessed)
    comparable = ~(turned & F.lit(higher_is_better) & (F.col("last") >= 0))
    return per.select("query_id", F.when(turned, -F.col("last")).otherwise(F.col("last")).alias("cutoff"), rising.isNotNull().alias("known"), comparable.alias("comparable"))


def oriented_recall(found: DataFrame, truth: DataFrame, k: int, epsilon: float = EPSILON, higher_is_better: bool = True) -> DataFrame:
    """query_id, hits, near_ties, missing, denom, short, recall, recall_tolerant, compared for each query with a truth of one id or more.

    ``short`` says that the truth has fewer than k places; then its distinct ids are the denominator. Scores are compared as
    ``orientation`` allows; ``missing`` (scored above the cutoff, not in the truth) is counted only where orientation was read.
    """
    inside = truth.filter(F.col("rank") <= k)
    sizes = inside.groupBy("query_id").agg(F.count(F.lit(1)).alias("places"), F.countDistinct("vec_id").alias("ids"))
    ids = inside.select("query_id", "vec_id", F.lit(1).alias("hit")).distinct()
    got = found.filter(F.col("rank") <= k).groupBy("query_id", "vec_id").agg(F.min_by("score", "rank").alias("score"))
    judged = got.join(ids, ["query_id", "vec_id"], "left").join(orientation(truth, k, higher_is_better), "query_id", "left")
    own = F.col("score") if higher_is_better else -F.col("score")
    outside = F.col("hit").isNull() & F.coalesce("comparable", F.lit(False))
    near = outside & tied(own, F.col("cutoff"), epsilon)
    above = outside & F.col("known") & ~tied(own, F.col("cutoff"), epsilon) & (own > F.col("cutoff"))
    counts = judged.groupBy("query_id").agg(F.count("hit").alias("hits"), F.count(F.when(near, 1)).alias("near_ties"), F.count(F.when(above, 1)).alias("missing"), F.max(F.coalesce("comparable", F.lit(False))).alias("compared"))
    out = sizes.join(counts, "query_id", "left").fillna(0, ["hits", "near_ties", "missing"]).fillna(False, ["compared"])
    denom = F.when(F.col("places") >= k, F.lit(k)).otherwise(F.col("ids")).cast("long")
    return out.select("query_id", "hits", "near_ties", "missing", denom.alias("denom"), (F.col("places") < k).alias("short"), (F.col("hits") / denom).alias("recall"), F.least(F.lit(1.0), (F.col("hits") + F.col("near_ties")) / denom).alias("recall_tolerant"), "compared")


def overlap_tolerant(found: DataFrame, truth: DataFrame, k: int, p: float | None = None, most: int = MOST_TIES) -> DataFrame:
    """query_id, depth, overlap, rbo, rbo_tolerant: rank-biased overlap (Webber, Moffat and Zobel, TOIS 2010) cut at the depth
    min(distinct ids of the truth, k), exact and under the best order of ids that the truth scores alike.

    An id counts from the depth at which both lists hold it. The j-th returned id of a run of ties takes the run's j-th place,
    and ids that tie the k-th place from beyond the cutoff take places of its run. A repeated id counts at its first place.
    """
    sound_unions(truth.sparkSession)
    p = default_persistence(k) if p is None else p
    inside = ranks(truth, k)
    depth = inside.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("depth"))
    members = inside.unionByName(cutoff_ties(truth, k, most).withColumn("place", F.lit(None).cast("int")))
    got = found.groupBy("query_id", "vec_id").agg((F.min("rank") - 1).alias("position")).join(depth, "query_id").filter(F.col("position") < F.col("depth"))
    met = got.join(members, ["query_id", "vec_id"])
    slot = F.col("tied_place") + F.row_number().over(Window.partitionBy("query_id", "tied_place").orderBy("position")) - 1
    met = met.withColumn("slot", slot)
    n = F.col("depth")
    exact, loose = F.greatest("position", "place") + 1, F.greatest("position", "slot") + 1
    starts = met.select("query_id", F.explode(F.array(
        F.struct(F.when(F.col("place").isNotNull() & (F.col("place") < n), exact).alias("at"), F.lit(1).alias("e"), F.lit(0).alias("t")),
        F.struct(F.when((F.col("tied_place") < n) & (F.col("slot") < n), loose).alias("at"), F.lit(0).alias("e"), F.lit(1).alias("t")),
    )).alias("x")).select("query_id", "x.*").filter("at IS NOT NULL").groupBy("query_id", "at").agg(F.sum("e").alias("e"), F.sum("t").alias("t"))
    grid = depth.withColumn("at", F.explode(F.sequence(F.lit(1), n))).join(starts, ["query_id", "at"], "left")
    running = Window.partitionBy("query_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = grid.withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(running) for c in ("e", "t")})
    d = F.col("at").cast("double")
    part = lambda c: F.lit(1 - p) * F.sum(F.pow(F.lit(p), d - 1) * F.col(c) / d)
    return grid.groupBy("query_id", "depth").agg(F.max("e").alias("overlap"), part("e").alias("rbo"), part("t").alias("rbo_tolerant"))


def worst_residual(depths: DataFrame, k: int, p: float | None = None) -> DataFrame:
    """bucket (full, short), residual: the largest weight p^depth that a query's overlap left below its depth; null without a query.

    ``depths`` has the columns depth and short."""
    p = default_persistence(k) if p is None else p
    rest = F.pow(F.lit(p), F.col("depth").cast("double"))
    both = depths.agg(F.max(F.when(~F.col("short"), rest)).alias("full"), F.max(F.when(F.col("short"), rest)).alias("short"))
    return both.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("residual")) for b in ("full", "short")])).alias("x")).select("x.*")


def epsilon_for(datatype: str | None = None, quantized: bool = False) -> float:
    """Scores count as tied within this: vectors stored as 32-bit numbers keep more of a score than others. Fixed values."""
    return 5e-6 if datatype in (None, "float32") and not quantized else 2e-3


def no_tie_report(distance: str | None, quantized: bool = False, rescore: bool = True) -> str | None:
    """Why an engine's scores cannot be held against the truth's; null where they can."""
    if distance is None:
        return "the distance of the collection is unknown"
    if quantized and not rescore:
        return "scores of quantized vectors are not rescored"
    return None


def counters(answers: DataFrame, truth: DataFrame, k: int, filtered: bool = False) -> DataFrame:
    """firings, errors, timeouts, short_returns, filter_overreturn, empty_ground_truth over answers (query_id, ok, timed_out,
    returned: number of ids, null without an answer) and truth lists (query_id, ids; null ids where there is no truth).

    A short return has fewer ids than k or than the truth's distinct ids; without a truth, under a filter, nothing is expected.
    An over-return has more ids than a filtered truth of one id or more.
    """
    sizes = truth.select("query_id", F.size(F.array_distinct(F.col("ids"))).alias("ids"), F.col("ids").isNotNull().alias("known"))
    rows = answers.join(sizes, "query_id", "left")
    known = F.coalesce("known", F.lit(False))
    expected = F.when(known, F.least(F.lit(k), F.col("ids"))).otherwise(F.lit(0 if filtered else k))
    answered = F.col("returned").isNotNull()
    count = lambda test: F.count(F.when(test, 1))
    return rows.agg(
        F.count(F.lit(1)).alias("firings"),
        count(~F.col("ok") & ~F.col("timed_out")).alias("errors"),
        count(F.col("timed_out")).alias("timeouts"),
        count(answered & (F.col("returned") < expected)).alias("short_returns"),
        count(answered & known & F.lit(filtered) & (F.col("ids") > 0) & (F.col("returned") > F.col("ids"))).alias("filter_overreturn"),
        count(answered & known & (F.col("ids") == 0)).alias("empty_ground_truth"),
    )
