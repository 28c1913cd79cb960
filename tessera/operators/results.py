"""Ranked lists as results: one row a query with lists, their provenance, partial results of parts of a corpus, and the checked merge."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, FloatType, IntegerType, LongType, ShortType

from tessera.operators.search import ranked
from tessera.sources.scratch import stored
from tessera.sources.shipping import sound_unions

#: Columns of a result that a payload column may not be named like. The names are a file format.
RESERVED = ("query_id", "hit_ids", "hit_scores", "hit_exact", "hit_tie", "applied_threshold", "nan_hits")
#: Columns with a list of the hits' values.
HITS = ("hit_ids", "hit_scores", "hit_exact", "hit_tie")


# --- lists ----------------------------------------------------------------------------------------------------------
def result_lists(found: DataFrame, queries: DataFrame, payload: Iterable[str] = (), tie: str | None = None, exact: bool = False) -> DataFrame:
    """query_id (text), payload columns of the query, hit_ids (texts), hit_scores (32-bit), best first; a row for each query, with
    empty lists where nothing was found. With ``exact`` also hit_exact, the scores in 64 bits; with ``tie``, a column of whole numbers
    in ``found``, also hit_tie."""
    payload = list(payload)
    if clash := sorted(set(payload) & set(RESERVED)):
        raise ValueError(f"payload columns {clash} are named like columns of the result")
    if missing := sorted(set(payload) - set(queries.columns)):
        raise ValueError(f"no query columns {missing}")
    kinds = {"hit_ids": ("vec_id", "string"), "hit_scores": ("score", "float"), **({"hit_exact": ("score", "double")} if exact else {}), **({"hit_tie": (tie, "bigint")} if tie else {})}
    lists = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", *[F.col(c).cast(kind).alias(n) for n, (c, kind) in kinds.items()]))).alias("x"))
    lists = lists.select(F.col("query_id").alias("__q"), *[F.col(f"x.{n}").alias(n) for n in kinds])
    rows = queries.select("query_id", *payload).join(lists, F.col("query_id") == F.col("__q"), "left")
    return rows.select(F.col("query_id").cast("string").alias("query_id"), *payload, *[F.coalesce(n, F.array().cast(f"array<{kind}>")).alias(n) for n, (_, kind) in kinds.items()])


def short_lists(lists: DataFrame, k: int) -> DataFrame:
    """short, queries: how many lists have fewer than k hits. That is legal, and worth a warning."""
    return lists.agg(F.count(F.when(F.size("hit_ids") < k, 1)).alias("short"), F.count(F.lit(1)).alias("queries"))


def long_lists(lists: DataFrame) -> DataFrame:
    """Lists as rows: the columns of ``lists`` that are no lists, rank, vec_id, score, and exact and tie if there are such lists."""
    others = [c for c in lists.columns if c not in HITS]
    hits = F.arrays_zip(*[c for c in HITS if c in lists.columns])
    rows = lists.select(*others, F.posexplode(hits).alias("p", "x"))
    more = [F.col(f"x.hit_{n}").alias(n) for n in ("exact", "tie") if f"hit_{n}" in lists.columns]
    return rows.select(*others, (F.col("p") + 1).alias("rank"), F.col("x.hit_ids").alias("vec_id"), F.col("x.hit_scores").alias("score"), *more)


# --- provenance -----------------------------------------------------------------------------------------------------
def identity(settings: dict) -> str:
    """SHA-256 of settings, whatever the order of their names."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def run_identity(settings: dict, corpus: str, parts: int | None = None, tie: str = "id", limit: int | None = None) -> str:
    """Settings, corpus fingerprint and what else decides the result of a run."""
    return identity({"settings": identity(settings), "corpus": corpus, "parts": parts, "tie": tie, "limit": limit})


def result_name(queries: str, name: str, k: int) -> str:
    stem = queries.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")
    return f"topk_{stem}_{name}_k{k}.parquet"


def partial_name(queries: str, name: str, k: int, rank: int) -> str:
    return f"_partial_{result_name(queries, name, k).removesuffix('.parquet')}/rank{rank:03d}.parquet"


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_json(spark: SparkSession, path: str, content: dict) -> None:
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(content, indent=1, sort_keys=True, default=str).encode()))
    finally:
        out.close()


def read_json(spark: SparkSession, path: str) -> dict | None:
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def write_result(lists: DataFrame, folder: str, queries: str, name: str, k: int, provenance: dict, rank: int | None = None) -> str:
    """Write lists and, last, beside them their provenance as ``<name>.json``; a manifest that is there says that the result is whole."""
    path = f"{folder.rstrip('/')}/{result_name(queries, name, k) if rank is None else partial_name(queries, name, k, rank)}"
    lists.write.mode("overwrite").option("compression", "snappy").parquet(path)
    write_json(lists.sparkSession, f"{path}.json", {**provenance, "k": k, "columns": lists.columns, **({} if rank is None else {"rank": rank})})
    return path


# --- the checked merge ----------------------------------------------------------------------------------------------
def check_runs(provenances: list[dict], forced: bool = False) -> dict:
    """One provenance for partial results of one run, or an error: same run, settings, tie rule and k, and each rank of the run once."""
    if not provenances:
        raise ValueError("no partial results")
    for field in ("run", "settings", "tie", "k", "parts"):
        if len({json.dumps(p.get(field), sort_keys=True, default=str) for p in provenances}) > 1 and not forced:
            raise ValueError(f"partial results differ in {field!r}")
    ranks = sorted(p["rank"] for p in provenances)
    parts = provenances[0].get("parts") or len(ranks)
    if ranks != list(range(parts)) and not forced:
        raise ValueError(f"ranks {ranks} are not each of 0 to {parts - 1} once")
    return {**{n: v for n, v in provenances[0].items() if n != "rank"}, **({"forced": True} if forced else {})}


def _whole(kind) -> bool:
    return isinstance(kind, (ByteType, ShortType, IntegerType, LongType))


def rounded_down(score: Column) -> Column:
    """A 32-bit number that is not above a 64-bit one, so that a bound stays a bound."""
    return (score - F.abs(score) * F.lit(2.0**-23) - F.lit(2.0**-149)).cast("float")


def partial_problems(partials: DataFrame, parts: int, k: int, queries: DataFrame | None = None) -> DataFrame:
    """query_id, problem: what keeps partial lists from being merged. ``partials`` has a column part.

    Queries that some part lacks or has twice, or with ``queries`` (query_id) that all parts lack; null or uneven lists, nulls in
    lists, lists longer than k, 64-bit scores that are others than the 32-bit ones; and queries whose parts together have fewer hits
    than their applied threshold vouches for.
    """
    sound_unions(partials.sparkSession)
    kind = partials.schema["hit_scores"].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, FloatType):
        raise ValueError("hit_scores has to be a list of 32-bit numbers")
    lists = [c for c in HITS if c in partials.columns]
    null = F.lit(False)
    for c in lists:
        null = null | F.col(c).isNull()
    uneven, holes = F.lit(False), F.lit(False)
    for c in lists:
        uneven = uneven | (F.size(c) != F.size("hit_scores"))
        holes = holes | F.exists(c, lambda x: x.isNull())
    what = F.when(null, "null lists").when(uneven, "uneven lists").when(holes, "nulls in lists").when(F.size("hit_scores") > k, "more hits than k")
    if "hit_exact" in partials.columns:
        what = what.when(~F.transform("hit_exact", lambda x: x.cast("float")).eqNullSafe(F.col("hit_scores")), "scores differ")
    odd = partials.select("query_id", what.alias("problem")).filter("problem IS NOT NULL")
    told = [F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("d")]
    if "applied_threshold" in partials.columns:
        nan = F.sum(F.coalesce("nan_hits", F.lit(0))) if "nan_hits" in partials.columns else F.lit(0)
        told += [F.max("applied_threshold").alias("t"), (F.lit(k) - nan - F.sum(F.size("hit_ids"))).alias("missing"), nan.alias("slots")]
    times = partials.groupBy("query_id").agg(*told)
    found = odd.unionByName(times.filter((F.col("n") != parts) | (F.col("d") != parts)).select("query_id", F.lit("not once in each part").alias("problem")))
    if "applied_threshold" in partials.columns:
        found = found.unionByName(times.filter((F.col("t") > float("-inf")) & (F.col("missing") > 0) & (F.col("slots") < k)).select("query_id", F.lit("fewer hits than its threshold vouches for").alias("problem")))
    if queries is not None:
        lost = queries.select(F.col("query_id").cast("string").alias("query_id")).join(times.select("query_id"), "query_id", "left_anti")
        found = found.unionByName(lost.select("query_id", F.lit("in no part").alias("problem")))
    return found


def merge_lists(partials: DataFrame, k: int, parts: int, tie: str | None = None, queries: DataFrame | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: partial lists (part, query_id, hit_ids, hit_scores, and hit_exact, hit_tie, nan_hits, applied_threshold
    if there are such columns) to whole ones.

    The job fails where ``partial_problems`` finds any, and where a merged list does not reach a threshold that was applied to one
    of its parts: then rows were left out that belong in it. Ties go by hit_tie if there is such a column, else by the text of the
    identifier. Hits whose score was not a number took places in their part, so a query's list is cut to k less the number of them.
    Scores of results have 32 bits; lists with hit_exact merge by that, of others scores that differ beyond 32 bits are ties here.
    """
    tie = tie or ("tie" if "hit_tie" in partials.columns else "vec_id")
    limited = "applied_threshold" in partials.columns
    partials = stored(partials, "partials")  # read several times below
    bad = partial_problems(partials, parts, k, queries).agg(F.count(F.lit(1)).alias("bad"), F.min(F.struct("query_id", "problem")).alias("first"))
    message = F.concat(F.lit("partial lists do not fit together, first at query "), F.coalesce(F.col("first.query_id").cast("string"), F.lit("null")), F.lit(": "), F.col("first.problem"))
    entries = long_lists(partials.drop("nan_hits"))
    score = "exact" if "hit_exact" in partials.columns else "score"
    found = ranked(entries.select("query_id", "vec_id", F.col(score).alias("score"), *(["tie"] if "hit_tie" in partials.columns else [])), k, [F.col(tie)])
    told = []
    if "nan_hits" in partials.columns:
        told.append(F.sum(F.coalesce("nan_hits", F.lit(0))).alias("__nan"))
    if limited:
        told.append(F.max("applied_threshold").alias("__applied"))
    if told:
        found = found.join(partials.groupBy("query_id").agg(*told), "query_id")
    if "nan_hits" in partials.columns:
        found = found.filter(F.col("rank") <= F.lit(k) - F.col("__nan"))
    if limited:
        least = F.min("score").over(Window.partitionBy("query_id"))
        low = F.coalesce(least < F.col("__applied"), F.lit(False))
        problem = F.raise_error(F.concat(F.lit("a part was trimmed by a threshold that the merged list does not reach, query "), F.col("query_id").cast("string")))
        found = found.withColumn("__low", low).filter(F.when(F.col("__low"), problem).otherwise(F.lit(True)))
    out = found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("float").alias("score"))
    # no row, or an error; beside the lists, so that it is looked at even where no list has an entry
    fine = bad.filter(F.when(F.col("bad") > 0, F.raise_error(message)).otherwise(F.lit(False)))
    return out.unionByName(fine.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema]))


def partial_lists(found: DataFrame, queries: DataFrame, part: int, bounds: DataFrame | None = None) -> DataFrame:
    """Lists of one part, from a search with ``nan="keep"``: part, query_id, hit_ids, hit_scores, hit_exact, hit_tie where identifiers are
    whole numbers, nan_hits, the number of hits that took a place without a score and are left out, and with ``bounds`` (query_id, bound),
    those that the search began with, applied_threshold: the bound in 32 bits, rounded down."""
    found = stored(found, "part")  # read twice below
    nan = F.isnan("score")
    slots = found.groupBy("query_id").agg(F.count(F.when(nan, 1)).cast("int").alias("nan_hits"))
    real = found.filter(~nan).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    ties = "vec_id" if _whole(found.schema["vec_id"].dataType) else None
    text = F.col("query_id").cast("string").alias("query_id")
    out = result_lists(real, queries, tie=ties, exact=True).join(slots.select(text, "nan_hits"), "query_id", "left")
    last = []
    if bounds is not None:
        out = out.join(bounds.select(text, rounded_down(F.col("bound")).alias("applied_threshold")), "query_id", "left")
        last = ["applied_threshold"]
    return out.select(F.lit(part).alias("part"), "query_id", "hit_ids", "hit_scores", "hit_exact", *(["hit_tie"] if ties else []), F.coalesce("nan_hits", F.lit(0)).alias("nan_hits"), *last)
