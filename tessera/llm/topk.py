"""Exact top-k inner products over norm-sorted vectors.

Vectors are dealt into classes by descending length and, within a class, into
blocks of bounded size; queries meet a block only if Cauchy-Schwarz leaves it a
chance: |q| times the length of the class's longest vector reaches the query's
current k-th score, which the block of the longest vectors gives first. Inside a
block vectors pass in order of length. A rotation by the right singular vectors
of a bounded sample puts most of the energy into few coordinates; the inner
product over those plus the product of the residual lengths bounds the rest, and
only pairs whose bound reaches the k-th score are computed in whole numbers.
The rotation changes what is pruned, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import ship, stored, table

SCALE = 1024
K = 10
#: Vectors of a block, queries of a group, and vectors that are bounded at once.
BLOCK, QUERIES, STEP = 8192, 4096, 512
#: Classes of length.
CLASSES = 32
#: Vectors, those with the least hashes, from which the rotation is fitted.
SAMPLE = 4096
#: Sums of products below this are exact in doubles.
EXACT = 2.0**52


def whole_vectors(rows: DataFrame, identifier: str, vector: str, scale: int = SCALE, keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, v (array of long), length, r (a number of the row) and the columns in ``keep``: components floor(scale * x).

    Vectors that are null or hold null, NaN or infinite components, and rows without an identifier, are left out. Rows that repeat
    an identifier are rows each.
    """
    x = F.col(vector)
    sound = x.isNotNull() & F.col(identifier).isNotNull() & F.forall(F.coalesce(x, F.array()), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    ints = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    good = rows.filter(sound).select(F.col(identifier).cast("long").alias("vec_id"), ints.alias("v"), *keep)
    return good.withColumn("r", F.monotonically_increasing_id()).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))))


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of a sample of at most ``SAMPLE`` vectors, strongest first, as columns."""
    sample = rows.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h").limit(SAMPLE).select("v").collect()
    x = _matrix([r["v"] for r in sample], width).astype(float)
    return np.linalg.svd(x, full_matrices=True)[2].T if len(x) else np.eye(width)


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products of all rows of a with all rows of b."""
    most = np.sqrt((a.astype(float) ** 2).sum(axis=1).max(initial=0) * (b.astype(float) ** 2).sum(axis=1).max(initial=0))
    if most < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def block_top(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, turn: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query number, vector identifier, score) of each query's best k in a block that reach its floor; and how many pairs were computed.

    A floor is a score that k other vectors reach already; ties to it stay, since a smaller identifier may win.
    """
    order = np.argsort(-(vectors.astype(float) ** 2).sum(axis=1), kind="stable")
    ids, vectors = ids[order], vectors[order]
    kept = max(1, vectors.shape[1] // 4)
    turned_q, turned_x = queries @ turn, vectors @ turn
    length_q, length_x = np.sqrt((queries.astype(float) ** 2).sum(axis=1)), np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    rest_q = np.sqrt(np.maximum(0, (turned_q[:, kept:] ** 2).sum(axis=1)))
    rest_x = np.sqrt(np.maximum(0, (turned_x[:, kept:] ** 2).sum(axis=1)))
    floors = floors.astype(float).copy()
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
    computed = 0
    for at in range(0, len(ids), STEP):
        part = slice(at, at + STEP)
        # rounding of the bounds stays far below this
        slack = 1e-9 * length_q * length_x[at] + 1e-6
        open_ = np.flatnonzero(length_q * length_x[at] + slack >= floors)
        if not len(open_):
            break
        bound = turned_q[open_, :kept] @ turned_x[part, :kept].T + np.outer(rest_q[open_], rest_x[part])
        reach = bound + slack[open_, None] >= floors[open_, None]
        reach &= query_ids[open_, None] != ids[None, part]
        rows = np.flatnonzero(reach.any(axis=1))
        if not len(rows):
            continue
        scores = _exact(queries[open_[rows]], vectors[part])
        computed += int(reach[rows].sum())
        for row, score in zip(rows.tolist(), scores, strict=True):
            q = int(open_[row])
            hit = np.flatnonzero(reach[row] & (score >= floors[q]))
            if not len(hit):
                continue
            all_ids, all_scores = np.r_[best[q][0], ids[part][hit]], np.r_[best[q][1], score[hit]]
            top = np.lexsort((all_ids, -all_scores))[:k]
            best[q] = all_ids[top], all_scores[top]
            if len(top) == k:
                floors[q] = max(floors[q], float(all_scores[top[-1]]))
    number = np.repeat(np.arange(len(queries)), [len(b[0]) for b in best])
    return number, np.concatenate([b[0] for b in best]) if best else np.empty(0, np.int64), np.concatenate([b[1] for b in best]) if best else np.empty(0, np.int64), computed


def _search(cells: DataFrame, width: int, turn: np.ndarray, k: int) -> DataFrame:
    """Rows (cell, is_query, vec_id, v, floor) -> query_id, vec_id, score, the best k of each query in each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cells(batches):
            queries, others = [r for r in rows if r[0]], [r for r in rows if not r[0]]
            if not queries or not others:
                continue
            names = np.array([r[1] for r in queries], np.int64)
            number, ids, scores, _ = block_top(names, _matrix([r[2] for r in queries], width), np.array([-np.inf if r[3] is None else r[3] for r in queries]), np.array([r[1] for r in others], np.int64), _matrix([r[2] for r in others], width), turn, k)
            yield pa.RecordBatch.from_arrays([pa.array(names[number]), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

    dealt = cells.repartition("c", "s", "g").sortWithinPartitions("c", "s", "g")
    return dealt.select("c", "s", "g", "is_query", "vec_id", "v", "floor").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    at, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for c, s, g, *row in zip(*columns, strict=True):
            if (c, s, g) != at:
                if held:
                    yield held
                at, held = (c, s, g), []
            held.append(row)
    if held:
        yield held


def top_k(rows: DataFrame, is_query: Column, identifier: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``is_query`` (a condition on vec_id) the k other vectors of highest whole inner
    product, ties to the smaller identifier; all of them where there are fewer.

    Short vectors count as ending in zeros. Empty tables and tables without a query give no rows. The scores have to fit in a long.
    Rows with a query's identifier are no candidates of it; other rows that repeat an identifier are candidates each, and so listed
    each. Rows of a query that repeat its identifier make one list, of the best of all of them. Other columns are not looked at.
    """
    ship(rows.sparkSession)
    vectors = stored(whole_vectors(rows, identifier, vector, scale), "vectors")
    width, n, queries = vectors.agg(F.max(F.size("v")), F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    width = max(1, width or 1)
    turn = rotation(vectors, width)
    wanted = int(min(CLASSES, max(1, -(-n // BLOCK))))
    cuts = vectors.agg(F.percentile_approx("length", [1 - (i + 1) / wanted for i in range(wanted - 1)], 10_000).alias("x")).first()["x"] if wanted > 1 and n else []
    # class 0 holds the longest; at most CLASSES - 1 borders
    cls = sum([F.when(F.col("length") < F.lit(float(x)), 1).otherwise(0) for x in cuts], F.lit(0))
    classed = vectors.withColumn("c", cls.cast("int"))
    sizes = {r["c"]: (r["n"], r["longest"]) for r in classed.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect()}
    subs = F.element_at(F.create_map(*[F.lit(int(x)) for c in sorted(sizes) for x in (c, -(-sizes[c][0] // BLOCK))]), F.col("c")) if sizes else F.lit(1)
    placed = classed.withColumn("s", F.pmod(F.xxhash64("r"), subs).cast("int"))
    groups = int(max(1, -(-(queries or 0) // QUERIES)))
    asked = vectors.filter(is_query).withColumn("g", F.pmod(F.xxhash64("r", F.lit(1)), F.lit(groups)).cast("int"))

    def as_cells(asked: DataFrame, places: DataFrame) -> DataFrame:
        everywhere = places.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("c", "s", "g", F.lit(False).alias("is_query"), "vec_id", "v", F.lit(None).cast("double").alias("floor"))
        return everywhere.unionByName(asked.select("c", "s", "g", F.lit(True).alias("is_query"), "vec_id", "v", "floor"))

    longest = min(sizes) if sizes else 0
    first = as_cells(asked.withColumns({"c": F.lit(longest).cast("int"), "s": F.lit(0).cast("int"), "floor": F.lit(None).cast("double")}), placed.filter((F.col("c") == longest) & (F.col("s") == 0)))
    begun = stored(_search(first, width, turn, k), "begun")
    floors = begun.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found")).filter(F.col("found") >= k).select(F.col("query_id").alias("vec_id"), F.col("least").cast("double").alias("floor"))
    # the classes, and in them the blocks, that a query may still find something in
    blocks = F.array(*[F.struct(F.lit(int(c)).alias("c"), F.lit(float(longest_)).alias("longest"), F.lit(int(-(-m // BLOCK))).alias("blocks")) for c, (m, longest_) in sorted(sizes.items())]) if sizes else None
    if blocks is None:
        found = begun
    else:
        open_ = F.filter(blocks, lambda b: F.col("floor").isNull() | (F.col("length") * b["longest"] * (1 + 1e-9) + 1e-6 >= F.col("floor")))
        rest = asked.join(floors, "vec_id", "left").withColumn("b", F.explode(open_)).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("b.blocks") - 1))).select("vec_id", "v", "g", "floor", F.col("b.c").alias("c"), F.col("s").cast("int").alias("s")).filter(~((F.col("c") == longest) & (F.col("s") == 0)))
        found = begun.unionByName(_search(as_cells(rest, placed.filter(~((F.col("c") == longest) & (F.col("s") == 0)))), width, turn, k))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
