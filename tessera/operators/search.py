"""Exact top-k similarity joins: dense, sparse and multivector, with static and per-query filters.

The corpus passes once, as it is read, through products with a bounded block of queries; conditions with values from the query
are masks beside the product (see ``masks``). Each Arrow batch returns k candidates a query at most, and only what reaches the
k-th score that the query has in the task so far, so what is shuffled grows with tasks and queries and never with pairs. Products
of blocks round by position: what comes within the rounding error of the k-th is scored again, row by row, so equal vectors score
alike in any partitioning.

A NaN score takes no place in a list, unless ``nan`` says so: with ``"slot"`` it sorts above infinity, takes one of the k places
and is then left out, so the list is shorter; with ``"keep"`` it stays in the list, for partial lists that are merged later.
Minus infinity is never in a list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from tessera.functions.vectors import LEAST_NORM, doubles
from tessera.operators.filters import evaluate
from tessera.operators.masks import Masks, wanted
from tessera.sources.scratch import stored
from tessera.sources.shipping import ship, sound_unions

#: Bytes of query vectors that are held in each task at once; more queries take more passes.
QUERY_BYTES = 64 << 20
#: Rows of a query side up to which it is broadcast to a join; a larger one is joined in blocks of this size.
QUERY_ROWS = 20_000
#: Scores that are held at once.
CELLS = 1 << 20
#: Scores of pairs that are put in order at once: the more, the more equal ones stand together, and files of them are smaller.
SORTED = 1 << 22
#: Part of the sum of two squared lengths, below which a squared distance is taken from the differences.
NEAR = 1e-4
#: Candidates of a batch that are held before they are sent on.
FOUND = 1 << 16
#: Entries of lists that are worked on at once.
ENTRIES = 1 << 20
#: Rows that a sparse search begins with in a batch; then twice as many at a time, since fewer queries can want them.
FIRST_ROWS = 64
#: A cell of a product of matrices takes a part of the time of an entry that meets a query: about one in this many.
CROWDED = 64
NAN = ("drop", "slot", "keep")
_EPS = float(np.finfo(float).eps)


def ranked(scored: DataFrame, k: int, tie: list[Column] | None = None, query: str = "query_id", nan: str = "drop") -> DataFrame:
    """The k best rows of each query with their rank from 1; ties by ``tie``."""
    if nan not in NAN:
        raise ValueError(f"nan has to be one of {NAN}")
    order = Window.partitionBy(query).orderBy(F.desc("score"), *(tie or [F.col("vec_id")]))
    good = scored.filter(F.col("score").isNotNull() & (F.col("score") > F.lit(float("-inf"))))
    good = good.filter(~F.isnan("score")) if nan == "drop" else good
    top = good.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if nan != "slot":
        return top
    slots = F.count(F.when(F.isnan("score"), 1)).over(Window.partitionBy(query))
    return top.withColumn("rank", F.col("rank") - slots.cast("int")).filter(~F.isnan("score"))


def tie_order(schema: StructType, rule: str, identifier: str = "vec_id") -> list[Column]:
    """Columns that order equal scores: ``ordinal`` by file and row (of a ``scan``), ``id`` by identifier, then file and row.

    Whole numbers compare as numbers and texts by their bytes. A null identifier is an error where it is compared.
    """
    place = [F.col(c) for c in ("filename", "file_row_number") if c in schema.names]
    if rule == "ordinal":
        if len(place) < 2:
            raise ValueError("ties by position need filename and file_row_number")
        return place
    if rule != "id":
        raise ValueError(f"unknown tie rule {rule!r}")
    if identifier not in schema.names or isinstance(schema[identifier].dataType, BinaryType):
        raise ValueError(f"ties by identifier need a column {identifier!r} of numbers or text")
    return [F.when(F.col(identifier).isNull(), F.raise_error(F.lit("null identifier"))).otherwise(F.col(identifier)), *place]


def merge(partials: list[DataFrame], k: int, tie: list[Column] | None = None, nan: str = "drop") -> DataFrame:
    """Ranked lists of parts of a corpus to the ranked lists of the whole. For ``nan="slot"`` the parts have to be kept with ``nan="keep"``."""
    return ranked(union([p.drop("rank") for p in partials]), k, tie, nan=nan)


def union(parts: list[DataFrame]) -> DataFrame:
    sound_unions(parts[0].sparkSession)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def blocks_of(queries: DataFrame, rows: int | None = None, n: int | None = None) -> list[DataFrame]:
    """Query rows in blocks of about ``rows``: one where they fit, else dealt by hash."""
    rows = QUERY_ROWS if rows is None else rows
    n = queries.count() if n is None else n
    count = max(1, -(-n // rows))
    return [queries] if count == 1 else [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(count)) == i) for i in range(count)]


def _block_rows(width: int | None, k: int) -> int:
    """Queries of a block: a task holds the vector of each, and its k best scores so far."""
    return max(1, QUERY_BYTES // (8 * ((width or 1) + k)))


def _in_turn(blocks: list[DataFrame], search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One block is searched when the result is used; of several, each is written before the next is broadcast."""
    return search(blocks[0]) if len(blocks) == 1 else union([stored(search(b), "found") for b in blocks])


def _result(found: DataFrame, k: int, nan: str = "drop") -> DataFrame:
    return ranked(found, k, nan=nan).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


# --- products of blocks ---------------------------------------------------------------------------------------------
def _best(scores: np.ndarray, ids: np.ndarray, k: int, nan: str) -> np.ndarray:
    """Numbers of the k best scores, ties to the smaller identifier; NaN ones first or not at all."""
    real = scores > -np.inf
    out = np.flatnonzero(real)
    if nan != "drop":
        out = np.r_[np.flatnonzero(np.isnan(scores))[:k], out]
    if len(out) <= k:
        return out
    key = np.where(np.isnan(scores[out]), np.inf, scores[out])
    first = ~np.isnan(scores[out])
    return out[np.lexsort((ids[out], -key, first))[:k]]


def _near_top(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the k best, given bounds of their scores; rows without finite bounds may."""
    sound = np.isfinite(low) & np.isfinite(high)
    if sound.sum() <= k:
        return np.arange(len(low))
    kth = np.partition(low[sound], sound.sum() - k)[sound.sum() - k]
    return np.flatnonzero(~sound | (high >= kth))


def _emit(found: list[tuple], names: pa.Array, keys: list[pa.Field]) -> pa.RecordBatch:
    """found: (key of a query, row numbers, scores)."""
    owner = pa.array(np.repeat(np.arange(len(found)), [len(x[1]) for x in found]))
    rows = np.concatenate([np.empty(0, np.int64), *[x[1] for x in found]]).astype(np.int64)
    scores = np.concatenate([np.empty(0), *[x[2] for x in found]])
    columns = [pa.array([x[0][i] for x in found], f.type).take(owner) for i, f in enumerate(keys)]
    return pa.RecordBatch.from_arrays([*columns, names.take(pa.array(rows)), pa.array(scores)], [*[f.name for f in keys], "vec_id", "score"])


def _product_pass(rows: DataFrame, sent: object, kernel: Callable, keys: list[StructField], k: int) -> DataFrame:
    """``kernel(batch, sent, floors)`` gives (key of a query, row numbers, scores) for the best of each batch.

    ``floors`` has for each key the k-th score that the query has in the task so far; what does not reach it is not sent on.
    """
    ship(rows.sparkSession)
    payload = rows.sparkSession.sparkContext.broadcast(sent)
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, np.ndarray] = {}  # up to k scores of each query
        floors: dict[tuple, float] = {}
        for batch in batches:
            with np.errstate(all="ignore"):  # infinities and NaN are data here
                found, held = [], 0
                for key, rows, scores in kernel(batch, payload.value, floors):
                    if key in floors:
                        reach = ~(scores < floors[key])
                        rows, scores = rows[reach], scores[reach]
                    best[key] = np.sort(np.r_[best.get(key, scores[:0]), scores[~np.isnan(scores)]])[-k:]
                    if len(best[key]) == k:
                        floors[key] = float(best[key][0])
                    if len(rows):
                        found.append((key, rows, scores))
                        held += len(rows)
                    if held >= FOUND:
                        yield _emit(found, batch.column(0), fields)
                        found, held = [], 0
                yield _emit(found, batch.column(0), fields)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys)
    return rows.mapInArrow(run, f"{schema}, vec_id {rows.schema['vec_id'].dataType.simpleString()}, score double")


def _key(queries: DataFrame) -> StructField:
    return StructField("query_id", queries.schema["query_id"].dataType)


def _identifiers(column: pa.Array) -> np.ndarray:
    """Identifiers as values that arrays can be sorted by: texts by the order of their bytes, which is that of their code points."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), str)
    return column.to_numpy(zero_copy_only=False)


def _tamed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose squares would leave the range of doubles, by a power of two that keeps them in; and these powers."""
    most = np.abs(x).max(axis=1, initial=0)
    power = np.where(np.isfinite(most) & (most > 1e150), np.frexp(most)[1], 0)
    return (np.ldexp(x, -power[:, None]), power) if power.any() else (x, power)


def _row_scores(metric: str, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Scores of one query against rows, the same for equal rows wherever they stand."""
    if metric == "euclidean":
        d, power = _tamed(c - q)
        return -np.ldexp(np.sqrt((d**2).sum(axis=1)), power)
    if metric == "cosine":
        c, _ = _tamed(c)
        q = _tamed(q[None, :])[0][0]
    s = (c * q).sum(axis=1)
    if metric == "cosine":
        s = s / np.maximum(np.sqrt((c * c).sum(axis=1)), LEAST_NORM) / max(float(np.sqrt((q * q).sum())), LEAST_NORM)
    return s


def _block_bounds(metric: str, q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a rising function of the scores of queries (rows) against rows (columns): product and rounding error.

    The error of a product of n numbers is at most n * eps times the product of the lengths; the bounds leave room for four times
    that. Where a length is no finite number, the bounds are none.
    """
    gamma = 4 * (q.shape[1] + 4) * _EPS
    s = q @ c.T
    length_q, length_c = np.sqrt((q * q).sum(axis=1))[:, None], np.sqrt((c * c).sum(axis=1))
    if metric == "cosine":
        s, error = s / np.maximum(length_c, LEAST_NORM) / np.maximum(length_q, LEAST_NORM), gamma + 0 * length_q * length_c
    elif metric == "euclidean":  # the negated square
        s, error = 2 * s - length_q**2 - length_c**2, gamma * (length_q + length_c) ** 2
    else:
        error = gamma * length_q * length_c
    return s - error, s + error


def _bound_of(metric: str, floors: np.ndarray) -> np.ndarray:
    """Scores as what ``_block_bounds`` bounds, rounded down."""
    return -(floors * floors) * (1 + 8 * _EPS) if metric == "euclidean" else floors


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the lists in ``lists.values``; a null list has no size."""
    offsets = lists.offsets.to_numpy()
    sizes = np.diff(offsets)
    return offsets[:-1], np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0) if lists.null_count else sizes


def dense_topk(
    queries: DataFrame, corpus: DataFrame, metric: str = "dot", k: int = 10, where: dict | None = None, dates: tuple[str, ...] = (), nan: str = "drop", bounds: DataFrame | None = None, told: dict | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: queries (query_id, embedding) against all rows of corpus (vec_id, embedding, payload).

    Null vectors, and vectors of another length than the query's, are no candidates. Ties go to the smaller vec_id. Fewer than k
    candidates give shorter lists. ``where`` is a filter of payload columns; what of it has no value from the query reaches the
    scan, and so do the values and bounds that all queries together allow.

    ``bounds`` (query_id, bound) are scores that the k-th result of a query reaches in any case: rows below are not scored and
    not returned. ``told`` gets accumulators: ``pairs`` of a query and a row that its filter lets through, and of these ``scored``
    row by row. They count when the result is used, again each time it is.
    """
    return _result(candidates(queries, corpus, metric, k, where, dates, nan, bounds, told), k, nan)


def candidates(
    queries: DataFrame, corpus: DataFrame, metric: str = "dot", k: int = 10, where: dict | None = None, dates: tuple[str, ...] = (), nan: str = "drop", bounds: DataFrame | None = None, told: dict | None = None
) -> DataFrame:
    """query_id, vec_id, score: of each batch of the corpus, which may be a stream, what can be among a query's k best; see ``dense_topk``."""
    masks = Masks(corpus.schema, where, queries.schema, dates)
    keep = wanted(queries, corpus.schema, where, dates)
    rows = (corpus if keep is None else corpus.filter(keep)).select("vec_id", "embedding", *[c.alias(n) for n, c in masks.columns.items()]).filter("embedding IS NOT NULL AND vec_id IS NOT NULL")
    named = queries.select("query_id", "embedding", *[c.alias(n) for n, c in masks.query_columns.items()]).filter("embedding IS NOT NULL")
    if bounds is not None:
        named = named.join(bounds.select("query_id", F.col("bound").cast("double").alias("__floor")), "query_id", "left")
    width, n = named.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    sc = corpus.sparkSession.sparkContext
    counts = {name: sc.accumulator(0) for name in ("pairs", "scored")} if told is not None else {}
    if told is not None:
        told |= counts

    def kernel(batch: pa.RecordBatch, sent: dict, floors: dict) -> Iterator[tuple]:
        starts, sizes = _flat(batch.column(1))
        flat = batch.column(1).values.to_numpy(zero_copy_only=False).astype(float)
        names = _identifiers(batch.column(0))
        for width, (keys, q, given, tables) in sent.items():
            picked = np.flatnonzero(sizes == width)
            if not len(picked):
                continue
            values = masks.rows(batch.take(pa.array(picked)) if masks else batch, tables)
            every = flat[starts[picked][:, None] + np.arange(width)]
            step = max(1, CELLS // (4 * len(picked)))  # a quarter: some eight arrays of that size are held
            for at in range(0, len(q), step):
                part = slice(at, at + step)
                fits = np.broadcast_to(masks.fits(values, tables, at, min(len(q), at + step)), (len(keys[part]), len(picked)))
                some = np.flatnonzero(fits.any(axis=0)) if masks else np.arange(len(picked))
                if not len(some):
                    continue
                c = every if len(some) == len(picked) else every[some]
                fits, here = fits[:, some], picked[some]
                own = names[here]
                low, high = _block_bounds(metric, q[part], c)
                floor = np.array([max(floors.get(key, -np.inf), g) for key, g in zip(keys[part], given[part], strict=True)])
                reach = fits & ~(high < _bound_of(metric, floor)[:, None])
                if counts:
                    counts["pairs"].add(int(fits.sum()))
                for row in np.flatnonzero(reach.any(axis=1)).tolist():
                    near = np.flatnonzero(reach[row])
                    near = near[_near_top(low[row][near], high[row][near], k)]
                    exact = _row_scores(metric, q[at + row], c[near])
                    if counts:
                        counts["scored"].add(len(near))
                    above = np.flatnonzero(~(exact < given[at + row]))
                    best = above[_best(exact[above], own[near[above]], k, nan)]
                    yield keys[at + row], here[near[best]], exact[best]

    def search(block: DataFrame) -> DataFrame:
        by_width: dict[int, list] = {}
        for r in block.collect():  # at most QUERY_BYTES of vectors
            by_width.setdefault(len(r["embedding"]), []).append(r)
        sent = {}
        for w, held in by_width.items():
            given = np.array([-np.inf if bounds is None or r["__floor"] is None or not np.isfinite(r["__floor"]) else r["__floor"] for r in held], float)
            sent[w] = ([(r["query_id"],) for r in held], np.array([r["embedding"] for r in held], float).reshape(len(held), w), given, masks.sent(held))
        return _product_pass(rows, sent, kernel, [_key(queries)], k)

    blocks = blocks_of(named, _block_rows(width, k), n)
    return union([search(b) for b in blocks]) if rows.isStreaming else _in_turn(blocks, search)


def dense_topk_many(queries: DataFrame, corpus: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """spec, query_id, rank, vec_id, score: several searches in one pass over the corpus. A spec may have metric, k, where and dates.

    Filters are columns of truth values beside the vectors, so each row is read and each vector decoded once for all searches.
    """
    tests = {name: evaluate(corpus.schema, s.get("where"), dates=s.get("dates", ())) for name, s in specs.items()}
    # a filter that several searches have is one column
    filters = list(dict.fromkeys(repr((s.get("where"), s.get("dates", ()))) for s in specs.values()))
    column_of = {n: filters.index(repr((s.get("where"), s.get("dates", ())))) for n, s in specs.items()}
    shared = {column_of[n]: F.lit(True) if t is None else t for n, t in tests.items()}
    rows = corpus.filter("embedding IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "embedding", F.array(*[shared[c] for c in sorted(shared)]).alias("fits"))
    kept = rows.filter(F.exists("fits", lambda x: x))
    named = queries.select("query_id", "embedding").filter("embedding IS NOT NULL")
    width, n = named.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    settings = [(n, s.get("metric", "dot"), s.get("k", 10)) for n, s in specs.items()]
    columns = list(column_of.values())

    def kernel(batch: pa.RecordBatch, sent: list, floors: dict) -> Iterator[tuple]:
        starts, sizes = _flat(batch.column(1))
        flat = batch.column(1).values.to_numpy(zero_copy_only=False).astype(float)
        fits = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        own = _identifiers(batch.column(0))
        for name, q in sent:
            here = np.flatnonzero(sizes == len(q))
            c = flat[starts[here][:, None] + np.arange(len(q))]
            for s, (spec, metric, k) in enumerate(settings):
                mine = np.flatnonzero(fits[here, columns[s]])
                if not len(mine):
                    continue
                low, high = _block_bounds(metric, q[None, :], c[mine])
                near = mine[_near_top(low[0], high[0], k)]
                exact = _row_scores(metric, q, c[near])
                best = _best(exact, own[here[near]], k, "drop")
                yield (spec, name), here[near[best]], exact[best]

    def search(block: DataFrame) -> DataFrame:
        return _product_pass(kept, [(r["query_id"], np.array(r["embedding"], float)) for r in block.collect()], kernel, [StructField("spec", StringType()), _key(queries)], max(k for _, _, k in settings))  # at most QUERY_BYTES

    found = _in_turn(blocks_of(named, _block_rows(width, sum(k for _, _, k in settings)), n), search)
    lists = union([ranked(found.filter(F.col("spec") == name), k) for name, _, k in settings])
    return lists.select("spec", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def dense_scores(queries: DataFrame, corpus: DataFrame, metrics: tuple[str, ...] = ("dot", "cosine", "euclidean")) -> DataFrame:
    """query_id, vec_id and a column for each metric, for every pair of vectors of equal length: one product serves all metrics.

    The rows are n times the number of queries, whatever is done; they come ordered by their product within ``SORTED`` pairs of a
    batch and a block of queries, so that a column writer meets equal scores together. Distances of vectors that are close to each
    other for their lengths come from the differences, since squares lose them.
    """
    rows = corpus.select("vec_id", "embedding").filter("embedding IS NOT NULL")
    asked = queries.select("query_id", "embedding").filter("embedding IS NOT NULL")
    width, n = asked.agg(F.max(F.size("embedding")), F.count(F.lit(1))).first()
    ship(corpus.sparkSession)
    kind = to_arrow_type(_key(queries).dataType)
    schema = f"query_id {_kind(queries)}, vec_id {corpus.schema['vec_id'].dataType.simpleString()}, " + ", ".join(f"{m} double" for m in metrics)

    def search(block: DataFrame) -> DataFrame:
        by_width: dict[int, list] = {}
        for r in block.collect():  # at most QUERY_BYTES
            by_width.setdefault(len(r["embedding"]), []).append((r["query_id"], np.array(r["embedding"], float)))
        held = corpus.sparkSession.sparkContext.broadcast([(pa.array([x for x, _ in some], kind), np.stack([q for _, q in some])) for some in by_width.values()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                starts, sizes = _flat(batch.column(1))
                flat = batch.column(1).values.to_numpy(zero_copy_only=False).astype(float)
                for names, q in held.value:
                    here = np.flatnonzero(sizes == q.shape[1])
                    ids = batch.column(0).take(pa.array(here))
                    c = flat[starts[here][:, None] + np.arange(q.shape[1])]
                    many = max(1, SORTED // max(1, len(here)))
                    for at in range(0, len(q), many):
                        for row, asker, told in _all_scores(q[at : at + many], c, metrics):
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(at + asker)), ids.take(pa.array(row)), *[pa.array(x) for x in told]], ["query_id", "vec_id", *metrics])

        return rows.mapInArrow(run, schema)

    return _in_turn(blocks_of(asked, max(1, QUERY_BYTES // (8 * (width or 1))), n), search)


def _all_scores(q: np.ndarray, c: np.ndarray, metrics: tuple[str, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Rows, queries and scores by each metric of all pairs, by rising product, in slices of up to ``ENTRIES`` components."""
    with np.errstate(all="ignore"):  # infinities and NaN are data here
        product = (c @ q.T).ravel()
        square_q, square_c = (q * q).sum(axis=1), (c * c).sum(axis=1)
        length_q, length_c = (np.maximum(np.sqrt(x), LEAST_NORM) for x in (square_q, square_c))
    order = np.argsort(product)
    step = max(1, ENTRIES // max(1, q.shape[1]))
    for at in range(0, len(order), step):
        row, asker = np.divmod(order[at : at + step], len(q))
        dot = product[order[at : at + step]]
        told = {"dot": dot}
        with np.errstate(all="ignore"):
            if "cosine" in metrics:
                told["cosine"] = dot / length_c[row] / length_q[asker]
            if "euclidean" in metrics:
                both = square_c[row] + square_q[asker]
                square = both - 2 * dot
                told["euclidean"] = -np.sqrt(np.maximum(0.0, square))
                near = np.flatnonzero(~((square > NEAR * both) & np.isfinite(both)))
                d, power = _tamed(c[row[near]] - q[asker[near]])
                told["euclidean"][near] = -np.ldexp(np.sqrt((d**2).sum(axis=1)), power)
        yield row, asker, [told[m] for m in metrics]


def _kind(queries: DataFrame) -> str:
    return queries.schema["query_id"].dataType.simpleString()


def filtered_topk(queries: DataFrame, corpus: DataFrame, where: dict, metric: str = "dot", k: int = 10, dates: tuple[str, ...] = ()) -> DataFrame:
    """As ``dense_topk``, whose filter may take values from the query row."""
    return dense_topk(queries, corpus, metric, k, where, dates)


def wanted_rows(queries: DataFrame, corpus: DataFrame, where: dict, dates: tuple[str, ...] = ()) -> DataFrame:
    """Rows that some query could want, found without meeting queries one by one: a superset, see ``masks.wanted``."""
    keep = wanted(queries, corpus.schema, where, dates)
    return corpus if keep is None else corpus.filter(keep)


def sampled_bounds(queries: DataFrame, corpus: DataFrame, metric: str = "dot", k: int = 10, where: dict | None = None, dates: tuple[str, ...] = (), share: int = 16) -> DataFrame:
    """query_id, bound: the k-th score of each query in one of ``share`` parts of the corpus, by hash of vec_id. The k-th of the whole is
    no less. Queries with fewer than k finite scores there have no bound."""
    part = corpus.filter(F.pmod(F.xxhash64("vec_id"), F.lit(share)) == 0)
    found = dense_topk(queries, part, metric, k, where, dates).filter(F.col("rank") == k)
    return found.filter(F.abs("score") < F.lit(float("inf"))).select("query_id", F.col("score").alias("bound"))


def threshold_topk(queries: DataFrame, corpus: DataFrame, metric: str = "dot", k: int = 10, where: dict | None = None, dates: tuple[str, ...] = (), share: int = 16, told: dict | None = None) -> DataFrame:
    """As ``dense_topk`` in two jobs: a part of the corpus gives bounds, which the pass over all of it begins with."""
    bounds = stored(sampled_bounds(queries, corpus, metric, k, where, dates, share), "bounds")
    return dense_topk(queries, corpus, metric, k, where, dates, bounds=bounds, told=told)


def gathered(entries: DataFrame, identifier: str = "vec_id") -> DataFrame:
    """Entries (identifier, term, weight) to a row for each identifier: identifier, indices, values."""
    rows = entries.groupBy(identifier).agg(F.collect_list(F.struct("term", "weight")).alias("x"))
    return rows.select(identifier, F.col("x.term").alias("indices"), F.col("x.weight").cast("array<double>").alias("values"))


def _summed(rows: np.ndarray, codes: np.ndarray, weights: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated (row, code) become one, their weights summed; in order of row and code."""
    keys, place = np.unique(rows * width + codes, return_inverse=True)
    return keys // width, keys % width, np.bincount(place, weights, len(keys))


def sparse_topk(queries: DataFrame, corpus: DataFrame, metric: str = "dot", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score over rows (query_id | vec_id, indices, values), the weights of repeated indices summed.

    Rows that share no index with a query are no candidates of it. The cosine divides by norms over all indices of a row; for
    all else only indices that some query of the block has are looked at. Nothing is shuffled but the best of each batch.

    A product is at most that of the lengths, so rows are met by falling length, and only by queries whose k-th score so far that
    product reaches. Blocks of queries are measured by their entries in all and are larger than those of vectors, as each block
    takes the indices of the whole corpus once more.
    """
    rows = corpus.select("vec_id", "indices", doubles(F.col("values")).alias("values")).filter("vec_id IS NOT NULL AND indices IS NOT NULL")
    asked = queries.select("query_id", "indices", doubles(F.col("values")).alias("values")).filter("indices IS NOT NULL")
    ship(corpus.sparkSession)
    names = pa.field("query_id", to_arrow_type(_key(queries).dataType))
    asked = stored(asked.mapInArrow(_without_repeats, asked.schema), "asked")  # counted, then read by block
    total, n = asked.agg(F.sum(F.size("indices")), F.count(F.lit(1))).first()
    # of an entry its number, weight and part of an index, of a query its k best scores so far
    count = max(1, -(-(16 * (total or 0) + 8 * (k + 8) * n) // (4 * QUERY_BYTES)))

    def search(block: DataFrame) -> DataFrame:
        payload = corpus.sparkSession.sparkContext.broadcast(_sparse_block(block.toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, vocabulary, *_ = payload.value
            best = np.full((len(keys), k), -np.inf)
            floor, place = np.full(len(keys), -np.inf), np.full(len(vocabulary), -1, np.int32)
            for batch in batches:
                for _, piece in pieces(batch, 1, 4 * ENTRIES):
                    own = _identifiers(piece.column(0))
                    found, held = [], 0
                    with np.errstate(all="ignore"):  # infinities and NaN are data here
                        for some in _sparse_scores(piece, own, payload.value, best, floor, place, metric, k):
                            found.append(some)
                            held += len(some[0])
                            if held >= FOUND:
                                yield _sent_on(found, own, floor, k, keys, piece.column(0), names)
                                found, held = [], 0
                    if found:
                        yield _sent_on(found, own, floor, k, keys, piece.column(0), names)

        return rows.mapInArrow(run, f"query_id {_kind(queries)}, vec_id {rows.schema['vec_id'].dataType.simpleString()}, score double")

    return _result(_in_turn(blocks_of(asked, max(1, -(-n // count)), n), search), k)


def _without_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (identifier, indices, values) with repeated indices summed."""
    for batch in batches:
        for _, piece in pieces(batch, 1, ENTRIES):
            sizes, flat, w = _entries(piece)
            flat = flat.dictionary_encode(null_encoding="encode")
            row, code, w = _summed(np.repeat(np.arange(len(sizes)), sizes), flat.indices.to_numpy().astype(np.int64), w, max(1, len(flat.dictionary)))
            offsets = pa.array(np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, flat.dictionary.take(pa.array(code))), pa.ListArray.from_arrays(offsets, pa.array(w))
            yield pa.RecordBatch.from_arrays([piece.column(0), *lists], piece.schema.names)


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Sizes of the lists of rows (identifier, indices, values), and all indices and values."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, w = batch.column(1).flatten(), batch.column(2).flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(w):
        raise ValueError("indices and values differ in length")
    return sizes, flat, w


def _sparse_block(held: pa.Table) -> tuple:
    """Of queries without repeats: identifiers, different indices in order, and by query where its entries begin, the number of the
    index of each, its weight, and the length of the query. A null index counts for the length and meets nothing."""
    keys, lists, weight = held.column(0).combine_chunks(), held.column(1).combine_chunks(), held.column(2).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    del held
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    number, flat = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), lists.flatten().dictionary_encode()
    del lists
    with np.errstate(all="ignore"):
        length = np.sqrt(np.bincount(number, weight * weight, len(sizes)))
    order = pc.sort_indices(flat.dictionary).to_numpy()
    place = np.empty(len(order) + 1, np.int32)
    place[order], place[-1] = np.arange(len(order)), -1
    code = place[pc.fill_null(flat.indices, len(order)).to_numpy(zero_copy_only=False)]
    vocabulary = flat.dictionary.take(pa.array(order))
    del flat
    if len(code) and code.min() < 0:
        number, code, weight = (x[code >= 0] for x in (number, code, weight))
    order = np.argsort(number * np.int64(len(place)) + code)
    return keys, vocabulary, np.searchsorted(number, np.arange(len(sizes) + 1)), code[order], weight[order], length


def _first(owner: np.ndarray, score: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the k best of each owner, by owner, and the place of each; ties to the smaller name."""
    order = np.lexsort((names, -score, owner))
    sorted_owner = owner[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_owner, sorted_owner)
    return order[place < k], place[place < k]


def _sent_on(found: list[tuple], own: np.ndarray, floor: np.ndarray, k: int, keys: pa.Array, names: pa.Array, field: pa.Field) -> pa.RecordBatch:
    """found: (numbers of queries, of rows, scores)."""
    asked, rows, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    reach = np.flatnonzero(~(scores < floor[asked]))
    best = reach[_first(asked[reach], scores[reach], own[rows[reach]], k)[0]]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(asked[best])).cast(field.type), names.take(pa.array(rows[best])), pa.array(scores[best])], ["query_id", "vec_id", "score"])


def blocks_by_entries(queries: DataFrame, column: str) -> list[DataFrame]:
    """Query rows in blocks by the number of entries of ``column`` that they have in all, of about ``QUERY_BYTES``."""
    total, n = queries.agg(F.sum(F.size(column)), F.count(F.lit(1))).first()
    count = max(1, -(-32 * (total or 0) // QUERY_BYTES))
    return blocks_of(queries, max(1, -(-n // count)), n)


def coded(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different entries of lists in order, and of each entry its number among these and that of its list."""
    flat = lists.flatten().dictionary_encode()
    order = pc.sort_indices(flat.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)] if len(flat) else np.empty(0, np.int64)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return flat.dictionary.take(pa.array(order)), codes, np.repeat(np.arange(len(lists)), sizes).astype(np.int64)


def pieces(batch: pa.RecordBatch, column: int, most: int, rows: int | None = None) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of a batch, each with the number of its first row, of up to ``most`` list entries of a column (or one row) and up to ``rows`` rows."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        end = end if rows is None else min(end, at + rows)
        yield at, batch.slice(at, end - at)
        at = end


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _sparse_scores(batch: pa.RecordBatch, names: np.ndarray, sent: tuple, best: np.ndarray, floor: np.ndarray, place: np.ndarray, metric: str, k: int) -> Iterator[tuple]:
    """Queries, rows and scores of what can be among the k best of a query. ``best`` has the k best scores of each so far and ``floor``
    the last of them, which both rise here; ``place`` has -1 for each index of the queries, and is left so."""
    keys, vocabulary, start, asked_code, asked_weight, asked_length = sent
    sizes, flat, weights = _entries(batch)
    own = flat.dictionary_encode()
    number = pc.fill_null(own.indices, len(own.dictionary)).to_numpy(zero_copy_only=False)
    code_of = np.r_[pc.fill_null(pc.index_in(own.dictionary, value_set=vocabulary), -1).to_numpy(zero_copy_only=False), -1].astype(np.int64)
    first, length, parts = np.r_[0, np.cumsum(sizes)], np.ones(len(sizes)), []
    for at, piece in pieces(batch, 1, ENTRIES):
        end = at + piece.num_rows
        part, row = slice(first[at], first[end]), np.repeat(np.arange(at, end), sizes[at:end])
        if metric == "cosine":
            r, _, total = _summed(row, number[part].astype(np.int64), weights[part], len(code_of))
            length[at:end] = np.maximum(np.sqrt(np.bincount(r - at, total * total, end - at)), LEAST_NORM)
        code = code_of[number[part]]
        known = np.flatnonzero(code >= 0)
        row, code, w = _summed(row[known], code[known], weights[part][known], max(1, len(vocabulary)))
        parts.append((row.astype(np.int32), code.astype(np.int32), w))
    row, code, w = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
    del parts, number
    if not len(row):
        return
    begin = np.searchsorted(row, np.arange(len(sizes) + 1))
    signed = bool((asked_weight <= 0).any() or (w <= 0).any())
    finite = bool(np.isfinite(asked_weight).all() and np.isfinite(w).all())
    # sums of whole numbers are the same in any order; other sums are taken again in one order where they decide
    whole = finite and bool((asked_weight == np.rint(asked_weight)).all() and (w == np.rint(w)).all())
    reach, norms = np.sqrt(np.bincount(row, w * w, len(sizes))), np.maximum(asked_length, LEAST_NORM)
    whole = whole and bool(reach.max() * norms.max() < 2**52)
    # bounds of scores are products of these; the summands are for squares that are too small for doubles
    most, most_asked = reach + 1e-150, (asked_length + 1e-150) * (1 + 1e-9)
    if metric == "cosine":
        most, most_asked = most / length, most_asked / norms
    most = np.where(np.isnan(most), np.inf, most)
    order = np.flatnonzero(np.diff(begin))
    order = order[np.argsort(-most[order], kind="stable")]
    at, step = 0, FIRST_ROWS
    while at < len(order):
        live = np.flatnonzero(~(most_asked * most[order[at]] < floor) & (np.diff(start) > 0))
        if not len(live):
            break
        rows = order[at : at + min(step, max(1, CELLS // min(len(live), 4 * FIRST_ROWS)))]
        at, step = at + len(rows), 2 * step
        entry = ranges(begin[rows], begin[rows + 1] - begin[rows])
        there, term = np.unique(code[entry], return_inverse=True)
        place[there] = np.arange(len(there))
        met = np.repeat(np.arange(len(rows)), begin[rows + 1] - begin[rows]), term, w[entry]
        ends, many, a = np.cumsum(start[live + 1] - start[live]), max(1, CELLS // len(rows)), 0
        while a < len(live):
            b = min(a + many, max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + ENTRIES, "right"))))
            some, a = live[a:b], b
            entry = ranges(start[some], start[some + 1] - start[some])
            term = place[asked_code[entry]]
            both = np.flatnonzero(term >= 0)
            if not len(both):
                continue
            asked = np.repeat(np.arange(len(some)), start[some + 1] - start[some])[both], term[both], asked_weight[entry[both]]
            exact32 = whole and float(reach[rows].max() * norms[some].max()) < 2**24
            scores, shared = _products(asked, met, len(some), len(rows), len(there), signed, finite, np.float32 if exact32 else np.float64)
            error = 0.0
            if not whole:
                error = 4 * (int(np.diff(begin)[rows].max()) + 4) * _EPS * reach[rows] * norms[some][:, None]
            if metric == "cosine":
                scores = scores / length[rows] / norms[some][:, None]
                error = error / length[rows] / norms[some][:, None]
            reached = shared & ~(scores + error < floor[some][:, None])
            if whole and len(rows) > k:  # of many, those that reach the k-th of these
                crowded = np.flatnonzero(reached.sum(axis=1) > k)
                kth = np.partition(np.where(reached[crowded], scores[crowded], -np.inf), len(rows) - k, axis=1)[:, len(rows) - k]
                reached[crowded] &= scores[crowded] >= kth[:, None]
            q, r = np.nonzero(reached)
            s = scores[q, r].astype(float)
            if not whole:
                q, r, s = _scored_again(q, r, s, np.broadcast_to(error, scores.shape)[q, r], some, rows, sent, (row, code, w), length, norms, metric, k)
            good = np.flatnonzero((s > -np.inf) & ~(s < floor[some[q]]))
            good = good[_first(q[good], s[good], names[rows[r[good]]], k)[0]]
            if len(good):
                q, r, s = some[q[good]], rows[r[good]], s[good]
                risen, group = np.unique(q, return_inverse=True)
                more = np.full((len(risen), k), -np.inf)
                more[group, np.arange(len(q)) - np.searchsorted(q, q)] = s
                best[risen] = np.partition(np.concatenate([best[risen], more], axis=1), k, axis=1)[:, k:]
                floor[risen] = best[risen].min(axis=1)
                yield q, r, s
        place[there] = -1


def _products(asked: tuple, met: tuple, n: int, m: int, width: int, signed: bool, finite: bool, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Products of n queries with m rows, each as (numbers, indices below ``width``, weights), and which of them share an index. Indices
    that many of both have are columns of a product of matrices; each entry of the others goes to the rows that have its index."""
    owner, term, weight = asked
    row, there, w = met
    count, count_met = np.bincount(term, minlength=width), np.bincount(there, minlength=width)
    work = count * count_met
    hot = np.flatnonzero(work * CROWDED > n * m) if finite else np.empty(0, np.int64)
    hot = hot[np.argsort(-work[hot], kind="stable")[: 4 * CELLS // max(n, m)]]
    slot = np.full(width, -1)
    slot[hot] = np.arange(len(hot))
    column, column_met = slot[term], slot[there]
    table, dense = np.zeros((n, len(hot)), kind), np.zeros((m, len(hot)), kind)
    a, b = np.flatnonzero(column >= 0), np.flatnonzero(column_met >= 0)
    table[owner[a], column[a]] = weight[a]
    dense[row[b], column_met[b]] = w[b]
    scores = table @ dense.T
    if signed:  # an index may be there with no weight
        table[owner[a], column[a]], dense[row[b], column_met[b]] = 1, 1
        shared = table @ dense.T > 0
    rare, rare_met = np.flatnonzero(column < 0), np.flatnonzero(column_met < 0)
    rare_met = rare_met[np.argsort(there[rare_met], kind="stable")]
    begin = np.searchsorted(there[rare_met], np.arange(width + 1))
    rare = rare[begin[term[rare] + 1] > begin[term[rare]]]
    many = begin[term[rare] + 1] - begin[term[rare]]
    ends, at = np.cumsum(many), 0
    while at < len(rare):  # about CELLS pairs of entries at once
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
        e, other = np.repeat(rare[at:end], many[at:end]), rare_met[ranges(begin[term[rare[at:end]]], many[at:end])]
        cell = owner[e] * m + row[other]
        np.add.at(scores.reshape(-1), cell, (weight[e] * w[other]).astype(kind))
        if signed:
            shared.reshape(-1)[cell] = True
        at = end
    return scores, shared if signed else scores > 0


def _scored_again(q: np.ndarray, r: np.ndarray, s: np.ndarray, error: np.ndarray, some: np.ndarray, rows: np.ndarray, sent: tuple, entries: tuple, length: np.ndarray, norms: np.ndarray, metric: str, k: int) -> tuple:
    """Pairs that may be among the k best, with scores that are the same for equal rows."""
    _, _, start, code, weight, _ = sent
    out = [(q[:0], r[:0], s[:0])]
    cuts = np.searchsorted(q, np.arange(len(some) + 1))
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[i], cuts[i + 1])
        near = r[part][_near_top(s[part] - error[part], s[part] + error[part], k)]
        mine = slice(start[some[i]], start[some[i] + 1])
        exact = _in_order(code[mine], weight[mine], rows[near], *entries)
        exact = exact / length[rows[near]] / norms[some[i]] if metric == "cosine" else exact
        out.append((np.full(len(near), i), near, exact))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _in_order(terms: np.ndarray, weights: np.ndarray, rows: np.ndarray, row: np.ndarray, code: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Products of one query with rows, summed in the order of the indices: the same for equal rows wherever they stand."""
    first, last = np.searchsorted(row, rows), np.searchsorted(row, rows, "right")
    entry = ranges(first, last - first)
    at = np.minimum(np.searchsorted(terms, code[entry]), len(terms) - 1)
    both = terms[at] == code[entry]
    return np.bincount(np.repeat(np.arange(len(rows)), last - first)[both], w[entry][both] * weights[at][both], len(rows))


def maxsim_topk(queries: DataFrame, corpus: DataFrame, metric: str = "dot", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score over columns ``tokens`` (array of vectors): for each token of the query the best product with
    a token of the row, summed; the cosine takes tokens of unit length. Rows without a token, or with tokens of another length
    than the query's, are no candidates.
    """
    if metric not in ("dot", "cosine"):
        raise ValueError("the metric has to be dot or cosine")
    rows = corpus.select("vec_id", F.col("tokens").cast("array<array<double>>").alias("tokens")).filter("vec_id IS NOT NULL AND size(tokens) > 0")
    asked = queries.select("query_id", F.col("tokens").cast("array<array<double>>").alias("tokens")).filter("size(tokens) > 0")
    most, width, n = asked.agg(F.max(F.size("tokens")), F.max(F.size(F.col("tokens")[0])), F.count(F.lit(1))).first()

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(axis=1)), LEAST_NORM)[:, None] if metric == "cosine" else x

    def kernel(batch: pa.RecordBatch, sent: list, floors: dict) -> Iterator[tuple]:
        starts, sizes = _flat(batch.column(1))
        inner = batch.column(1).values
        begin, width_of = _flat(inner)
        flat, names = inner.values.to_numpy(zero_copy_only=False), _identifiers(batch.column(0))
        for width in {q.shape[1] for _, q in sent}:
            even = np.r_[0, np.cumsum(width_of == width)]
            picked = np.flatnonzero((sizes > 0) & (even[starts + sizes] - even[starts] == sizes))
            step = max(1, CELLS // max(1, 64 * (int(sizes[picked].max()) if len(picked) else 1)))
            for at in range(0, len(picked), step):
                here = picked[at : at + step]
                first = np.r_[0, np.cumsum(sizes[here])]
                token = np.repeat(starts[here] - first[:-1], sizes[here]) + np.arange(first[-1])
                d = unit(flat[begin[token][:, None] + np.arange(width)])
                longest = np.maximum.reduceat(np.sqrt((d * d).sum(axis=1)), first[:-1])
                for name, q in sent:
                    if q.shape[1] != width:
                        continue
                    q = unit(q)
                    s = np.maximum.reduceat(q @ d.T, first[:-1], axis=1).sum(axis=0)
                    error = 4 * (width + len(q) + 4) * _EPS * np.sqrt((q * q).sum(axis=1)).sum() * longest
                    near = np.flatnonzero(~(s + error < floors.get((name,), -np.inf)))
                    near = near[_near_top((s - error)[near], (s + error)[near], k)]
                    exact = np.array([(q[:, None, :] * d[None, first[x] : first[x + 1]]).sum(axis=2).max(axis=1).sum() for x in near])
                    best = _best(exact, names[here[near]], k, "drop")
                    yield (name,), here[near[best]], exact[best]

    def search(block: DataFrame) -> DataFrame:
        sent = [(r["query_id"], np.array(r["tokens"], float)) for r in block.collect()]  # at most QUERY_BYTES
        return _product_pass(rows, sent, kernel, [_key(queries)], k)

    return _result(_in_turn(blocks_of(asked, max(1, QUERY_BYTES // (8 * (most or 1) * (width or 1))), n), search), k)


# --- over lists -----------------------------------------------------------------------------------------------------
def kth_bound(partials: DataFrame, k: int, parts: int) -> DataFrame:
    """query_id, bound: a score the k-th result reaches at least, from the first max(1, min(k, ceil(2k / parts))) of each part."""
    width = max(1, min(k, -(-2 * k // parts)))
    top = partials.filter(F.col("rank") <= width).drop("rank")
    return ranked(top, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))


def trimmed(partials: DataFrame, bounds: DataFrame) -> DataFrame:
    """Entries of partial lists that can still be among the k best: those below the bound of their query go, ties and scores that
    are no finite numbers stay. ``bounds`` has a row for each query that is bounded."""
    finite = F.abs("score") < F.lit(float("inf"))
    kept = partials.join(bounds, "query_id", "left").filter(F.col("bound").isNull() | ~finite | F.isnan("score") | (F.col("score") >= F.col("bound")))
    return kept.select(*partials.columns)


def unreached(merged: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """query_id, bound, kth: queries whose merged list does not reach the bound that was applied; none if the trimming was right."""
    kth = merged.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    return bounds.join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("kth") < F.col("bound"))).select("query_id", "bound", "kth")


def fused(lists: list[DataFrame], k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion (Cormack et al., SIGIR 2009) of ranked lists."""
    every = union([x.select("query_id", "vec_id", "rank") for x in lists])
    scored = every.groupBy("query_id", "vec_id").agg(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("raw"))
    return _result(scored.select("query_id", "vec_id", F.round("raw", 12).alias("score")), k)
