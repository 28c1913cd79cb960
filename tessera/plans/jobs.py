"""Queries of results, ground truth, dates, loading and embedding, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions.dates import micros
from tessera.functions.vectors import doubles, tokens_of
from tessera.operators import embedding, load, positions, prepare, results, search, truth
from tessera.operators.embedding import Entry
from tessera.plans.catalogue import _C, _OUT, _Q, _RANK, _SCORE, _TIED, _TOKENS, K, _corpus, _parts, _queries, _rounded, _sql, _table, _terms, _tied, query
from tessera.sources import files, vectors
from tessera.sources.scratch import scratch_path, stored
from tessera.streaming import topk

_RANKS = f"WITH {_C}, {_Q}, s AS (SELECT query_id, vec_id, {_SCORE['dot']} AS score FROM q, c), {_RANK}"


# --- partial lists ------------------------------------------------------------------------------------------------
@query("merge_trimmed", _sql())
def merge_trimmed(spark: SparkSession, d: str) -> DataFrame:
    """Partial lists without what a bound from their first places rules out, merged."""
    parts = _parts(spark, d)
    bounds = search.kth_bound(search.union(parts), K, len(parts))
    merged = search.merge([search.trimmed(p, bounds) for p in parts], K)
    return _rounded(merged.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


@query(
    "merge_bounds_hold",
    f"WITH {_C}, {_Q}, s AS (SELECT query_id, vec_id, {_SCORE['dot']} AS score FROM q, c), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id % 4 ORDER BY score DESC, vec_id) AS pr, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), b AS (SELECT query_id, score AS bound FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p WHERE pr <= 5) WHERE n = 10), m AS (SELECT query_id, score AS kth FROM p WHERE rank = 10) SELECT query_id, round(bound, 6) + 0.0 AS bound, round(kth, 6) + 0.0 AS kth, kth >= bound AS reached FROM b LEFT JOIN m USING (query_id)",
)
def merge_bounds_hold(spark: SparkSession, d: str) -> DataFrame:
    """The bound that trimmed each query's lists, the k-th score of its merged list, and whether that reaches it."""
    parts = [stored(p, "part") for p in _parts(spark, d)]
    bounds = stored(search.kth_bound(search.union(parts), K, len(parts)), "bounds")
    merged = stored(search.merge([search.trimmed(p, bounds) for p in parts], K), "merged")
    short = search.unreached(merged, bounds, K).select("query_id", F.lit(True).alias("short"))
    kth = merged.filter(F.col("rank") == K).select("query_id", F.col("score").alias("kth"))
    told = bounds.join(kth, "query_id", "left").join(short, "query_id", "left")
    return told.select("query_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("bound", "kth")], F.coalesce(~F.col("short"), F.lit(True)).alias("reached"))


@query(
    "merge_validated",
    f"WITH {_TIED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT CAST(query_id AS VARCHAR) AS query_id, rank, CAST(vec_id AS VARCHAR) AS vec_id FROM r WHERE rank <= 10",
)
def merge_validated(spark: SparkSession, d: str) -> DataFrame:
    """Lists of four parts full of ties, checked against each other and merged: ties go by the number of the identifier."""
    number = F.array(F.col("label").cast("double"), F.lit(1.0))
    rows = _table(spark, d, "embeddings").select("vec_id", number.alias("embedding"))
    asked = _queries(spark, d).select("query_id", number.alias("embedding"))
    lists = [results.partial_lists(search.dense_topk(asked, rows.filter(F.col("vec_id") % 4 == i), "euclidean", K, nan="keep"), asked, i) for i in range(4)]
    return results.merge_lists(search.union(lists), K, 4, queries=asked).select("query_id", "rank", "vec_id")


@query(
    "merge_thresholds",
    f"WITH {_C}, {_Q}, s AS (SELECT query_id, vec_id, {_SCORE['dot']} AS score FROM q, c), {_RANK} SELECT CAST(query_id AS VARCHAR) AS query_id, rank, CAST(vec_id AS VARCHAR) AS vec_id, round(CAST(CAST(score AS FLOAT) AS DOUBLE), 3) + 0.0 AS score FROM r WHERE rank <= 10",
)
def merge_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Parts that began with the bounds of a sample and say so; the merge verifies that no list falls short of them."""
    rows, asked = _table(spark, d, "embeddings"), _queries(spark, d)
    bounds = stored(search.sampled_bounds(asked, rows, "dot", K, share=4), "bounds")
    lists = [results.partial_lists(search.dense_topk(asked, rows.filter(F.col("vec_id") % 4 == i), "dot", K, nan="keep", bounds=bounds), asked, i, bounds) for i in range(4)]
    found = results.merge_lists(search.union(lists), K, 4, queries=asked)
    return found.select("query_id", "rank", "vec_id", (F.round(F.col("score").cast("double"), 3) + F.lit(0.0)).alias("score"))


@query("threshold_scan", _sql())
def threshold_scan(spark: SparkSession, d: str) -> DataFrame:
    """A search in two jobs: a sixteenth of the corpus bounds the k-th score from below, so most rows are not scored in the second."""
    return _rounded(search.threshold_topk(_queries(spark, d), _table(spark, d, "embeddings"), "dot", K))


_NAN = "c.vec_id % 397 = 3"


@query(
    "nan_takes_a_slot",
    f"WITH {_C}, {_Q}, n AS (SELECT count(*) AS slots FROM c WHERE {_NAN}), s AS (SELECT query_id, vec_id, {_SCORE['dot']} AS score FROM q, c WHERE NOT ({_NAN})), {_RANK} SELECT query_id, rank, vec_id, round(score, 6) + 0.0 AS score FROM r, n WHERE rank <= 10 - slots",
)
def nan_takes_a_slot(spark: SparkSession, d: str) -> DataFrame:
    """Some vectors hold no numbers: their scores take places and are left out, in each part and in the whole."""
    rows = _table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 397 == 3, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding")))
    lists = [search.dense_topk(_queries(spark, d), rows.filter(F.col("vec_id") % 3 == i), "dot", K, nan="keep") for i in range(3)]
    return _rounded(search.merge(lists, K, nan="slot").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


@query("result_lists", f"{_RANKS}, l AS (SELECT query_id, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS hits, count(*) AS n, round(CAST(min(score) AS FLOAT), 3) AS last FROM r WHERE rank <= 10 GROUP BY query_id) SELECT CAST(q.query_id AS VARCHAR) AS query_id, q.q_label AS label, hits, CAST(n AS INTEGER) AS n, CAST(round(CAST(last AS DOUBLE), 3) AS DOUBLE) AS last FROM l JOIN q USING (query_id)")
def result_lists(spark: SparkSession, d: str) -> DataFrame:
    """One row a query: payload, hits best first, 32-bit scores."""
    asked = _queries(spark, d)
    lists = results.result_lists(search.dense_topk(asked, _table(spark, d, "embeddings"), "dot", K), asked, ["label"])
    return lists.select("query_id", "label", F.array_join("hit_ids", ",").alias("hits"), F.size("hit_ids").alias("n"), F.round(F.round(F.element_at("hit_scores", -1), 3).cast("double"), 3).alias("last"))


@query("short_lists", f"WITH {_C}, {_Q}, n AS (SELECT query_id, count(vec_id) AS n FROM q LEFT JOIN c ON label = q_label AND coalesce(source = 'src3', false) GROUP BY 1) SELECT count(*) FILTER (n < 10) AS short, count(*) AS queries FROM n")
def short_lists(spark: SparkSession, d: str) -> DataFrame:
    """A filter that leaves few candidates gives short lists."""
    asked = _queries(spark, d)
    spec = {"must": [{"field": "label", "match_from_query": "label"}, {"field": "source", "match": "src3"}]}
    found = search.filtered_topk(asked, _corpus(spark, d, spec), spec, "dot", K)
    return results.short_lists(results.result_lists(found, asked), K)


@query("late_payload", f"WITH {_C}, {_Q}, s AS (SELECT query_id, vec_id, label, {_SCORE['dot']} AS score FROM q, c), {_RANK} SELECT query_id, rank, vec_id, label FROM r WHERE rank <= 10")
def late_payload(spark: SparkSession, d: str) -> DataFrame:
    """Payload columns are read for the winners alone, after the search."""
    rows = _table(spark, d, "embeddings")
    found = search.dense_topk(_queries(spark, d), rows, "dot", K)
    return rows.select("vec_id", "label").join(found, "vec_id").select("query_id", "rank", "vec_id", "label")


@query("late_fetch", f"WITH o AS (SELECT vec_id, row_number() OVER () AS place FROM embeddings), {_C}, {_Q}, s AS (SELECT query_id, c.vec_id, label, place, {_SCORE['cosine']} AS score FROM q, c JOIN o ON o.vec_id = c.vec_id), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, place) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, label, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 10")
def late_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The search sees places and vectors; identifiers and labels are read by file and row, for the winners alone."""
    path = f"{d}/embeddings.parquet"
    places = positions.layout(spark, path)
    rows = positions.positioned(spark, places, path).select(F.col("place").alias("vec_id"), "embedding")
    found = search.dense_topk(_queries(spark, d), rows, "cosine", K)
    return _rounded(positions.with_payload(spark, places, found, ["vec_id", "label"]))


_MANY = {"plain": {}, "cosine_en": {"metric": "cosine", "where": {"must": [{"field": "label", "match": [1, 2, 3]}]}}, "near": {"metric": "euclidean", "k": 5}}


@query(
    "many_specs",
    f"WITH {_C}, {_Q}, s AS (SELECT 'plain' AS spec, 10 AS k, query_id, vec_id, {_SCORE['dot']} AS score FROM q, c UNION ALL SELECT 'cosine_en', 10, query_id, vec_id, {_SCORE['cosine']} FROM q, c WHERE label IN (1, 2, 3) UNION ALL SELECT 'near', 5, query_id, vec_id, {_SCORE['euclidean']} FROM q, c), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY spec, query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT spec, query_id, rank, vec_id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= k",
)
def many_specs(spark: SparkSession, d: str) -> DataFrame:
    """Three searches in one pass."""
    return _rounded(search.dense_topk_many(_queries(spark, d), _table(spark, d, "embeddings"), _MANY))


@query("streamed_topk", _sql())
def streamed_topk(spark: SparkSession, d: str) -> DataFrame:
    """The files of the table as a stream, one micro-batch each; lists are kept as state."""
    rows = spark.readStream.schema(_table(spark, d, "embeddings").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/embeddings.parquet*")  # a pattern, so that it may be a file or a folder
    state = scratch_path(spark, "lists")
    topk.running_topk(spark, rows, _queries(spark, d), state, scratch_path(spark, "stream"), "dot", K).awaitTermination()
    return _rounded(topk.latest(spark, state))


# --- ground truth ---------------------------------------------------------------------------------------------------
@query("truth_problems", "SELECT vec_id AS query_id, CASE vec_id % 500 WHEN 100 THEN 'scores must be finite' WHEN 200 THEN 'scores are not sorted best first' WHEN 300 THEN 'ids and scores differ in length' END AS problem FROM embeddings WHERE vec_id % 100 = 0")
def truth_problems(spark: SparkSession, d: str) -> DataFrame:
    lists = truth.lists_of(search.dense_topk(_queries(spark, d), _table(spark, d, "embeddings"), "dot", K))
    case = F.col("query_id") % 500
    s = F.col("scores")
    odd = F.when(case == 100, F.concat(s, F.array(F.lit(float("nan"))))).when(case == 200, F.concat(F.slice(s, 2, K), F.slice(s, 1, 1))).when(case == 300, F.slice(s, 1, 3)).otherwise(s)
    lists = lists.withColumns({"scores": odd, "ids": F.when(case == 100, F.concat("ids", F.array(F.lit(-1).cast("long")))).otherwise(F.col("ids"))})
    return lists.select("query_id", truth.problem().alias("problem"))


@query("truth_oriented", f"{_RANKS} SELECT query_id, round(min(score), 6) + 0.0 AS cutoff, true AS known, min(score) > 0 AS comparable FROM r WHERE rank <= 10 GROUP BY query_id")
def truth_oriented(spark: SparkSession, d: str) -> DataFrame:
    """A truth of negated products, which rises with the rank, against an engine for which more is better."""
    rising = search.dense_topk(_queries(spark, d), _table(spark, d, "embeddings"), "dot", K).withColumn("score", -F.col("score"))
    return truth.orientation(rising, K).select("query_id", (F.round("cutoff", 6) + F.lit(0.0)).alias("cutoff"), "known", "comparable")


_DISTANCES = f"""WITH {_C}, {_Q},
 gt AS (SELECT * FROM (SELECT query_id, vec_id, {_SCORE['euclidean']} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_SCORE['euclidean']} DESC, vec_id) AS rank FROM q, c) WHERE rank <= 10),
 fo AS (SELECT * FROM (SELECT query_id, vec_id, -list_distance(qv[1:48], v[1:48]) AS score, row_number() OVER (PARTITION BY query_id ORDER BY -list_distance(qv[1:48], v[1:48]) DESC, vec_id) AS rank FROM q, c) WHERE rank <= 10),
 cut AS (SELECT query_id, min(score) AS cutoff FROM gt GROUP BY 1),
 j AS (SELECT fo.query_id, fo.score, cutoff, gt.vec_id IS NOT NULL AS hit, abs(fo.score - cutoff) <= 0.02 * (1 + abs(cutoff)) AS near FROM fo JOIN cut USING (query_id) LEFT JOIN gt USING (query_id, vec_id))"""


@query("recall_oriented", f"{_DISTANCES} SELECT query_id, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit AND near) AS near_ties, count(*) FILTER (NOT hit AND NOT near AND score > cutoff) AS missing, CAST(10 AS BIGINT) AS denom, false AS short, count(*) FILTER (hit) / 10.0 AS recall, least(1.0, count(*) FILTER (hit OR near) / 10.0) AS recall_tolerant, true AS compared FROM j GROUP BY query_id")
def recall_oriented(spark: SparkSession, d: str) -> DataFrame:
    """Raw distances of an engine that sees 48 of 64 numbers against negated distances as the truth."""
    rows, asked = _table(spark, d, "embeddings"), _queries(spark, d)
    cut = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 48))
    found = search.dense_topk(cut(asked), cut(rows), "euclidean", K).withColumn("score", -F.col("score"))
    return truth.oriented_recall(found, search.dense_topk(asked, rows, "euclidean", K), K, 0.02, higher_is_better=False)


_DEEP = 100
_TRUTH = f"{_TIED}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s), deep AS (SELECT * FROM t WHERE rank <= {_DEEP}), inside AS (SELECT query_id, vec_id, score, CAST(rank - 1 AS INTEGER) AS place, CAST(min(rank) OVER (PARTITION BY query_id, score) - 1 AS INTEGER) AS tied_place FROM deep WHERE rank <= 10), beyond AS (SELECT d.query_id, d.vec_id, CAST(NULL AS INTEGER) AS place, i.tied_place FROM deep d JOIN inside i ON i.query_id = d.query_id AND i.place = 9 AND d.score = i.score WHERE d.rank > 10)"


def _tied_truth(spark: SparkSession, d: str) -> DataFrame:
    return _tied(spark, d, _DEEP)


@query("tied_ranks", f"WITH {_TRUTH} SELECT query_id, vec_id, place, tied_place FROM inside")
def tied_ranks(spark: SparkSession, d: str) -> DataFrame:
    return truth.ranks(_tied_truth(spark, d), K)


@query("cutoff_ties", f"WITH {_TRUTH} SELECT query_id, vec_id, tied_place FROM beyond")
def cutoff_ties(spark: SparkSession, d: str) -> DataFrame:
    return truth.cutoff_ties(_tied_truth(spark, d), K)


@query(
    "rbo_tied",
    f"""WITH {_TRUTH}, f AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) - 1 AS pos FROM s),
 m AS (SELECT query_id, vec_id, place, tied_place FROM inside UNION ALL SELECT * FROM beyond),
 met AS (SELECT f.query_id, pos, place, tied_place + row_number() OVER (PARTITION BY f.query_id, tied_place ORDER BY pos) - 1 AS slot FROM f JOIN m USING (query_id, vec_id) WHERE pos < 10),
 g AS (SELECT q.query_id, d, (SELECT count(*) FROM met WHERE met.query_id = q.query_id AND place IS NOT NULL AND greatest(pos, place) + 1 <= d) AS e, (SELECT count(*) FROM met WHERE met.query_id = q.query_id AND slot < 10 AND greatest(pos, slot) + 1 <= d) AS t FROM q, range(1, 11) r(d))
 SELECT query_id, CAST(10 AS INTEGER) AS depth, max(e) AS overlap, round(sum((1 - pow(0.01, 0.1)) * pow(pow(0.01, 0.1), d - 1) * e / d), 6) AS rbo, round(sum((1 - pow(0.01, 0.1)) * pow(pow(0.01, 0.1), d - 1) * t / d), 6) AS rbo_tolerant FROM g GROUP BY query_id""",
)
def rbo_tied(spark: SparkSession, d: str) -> DataFrame:
    """An engine that orders ties by the text of the identifier, against a truth that orders them by number."""
    found = _tied(spark, d, K, "string")
    got = truth.overlap_tolerant(found, _tied_truth(spark, d), K)
    return got.select("query_id", "depth", "overlap", F.round("rbo", 6).alias("rbo"), F.round("rbo_tolerant", 6).alias("rbo_tolerant"))


@query("rbo_residual", "SELECT 'full' AS bucket, round(max(pow(pow(0.01, 0.1), CAST(label + 1 AS DOUBLE))) FILTER (label >= 5), 6) AS residual FROM embeddings UNION ALL SELECT 'short', round(max(pow(pow(0.01, 0.1), CAST(label + 1 AS DOUBLE))) FILTER (label < 5), 6) FROM embeddings")
def rbo_residual(spark: SparkSession, d: str) -> DataFrame:
    depths = _table(spark, d, "embeddings").select((F.col("label") + 1).alias("depth"), (F.col("label") < 5).alias("short"))
    return truth.worst_residual(depths, K).select("bucket", F.round("residual", 6).alias("residual"))


@query(
    "run_counters",
    "WITH a AS (SELECT vec_id, label <> 3 AND label <> 4 AS ok, label = 4 AS late, CASE WHEN label NOT IN (3, 4) THEN label END AS returned, CASE WHEN vec_id % 3 <> 0 THEN CASE WHEN vec_id % 7 = 0 THEN 0 ELSE 6 END END AS ids FROM embeddings) SELECT count(*) AS firings, count(*) FILTER (NOT ok AND NOT late) AS errors, count(*) FILTER (late) AS timeouts, count(*) FILTER (returned < coalesce(ids, 0)) AS short_returns, count(*) FILTER (ids > 0 AND returned > ids) AS filter_overreturn, count(*) FILTER (returned IS NOT NULL AND ids = 0) AS empty_ground_truth FROM a",
)
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    """A made-up run: labels 3 and 4 failed and timed out, the others returned as many ids as their label says."""
    rows = _table(spark, d, "embeddings").withColumnRenamed("vec_id", "query_id")
    failed = F.col("label").isin(3, 4)
    answers = rows.select("query_id", (~failed).alias("ok"), (F.col("label") == 4).alias("timed_out"), F.when(~failed, F.col("label")).alias("returned"))
    known = rows.select("query_id", F.when(F.col("query_id") % 3 != 0, F.when(F.col("query_id") % 7 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.lit(6)))).alias("ids"))
    return truth.counters(answers, known, K, filtered=True)


# --- dates ----------------------------------------------------------------------------------------------------------
@query(
    "date_formats",
    "WITH t AS (SELECT event_id, epoch_us(ts) // 1000000 AS s, epoch_us(date_trunc('day', ts)) AS day FROM events) SELECT event_id, s * 1000000 AS spaced, s * 1000000 - 7200000000 AS shifted, day AS dated, s * 1000000 AS seconds, s * 1000000 AS millis, s * 1000000 AS patterned FROM t",
)
def date_formats(spark: SparkSession, d: str) -> DataFrame:
    """One point in time written in six ways."""
    ts = F.timestamp_seconds(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    rows = _table(spark, d, "events").select("event_id", ts.alias("ts"))
    rows = rows.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("spaced"),
        F.concat(F.date_format("ts", "yyyy-MM-dd't'HH:mm:ss"), F.lit("+02")).alias("shifted"),
        F.date_format("ts", "yyyy-MM-dd").alias("dated"),
        F.unix_seconds("ts").alias("seconds"),
        (F.unix_seconds("ts") * 1000).alias("millis"),
        F.date_format("ts", "dd/MM/yyyy HH.mm.ss").alias("patterned"),
    )
    formats = {"seconds": "epoch_s", "millis": "epoch_ms", "patterned": "%d/%m/%Y %H.%M.%S"}
    return rows.select("event_id", *[micros(F.col(c), rows.schema[c].dataType, formats.get(c, "rfc3339")).alias(c) for c in rows.columns[1:]])


# --- sources and loading --------------------------------------------------------------------------------------------
@query("sparse_structs", f"WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents), w AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL) SELECT doc_id, count(*) AS terms, CAST(sum(n) AS DOUBLE) AS weight, CAST(max(n) AS DOUBLE) AS most FROM w GROUP BY doc_id")
def sparse_structs(spark: SparkSession, d: str) -> DataFrame:
    """A struct column of indices and values to entries, repeated indices summed."""
    rows = _terms(spark, d).select(F.col("vec_id").alias("doc_id"), F.struct("indices", "values").alias("s"))
    return vectors.sparse_entries(vectors.sparse(rows, "s"), "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("weight").alias("weight"), F.max("weight").alias("most"))


@query("multivector_rows", "SELECT vec_id, CAST(i AS INTEGER) AS token, round(list_sum(CAST(embedding AS DOUBLE[])[i * 8 + 1 : i * 8 + 8]), 6) + 0.0 AS total FROM embeddings, range(8) r(i) WHERE vec_id % 5 <> 0")
def multivector_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lists of lists to a row for each token; null rows give none."""
    tokens = F.when(F.col("vec_id") % 5 != 0, tokens_of(doubles(F.col("embedding")), 8, 8))
    rows = vectors.token_rows(_table(spark, d, "embeddings").select("vec_id", tokens.alias("m")), "m")
    return rows.select("vec_id", "token", (F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6) + F.lit(0.0)).alias("total"))


@query("dense_checked", "SELECT count(*) AS n, CAST(64 AS INTEGER) AS dims FROM embeddings")
def dense_checked(spark: SparkSession, d: str) -> DataFrame:
    return vectors.dense(_table(spark, d, "embeddings"), "embedding").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims"))


@query("query_scan", "SELECT vec_id, label FROM (SELECT *, row_number() OVER () AS n FROM embeddings) WHERE label IN (3, 5) ORDER BY n LIMIT 7")
def query_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first seven queries, in file order, that a predicate keeps."""
    return vectors.query_scan(files.scan(spark, f"{d}/embeddings.parquet"), "embedding", "label IN (3, 5)", 7).select("vec_id", "label")


@query("load_points", "SELECT regexp_replace(md5('documents.parquet:' || (row_number() OVER () - 1)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS __id, source AS __shard_key, upper(lang) AS text, length(text) AS lang, n_chars + 1 AS n FROM documents")
def load_points(spark: SparkSession, d: str) -> DataFrame:
    """Identifier, shard key and payload by SQL expressions; payload names that are source columns too hide nothing."""
    load.register_functions(spark)
    path = f"{d}/documents.parquet"
    rows = positions.positioned(spark, positions.layout(spark, path), path)  # a table of several files: each starts its row numbers again
    return load.points(rows, "make_point_id('documents.parquet', place)", payload={"text": "upper(lang)", "lang": "length(text)", "n": "n_chars + 1"}, shard_key="source")


@query("payload_json", "SELECT s_suppkey, to_json({'s_suppkey': s_suppkey, 's_name': s_name, 's_nationkey': CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END}) AS payload FROM supplier")
def payload_json(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "supplier").withColumn("s_nationkey", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")))
    return rows.select("s_suppkey", load.payload_json(rows, "s_suppkey", "s_name", "s_nationkey").cast("string").alias("payload"))


@query("poured_points", "SELECT source, count(*) AS points, CAST(sum(doc_id) AS BIGINT) AS ids, CAST(ceil(count(*) / 100.0) AS BIGINT) <= count(*) AS batched FROM documents GROUP BY source")
def poured_points(spark: SparkSession, d: str) -> DataFrame:
    """All documents through the batching writer, by source, to a folder of files; read back from there."""
    folder = scratch_path(spark, "poured")
    told = stored(load.pour(_table(spark, d, "documents").select("doc_id", "source"), load.FolderSender(folder), "source", 100), "told")
    failed = told.agg(F.sum("failed")).first()[0]
    if failed:
        raise RuntimeError(f"{failed} batches failed")
    return spark.read.parquet(folder).groupBy("source").agg(F.count(F.lit(1)).alias("points"), F.sum("doc_id").alias("ids"), F.lit(True).alias("batched"))


# --- embedding ------------------------------------------------------------------------------------------------------
_CUT = "(SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS tokens FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^\\x20\\x09-\\x0D]'))"
_SLOT = "CAST('0x' || substr(md5(token), 1, 8) AS BIGINT) % 16"


@query("embed_batch", f"WITH t AS (SELECT doc_id, unnest(tokens) AS token FROM {_CUT}), n AS (SELECT doc_id, {_SLOT} AS j, count(*) AS n FROM t GROUP BY ALL) SELECT b.doc_id, CAST(r.j AS INTEGER) AS j, CAST(coalesce(n.n, 0) AS FLOAT) AS value FROM {_CUT} b CROSS JOIN range(16) r(j) LEFT JOIN n ON n.doc_id = b.doc_id AND n.j = r.j")
def embed_batch(spark: SparkSession, d: str) -> DataFrame:
    """Dense embeddings of whole texts; empty texts have none."""
    rows = embedding.embed(_table(spark, d, "documents").select("doc_id", "text"), [Entry("e", "dense", "hashing", input_column="text")])
    return rows.select("doc_id", F.posexplode("e_embedding").alias("j", "value"))


@query(
    "embed_fused",
    f"WITH t AS (SELECT doc_id, unnest(tokens) AS token FROM {_CUT}), s AS (SELECT doc_id, {_SLOT} AS slot FROM t), n AS (SELECT doc_id, count(*) AS total, count(DISTINCT slot) AS slots, count(*) FILTER (slot = 3) AS third FROM s GROUP BY doc_id) SELECT doc_id, CAST(coalesce(total, 0) AS DOUBLE) AS dense_total, CAST(coalesce(slots, 0) AS INTEGER) AS sparse_size, CAST(coalesce(total, 0) AS INTEGER) AS tokens, round(CASE WHEN total > 0 THEN third / CAST(total AS DOUBLE) END, 5) AS pooled_third FROM {_CUT} LEFT JOIN n USING (doc_id)",
)
def embed_fused(spark: SparkSession, d: str) -> DataFrame:
    """Three kinds from one pass, and the mean of the token vectors."""
    entries = [Entry(k, k, "hashing", input_column="text", pooling="mean" if k == "multivector" else None) for k in ("dense", "sparse", "multivector")]
    rows = embedding.embed(_table(spark, d, "documents").select("doc_id", "text"), entries, drop=["text"]).filter("dense_embedding IS NOT NULL")
    total = F.aggregate("dense_embedding", F.lit(0.0), lambda s, x: s + x)
    return rows.select("doc_id", total.alias("dense_total"), F.size("sparse_embedding.indices").alias("sparse_size"), F.size("multivector_embedding").alias("tokens"), F.round(F.get("multivector_pooled", 3), 5).alias("pooled_third"))


@query("embed_skipped", "SELECT 'body' AS entry, count(*) AS seen, count(*) FILTER (text IS NULL OR NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]')) AS skipped FROM documents UNION ALL SELECT 'tag', count(*), count(*) FILTER (lang IS NULL OR lang = '') FROM documents")
def embed_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Rows seen and skipped, counted by the embedding pass itself."""
    told = Observation()
    entries = [Entry("body", "dense", "hashing", input_column="text"), Entry("tag", "dense", "hashing", input_column="lang")]
    stored(embedding.embed(_table(spark, d, "documents").select("doc_id", "text", "lang"), entries, drop=["text"], observation=told), "embedded")
    counts = told.get
    return spark.createDataFrame([(e.name, counts["seen"], counts[f"skipped_{e.name}"]) for e in entries], "entry string, seen bigint, skipped bigint")


@query(
    "lognormal_gap",
    """WITH l AS (SELECT CAST(n_chars AS DOUBLE) AS x, count(*) AS n FROM documents WHERE n_chars > 0 GROUP BY 1),
 f AS (SELECT sum(n) AS t, sum(n * ln(x)) / sum(n) AS mu, sqrt(sum(n * ln(x) * ln(x)) / sum(n) - pow(sum(n * ln(x)) / sum(n), 2)) AS sigma FROM l),
 z AS (SELECT (ln(x) - mu) / sigma / sqrt(2.0) AS z, n, t, sum(n) OVER (ORDER BY x) AS upto, mu, sigma FROM l, f),
 b AS (SELECT *, 1 / (1 + 0.3275911 * abs(z)) AS k FROM z),
 c AS (SELECT *, (1 + sign(z) * (1 - k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429)))) * exp(-z * z))) / 2 AS below FROM b)
 SELECT round(max(mu), 5) AS mu, round(max(sigma), 5) AS sigma, round(max(greatest(abs(below - upto / CAST(t AS DOUBLE)), abs(below - (upto - n) / CAST(t AS DOUBLE)))), 5) AS ks FROM c""",
)
def lognormal_gap(spark: SparkSession, d: str) -> DataFrame:
    return prepare.lognormal_gap(_table(spark, d, "documents"), "n_chars").select(*[F.round(c, 5).alias(c) for c in ("mu", "sigma", "ks")])


@query("predict_cost", "SELECT p_partkey, round(1e6 / (1 / (1 / (50 * 1e12 / (2 * (p_retailprice * 1e6)) * 0.35 / (p_size * 10)) + 1 / (50 * 1e12 / (2 * 3e8) * 0.35 / (p_size * 10)))) / 3600 * 1.5 * 1.2, 4) AS cost FROM part")
def predict_cost(spark: SparkSession, d: str) -> DataFrame:
    """The price of two passes, one after the other, over a million rows."""
    tokens = F.col("p_size") * 10
    rate = prepare.combined([prepare.throughput(F.lit(50), p, F.lit(0.35), tokens) for p in (F.col("p_retailprice") * 1e6, F.lit(3e8))])
    return _table(spark, d, "part").select("p_partkey", F.round(prepare.cost(F.lit(1e6), rate, F.lit(1.5)), 4).alias("cost"))
