"""Queries by name over the test tables, one or more for each operator, and the SQL that gives the same rows.

Vectors are ``embeddings``; a vector's payload is the document and the event of the same number, null where there is none.
Queries are the vectors (or documents) whose number ``EACH`` divides, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import point_id, tokens
from tessera.functions.vectors import doubles, pooled, tokens_of
from tessera.operators import evaluate, filters, joins, positions, prepare, search
from tessera.plans import grid
from tessera.sources import files
from tessera.sources.shipping import sound_unions

K = 10
#: Queries are the rows whose number this divides.
EACH = 100
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _asked(name: str) -> Column:
    return F.col(name) % EACH == 0


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    sound_unions(spark)
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return files.spread(rows) if name == "documents" else rows  # long texts


def _corpus(spark: SparkSession, d: str, spec: dict) -> DataFrame:
    """Vectors with the payload that a filter names."""
    fields = {c["field"] for part in spec.values() for c in part}
    out = _table(spark, d, "embeddings")
    if found := sorted(fields & {"text", "lang", "source", "n_chars"}):
        out = out.join(_table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), *found), "vec_id", "left")
    if found := sorted(fields & {"ts", "value"}):
        out = out.join(_table(spark, d, "events").select(F.col("event_id").alias("vec_id"), *found), "vec_id", "left")
    return out


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").filter(_asked("vec_id")).select(F.col("vec_id").alias("query_id"), "embedding", "label")


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.round("score", 6) + F.lit(0.0))


_C = """c AS (SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS v, e.label, d.text, d.lang, d.source, d.n_chars, ev.ts, ev.value
  FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN events ev ON ev.event_id = e.vec_id)"""
_Q = "q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv, label AS q_label FROM embeddings WHERE vec_id % 100 = 0)"
_SCORE = {
    "dot": "list_dot_product(qv, v)",
    "cosine": "list_dot_product(qv, v) / greatest(sqrt(list_dot_product(v, v)), 1e-12) / greatest(sqrt(list_dot_product(qv, qv)), 1e-12)",
    "euclidean": "-list_distance(qv, v)",
}
_RANK = "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)"
_OUT = "SELECT query_id, rank, vec_id, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 10"


def _sql(where: str = "true", metric: str = "dot", score: str | None = None) -> str:
    return f"WITH {_C}, {_Q}, s AS (SELECT query_id, vec_id, {score or _SCORE[metric]} AS score FROM q, c WHERE {where}), {_RANK} {_OUT}"


# --- dense search -------------------------------------------------------------------------------------------------
def _dense(metric: str):
    return lambda spark, d: _rounded(search.dense_topk(_queries(spark, d), _table(spark, d, "embeddings"), metric, K))


for _metric, _name in (("dot", "dense_dot_topk"), ("cosine", "dense_cosine_topk"), ("euclidean", "dense_euclid_topk")):
    query(_name, _sql(metric=_metric))(_dense(_metric))


@query("dense_shared_metrics", f"WITH {_C}, {_Q} SELECT query_id, vec_id, round({_SCORE['dot']}, 6) + 0.0 AS dot, round({_SCORE['cosine']}, 6) + 0.0 AS cosine, round({_SCORE['euclidean']}, 6) + 0.0 AS euclid FROM q, c")
def dense_shared_metrics(spark: SparkSession, d: str) -> DataFrame:
    found = search.dense_scores(_queries(spark, d), _table(spark, d, "embeddings"))
    return found.select("query_id", "vec_id", *[(F.round(c, 6) + F.lit(0.0)).alias(n) for n, c in (("dot", "dot"), ("cosine", "cosine"), ("euclid", "euclidean"))])


# --- filters ------------------------------------------------------------------------------------------------------
def _filtered(name: str, spec: dict, where: str, dates: tuple[str, ...] = ()) -> None:
    query(name, _sql(where))(lambda spark, d: _rounded(search.dense_topk(_queries(spark, d), _corpus(spark, d, spec), "dot", K, spec, dates)))


_TOKENS = r"list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x))"
_filtered("filter_match", {"must": [{"field": "lang", "match": "en"}]}, "coalesce(lang = 'en', false)")
_filtered("filter_match_any", {"must": [{"field": "source", "match": ["src1", "src2", "src7"]}]}, "coalesce(source IN ('src1', 'src2', 'src7'), false)")
_filtered("filter_match_exact_integer", {"must": [{"field": "label", "match": [2.0, 3.5, 1e30]}]}, "label = 2")
_filtered("filter_range_int", {"must": [{"field": "n_chars", "range": {"gte": 199.5, "lt": 2000}}]}, "coalesce(n_chars >= 200 AND n_chars < 2000, false)")
_filtered("filter_range_float", {"must": [{"field": "value", "range": {"gt": 2.5, "lte": 20.0}}]}, "coalesce(value > 2.5 AND value <= 20.0, false)")
_filtered("filter_date_range", {"must": [{"field": "ts", "range": {"gte": "2024-01-01T03:00:00", "lt": "2024-01-01T12:00:00"}}]}, "coalesce(ts >= TIMESTAMP '2024-01-01 03:00:00' AND ts < TIMESTAMP '2024-01-01 12:00:00', false)", ("ts",))
_filtered("filter_must_not_null", {"must_not": [{"field": "lang", "match": "en"}]}, "NOT coalesce(lang = 'en', false)")
_filtered("filter_should", {"should": [{"field": "lang", "match": "fr"}, {"field": "label", "range": {"gte": 8}}]}, "coalesce(lang = 'fr', false) OR label >= 8")
_filtered(
    "filter_compound",
    {"must": [{"field": "n_chars", "range": {"gt": 100}}], "should": [{"field": "label", "match": [1, 2, 3]}, {"field": "source", "match": "src4"}], "must_not": [{"field": "lang", "match": "de"}]},
    "coalesce(n_chars > 100, false) AND (label IN (1, 2, 3) OR coalesce(source = 'src4', false)) AND NOT coalesce(lang = 'de', false)",
)
_filtered("filter_text", {"must": [{"field": "text", "match_text": "The, WITH"}]}, f"text IS NOT NULL AND list_has_all({_TOKENS}, ['the', 'with'])")
_filtered("topk_short_lists", {"must": [{"field": "source", "match": "src3"}, {"field": "label", "match": [4, 5]}]}, "coalesce(source = 'src3', false) AND label IN (4, 5)")


def _per_query(name: str, spec: dict, where: str, extra: Callable, sql_queries: str) -> None:
    sql = f"WITH {_C}, {sql_queries}, s AS (SELECT query_id, vec_id, {_SCORE['dot']} AS score FROM q, c WHERE {where}), {_RANK} {_OUT}"
    query(name, sql)(lambda spark, d: _rounded(search.filtered_topk(extra(spark, d), _corpus(spark, d, spec), spec, "dot", K)))


_per_query("perquery_match", {"must": [{"field": "label", "match_from_query": "label"}]}, "label = q_label", _queries, _Q)
_per_query(
    "perquery_match_any", {"must": [{"field": "label", "match_from_query": "labels"}]}, "label IN (q_label, (q_label + 1) % 10)", lambda s, d: _queries(s, d).withColumn("labels", F.array("label", ((F.col("label") + 1) % 10).cast("int"))), _Q
)
_per_query(
    "perquery_range",
    {"must": [{"field": "n_chars", "range_from_query": {"gte": "low", "lt": "high"}}]},
    "coalesce(n_chars >= query_id AND n_chars < query_id + 1500, false)",
    lambda s, d: _queries(s, d).withColumns({"low": F.col("query_id"), "high": F.col("query_id") + 1500}),
    _Q,
)
_PHRASES = ("the", "by of", "le la", "der und", "...")
_per_query(
    "perquery_text",
    {"must": [{"field": "text", "match_text_from_query": "phrase"}]},
    f"len(words) > 0 AND text IS NOT NULL AND list_has_all({_TOKENS}, words)",
    lambda s, d: _queries(s, d).withColumn("phrase", F.element_at(F.array(*map(F.lit, _PHRASES)), (F.floor(F.col("query_id") / EACH) % 5 + 1).cast("int"))),
    r"q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv, regexp_extract_all(['the', 'by of', 'le la', 'der und', '...'][vec_id // 100 % 5 + 1], '[\p{L}\p{N}]+') AS words FROM embeddings WHERE vec_id % 100 = 0)",
)


#: Ranges of very different widths: a few characters, thousands, no upper bound, and none at all (an empty range).
_WIDTHS = (3, 500, 20_000, None, -1)


@query(
    "range_join_wide",
    "WITH q AS (SELECT doc_id, n_chars AS low, CASE doc_id // 100 % 5 WHEN 0 THEN n_chars + 3 WHEN 1 THEN n_chars + 500 WHEN 2 THEN n_chars + 20000 WHEN 3 THEN 1e18 ELSE n_chars - 1 END AS high FROM documents WHERE doc_id % 100 = 0) SELECT q.doc_id AS query_id, count(d.doc_id) AS matched, CAST(coalesce(sum(d.n_chars), 0) AS BIGINT) AS chars FROM q LEFT JOIN documents d ON d.n_chars >= low AND d.n_chars <= high GROUP BY q.doc_id",
)
def range_join_wide(spark: SparkSession, d: str) -> DataFrame:
    """For every query the documents whose length lies in its range."""
    rows = _table(spark, d, "documents").select("doc_id", "n_chars")
    case = (F.floor(F.col("doc_id") / EACH) % 5).cast("int")
    high = F.when(case == 3, F.lit(1e18))
    for i, width in enumerate(_WIDTHS):
        high = high if width is None else high.when(case == i, F.col("n_chars") + F.lit(width))
    asked = rows.filter(_asked("doc_id")).select(F.col("doc_id").alias("query_id"), F.col("n_chars").alias("low"), high.alias("high"))
    found = joins.range_join(rows, "n_chars", asked, "low", "high").groupBy("query_id").agg(F.count(F.lit(1)).alias("matched"), F.sum("n_chars").alias("chars"))
    return asked.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("chars", F.lit(0)).alias("chars"))


@query(
    "phrase_selectivity",
    f"WITH t AS (SELECT doc_id, list_distinct({_TOKENS}) AS own, list_distinct(({_TOKENS})[1:3]) AS words FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, words FROM t WHERE doc_id % 100 = 0 AND len(words) > 0) SELECT a.doc_id AS query_id, count(m.doc_id) AS matched FROM documents a LEFT JOIN (SELECT q.doc_id AS query_id, t.doc_id FROM q JOIN t ON list_has_all(t.own, q.words)) m ON m.query_id = a.doc_id WHERE a.doc_id % 100 = 0 GROUP BY a.doc_id",
)
def phrase_selectivity(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold the first three words of each query's text."""
    rows = _table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    asked = rows.filter(_asked("vec_id")).select(F.col("vec_id").alias("query_id"), F.array_join(F.slice(tokens(F.col("text")), 1, 3), " ").alias("phrase"))
    return joins.selectivity(rows, asked, {"field": "text", "match_text_from_query": "phrase"})


@query("perquery_compacted", f"WITH {_C}, {_Q}, s AS (SELECT query_id, vec_id, {_SCORE['cosine']} AS score FROM q, c WHERE coalesce(n_chars >= query_id AND n_chars < query_id + 1500, false) AND label = q_label AND coalesce(lang <> 'de', true)), {_RANK} {_OUT}")
def perquery_compacted(spark: SparkSession, d: str) -> DataFrame:
    """Conditions with values from the query bound what is read; a static one is tested where it is read."""
    spec = {"must": [{"field": "n_chars", "range_from_query": {"gte": "low", "lt": "high"}}, {"field": "label", "match_from_query": "label"}], "must_not": [{"field": "lang", "match": "de"}]}
    asked = _queries(spark, d).withColumns({"low": F.col("query_id"), "high": F.col("query_id") + 1500})
    return _rounded(search.filtered_topk(asked, _corpus(spark, d, spec), spec, "cosine", K))


@query("rows_selector", f"WITH {_C}, {_Q}, s AS (SELECT query_id, vec_id, {_SCORE['dot']} AS score FROM q, c WHERE CAST(q_label AS VARCHAR) IN ('1', '2', '5', '7', '0', '3')), {_RANK} {_OUT}")
def rows_selector(spark: SparkSession, d: str) -> DataFrame:
    asked = filters.chosen(_queries(spark, d), "label", [1, 2, 5, 7, 0, 3])
    return _rounded(search.dense_topk(asked, _table(spark, d, "embeddings"), "dot", K))


# --- sparse and multivector ---------------------------------------------------------------------------------------
def _terms(spark: SparkSession, d: str) -> DataFrame:
    """A row for each document with its tokens, each of weight 1."""
    words = _table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), tokens(F.col("text")).alias("indices"))
    return words.withColumn("values", F.array_repeat(F.lit(1.0), F.size("indices")))


_SPARSE = r"""t AS (SELECT doc_id AS vec_id, unnest(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x))) AS term FROM documents),
 w AS (SELECT vec_id, term, count(*) AS n FROM t GROUP BY ALL), norms AS (SELECT vec_id, sqrt(sum(n * n)) AS l FROM w GROUP BY vec_id),
 p AS (SELECT a.vec_id AS query_id, b.vec_id, sum(a.n * b.n) AS dot FROM w a JOIN w b USING (term) WHERE a.vec_id % 100 = 0 GROUP BY ALL)"""


def _sparse(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        terms = _terms(spark, d)
        asked = terms.filter(_asked("vec_id")).withColumnRenamed("vec_id", "query_id")
        return _rounded(search.sparse_topk(asked, terms, metric, K))

    return run


query("sparse_dot", f"WITH {_SPARSE}, s AS (SELECT query_id, vec_id, CAST(dot AS DOUBLE) AS score FROM p), {_RANK} {_OUT}")(_sparse("dot"))
query("sparse_cosine", f"WITH {_SPARSE}, s AS (SELECT query_id, p.vec_id, CAST(dot AS DOUBLE) / x.l / y.l AS score FROM p JOIN norms x ON x.vec_id = p.vec_id JOIN norms y ON y.vec_id = query_id), {_RANK} {_OUT}")(_sparse("cosine"))


@query("sparse_no_overlap", f"WITH {_SPARSE} SELECT query_id, count(*) AS candidates FROM p GROUP BY query_id")
def sparse_no_overlap(spark: SparkSession, d: str) -> DataFrame:
    terms = _terms(spark, d)
    asked = terms.filter(_asked("vec_id")).withColumnRenamed("vec_id", "query_id")
    return joins.overlap_counts(terms, asked, F.col("indices"))


_MAXSIM = """t AS (SELECT vec_id, i, CAST(embedding AS DOUBLE[])[i * 8 + 1 : i * 8 + 8] AS x FROM embeddings, range(8) r(i)),
 m AS (SELECT a.vec_id AS query_id, a.i, b.vec_id, max({score}) AS best FROM t a, t b WHERE a.vec_id % 100 = 0 GROUP BY ALL),
 s AS (SELECT query_id, vec_id, sum(best ORDER BY i) AS score FROM m GROUP BY ALL)"""


def _maxsim(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = _table(spark, d, "embeddings").select("vec_id", tokens_of(doubles(F.col("embedding")), 8, 8).alias("tokens"))
        return _rounded(search.maxsim_topk(rows.filter(_asked("vec_id")).withColumnRenamed("vec_id", "query_id"), rows, metric, K))

    return run


query("maxsim_dot", f"WITH {_MAXSIM.format(score='list_dot_product(a.x, b.x)')}, {_RANK} {_OUT}")(_maxsim("dot"))
query("maxsim_cosine", f"WITH {_MAXSIM.format(score='list_dot_product(a.x, b.x) / greatest(sqrt(list_dot_product(a.x, a.x)), 1e-12) / greatest(sqrt(list_dot_product(b.x, b.x)), 1e-12)')}, {_RANK} {_OUT}")(_maxsim("cosine"))


# --- ties, merging, bounds, fusion --------------------------------------------------------------------------------
_TIED = f"{_Q}, s AS (SELECT query_id, vec_id, CAST(-abs(label - q_label) AS DOUBLE) AS score FROM q, embeddings)"
def _by_label(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """Queries and the vector of a row by label alone: full of ties."""
    label = F.array(F.col("label").cast("double"))
    return _queries(spark, d).select("query_id", label.alias("embedding")), label


_TIES = "SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {}) AS INTEGER) AS rank FROM s{}) WHERE rank <= 10"


@query("topk_tie_ordinal", f"WITH {_TIED}, o AS (SELECT vec_id, row_number() OVER () AS place FROM embeddings) " + _TIES.format("place", " JOIN o USING (vec_id)"))
def topk_tie_ordinal(spark: SparkSession, d: str) -> DataFrame:
    """Equal scores in the order of files and rows; identifiers are read for the winners."""
    asked, vector = _by_label(spark, d)
    path = f"{d}/embeddings.parquet"
    places = positions.layout(spark, path)
    rows = positions.positioned(spark, places, path).select(F.col("place").alias("vec_id"), vector.alias("embedding"))
    return positions.with_payload(spark, places, search.dense_topk(asked, rows, "euclidean", K), ["vec_id"]).select("query_id", "rank", "vec_id", (F.col("score") + F.lit(0.0)).alias("score"))


@query("topk_tie_id", f"WITH {_TIED} " + _TIES.format("CAST(vec_id AS VARCHAR)", ""))
def topk_tie_id(spark: SparkSession, d: str) -> DataFrame:
    """Equal scores by the text of the identifier."""
    return _tied(spark, d, K, "string")


def _tied(spark: SparkSession, d: str, k: int, order: str = "bigint") -> DataFrame:
    """The k nearest by label, ties by the identifier as a number or as text."""
    asked, vector = _by_label(spark, d)
    rows = _table(spark, d, "embeddings").select(F.col("vec_id").cast(order).alias("vec_id"), vector.alias("embedding"))
    found = search.dense_topk(asked, rows, "euclidean", k)
    return found.select("query_id", "rank", F.col("vec_id").cast("bigint").alias("vec_id"), (F.col("score") + F.lit(0.0)).alias("score"))


def _parts(spark: SparkSession, d: str, n: int = 4) -> list[DataFrame]:
    rows = _table(spark, d, "embeddings")
    return [search.dense_topk(_queries(spark, d), rows.filter(F.col("vec_id") % n == i), "dot", K) for i in range(n)]


@query("merge_partials", _sql())
def merge_partials(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(search.merge(_parts(spark, d), K).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


@query(
    "threshold_kth",
    f"WITH {_C}, {_Q}, s AS (SELECT query_id, vec_id, {_SCORE['dot']} AS score FROM q, c), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id % 4 ORDER BY score DESC, vec_id) AS pr FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p WHERE pr <= 5) SELECT query_id, round(score, 6) + 0.0 AS bound FROM r WHERE rank = 10",
)
def threshold_kth(spark: SparkSession, d: str) -> DataFrame:
    parts = _parts(spark, d)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return search.kth_bound(every, K, 4).select("query_id", (F.round("bound", 6) + F.lit(0.0)).alias("bound"))


@query("row_union_compaction", f"WITH {_C}, {_Q} SELECT vec_id FROM c WHERE label IN (SELECT q_label FROM q)")
def row_union_compaction(spark: SparkSession, d: str) -> DataFrame:
    return search.wanted_rows(_queries(spark, d), _table(spark, d, "embeddings"), {"must": [{"field": "label", "match_from_query": "label"}]}).select("vec_id")


@query(
    "hybrid_rrf",
    f"WITH {_SPARSE}, sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, vec_id) AS rank FROM p), {_C}, {_Q}, de AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY {_SCORE['dot']} DESC, vec_id) AS rank FROM q, c), u AS (SELECT query_id, vec_id, rank FROM sp WHERE rank <= 10 UNION ALL SELECT * FROM de WHERE rank <= 10), s AS (SELECT query_id, vec_id, round(sum(1.0 / CAST(60 + rank AS DOUBLE)), 12) AS score FROM u GROUP BY ALL), {_RANK} {_OUT}",
)
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    dense = search.dense_topk(_queries(spark, d), _table(spark, d, "embeddings"), "dot", K)
    return _rounded(search.fused([dense, _sparse("dot")(spark, d)], K))


# --- retrieval quality --------------------------------------------------------------------------------------------
def _short(spark: SparkSession, d: str) -> DataFrame:
    """Vectors cut to 16 numbers: an approximate engine."""
    return _table(spark, d, "embeddings").withColumn("embedding", F.slice("embedding", 1, 16))


def _found_truth(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    short = _short(spark, d)
    asked = short.filter(_asked("vec_id")).select(F.col("vec_id").alias("query_id"), "embedding")
    return search.dense_topk(asked, short, "dot", K), search.dense_topk(_queries(spark, d), _table(spark, d, "embeddings"), "dot", K)


_EVAL = f"""{_C}, {_Q},
 g AS (SELECT query_id, vec_id, {_SCORE['dot']} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_SCORE['dot']} DESC, vec_id) AS rank FROM q, c),
 gt AS (SELECT * FROM g WHERE rank <= 10),
 f AS (SELECT query_id, vec_id, list_dot_product(qv[1:16], v[1:16]) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(qv[1:16], v[1:16]) DESC, vec_id) AS rank FROM q, c),
 fo AS (SELECT * FROM f WHERE rank <= 10)"""


@query("recall_at_k", f"WITH {_EVAL} SELECT query_id, count(fo.vec_id) AS hits, count(fo.vec_id) / 10.0 AS recall FROM gt LEFT JOIN fo USING (query_id, vec_id) GROUP BY query_id")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall(*_found_truth(spark, d), K).select("query_id", "hits", "recall")


@query(
    "recall_tolerant",
    f"WITH {_EVAL}, cut AS (SELECT query_id, min(score) AS cutoff FROM gt GROUP BY 1), j AS (SELECT fo.query_id, fo.score, cutoff, gt.vec_id IS NOT NULL AS hit, abs(fo.score - cutoff) <= 0.05 * (1 + abs(cutoff)) AS near FROM fo JOIN cut USING (query_id) LEFT JOIN gt USING (query_id, vec_id)) SELECT query_id, count(*) FILTER (NOT hit AND near) AS near_ties, count(*) FILTER (NOT hit AND NOT near AND score > cutoff) AS missing, least(1.0, count(*) FILTER (hit OR near) / 10.0) AS recall_tolerant FROM j GROUP BY query_id",
)
def recall_tolerant(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.recall(*_found_truth(spark, d), K, 0.05).select("query_id", "near_ties", "missing", "recall_tolerant")


_P = "pow(0.01, 0.1)"


@query(
    "rbo",
    f"""WITH {_EVAL}, b AS (SELECT query_id, greatest(fo.rank, gt.rank) AS pos FROM fo JOIN gt USING (query_id, vec_id)),
 x AS (SELECT query_id, d, (SELECT count(*) FROM b WHERE b.query_id = q.query_id AND pos <= d) AS x, (SELECT count(*) FROM b WHERE b.query_id = q.query_id) AS o FROM q, range(1, 600) r(d)),
 y AS (SELECT query_id, d, o, pow({_P}, d) / d * (1 - {_P}) / {_P} AS w, CASE WHEN d <= 10 THEN x ELSE o END AS lo, CASE WHEN d <= 10 THEN x ELSE least(d, o + 2 * (d - 10)) END AS hi FROM x)
 SELECT query_id, max(o) AS overlap, round(sum(w * lo) FILTER (d <= 10), 6) AS rbo, round(least(1.0, sum(w * lo) FILTER (d <= 10) / (1 - pow({_P}, 10))), 6) AS rbo_norm, round(sum(w * lo), 6) AS rbo_min, round(sum(w * (hi - lo)), 6) AS rbo_res,
 round(sum(w * lo) FILTER (d <= 10) + pow({_P}, 10) * max(o) / 10, 6) AS rbo_ext FROM y GROUP BY query_id""",
)
def rbo(spark: SparkSession, d: str) -> DataFrame:
    names = ["rbo", "rbo_norm", "rbo_min", "rbo_res", "rbo_ext"]
    return evaluate.rank_biased_overlap(*_found_truth(spark, d), K).select("query_id", "overlap", *[F.round(n, 6).alias(n) for n in names])


@query("tie_stats", f"WITH {_TIED}, {_RANK}, t AS (SELECT query_id, count(*) AS ties FROM s JOIN (SELECT query_id, score AS cutoff FROM r WHERE rank = 10) USING (query_id) WHERE score = cutoff GROUP BY 1) SELECT round(avg(ties), 6) AS mean_ties, max(ties) AS max_ties, avg(CAST(ties > 1 AS INTEGER)) AS tied_share, count(*) AS n FROM t")
def tie_stats(spark: SparkSession, d: str) -> DataFrame:
    """Candidates are counted by label before they meet the queries, a row for each different label."""
    counts = _table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    asked = _queries(spark, d).select("query_id", F.col("label").alias("q_label"))
    scored = joins.range_join(counts, "label", asked.withColumns({"low": F.lit(float("-inf"))}), "low")
    scored = scored.select("query_id", (-F.abs(F.col("label") - F.col("q_label"))).cast("double").alias("score"), "n")
    return evaluate.tie_stats(scored, _tied(spark, d, K), K, weight="n").withColumn("mean_ties", F.round("mean_ties", 6))


@query("latency_percentiles", "SELECT event_type, count(value) AS n, round(coalesce(avg(value), 0), 6) AS mean, coalesce(quantile_disc(value, 0.5), 0) AS p50, coalesce(quantile_disc(value, 0.95), 0) AS p95, coalesce(quantile_disc(value, 0.99), 0) AS p99, coalesce(max(value), 0) AS slowest FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latencies(_table(spark, d, "events"), "value", "event_type").withColumn("mean", F.round("mean", 6))


@query("first_success", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'error') WHERE n = 1")
def first_success(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.first_successes(_table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "error").select("user_id", "event_id", "value")


@query("bucket_means", "SELECT 'full' AS bucket, count(value) AS n, round(avg(value), 6) AS mean FROM events WHERE user_id >= 10 UNION ALL SELECT 'short', count(value), round(avg(value), 6) FROM events WHERE user_id < 10 UNION ALL SELECT 'total', count(value), round(avg(value), 6) FROM events")
def bucket_means(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.bucket_means(_table(spark, d, "events"), "value", F.col("user_id") < 10).withColumn("mean", F.round("mean", 6))


@query("dispatch_rate", "SELECT CAST(epoch_us(min(ts)) // 3600000000 AS BIGINT) AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) / 3600.0 AS per_second FROM events GROUP BY epoch_us(ts) // 3600000000")
def dispatch_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return evaluate.rates(rows, "at", F.col("event_type") != "error", 3_600_000_000).withColumnRenamed("slot", "hour")


# --- distribution of work -----------------------------------------------------------------------------------------
# the nations stand for files, their keys plus one for row counts
_FILES = "WITH f AS (SELECT n_name AS path, CAST(n_nationkey + 1 AS BIGINT) AS n FROM nation)"


def _listing(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "nation").select(F.col("n_name").alias("path"), (F.col("n_nationkey") + 1).cast("long").alias("n"))


query("partition_stride", f"{_FILES} SELECT path, CAST((row_number() OVER (ORDER BY path) - 1) % 4 AS INTEGER) AS part FROM f")(lambda s, d: prepare.strided(_listing(s, d), "path", 4).select("path", "part"))
query("partition_contiguous", f"{_FILES} SELECT path, CAST(ntile(4) OVER (ORDER BY path) - 1 AS INTEGER) AS part FROM f")(lambda s, d: prepare.contiguous(_listing(s, d), "path", 4).select("path", "part"))
query("window_files", f"{_FILES}, p AS (SELECT path, n, CAST(sum(n) OVER (ORDER BY path) - n AS BIGINT) AS file_start FROM f) SELECT * FROM p WHERE file_start < 150 AND file_start + n > 60")(lambda s, d: prepare.files_in_window(_listing(s, d), "path", "n", 60, 90))
query("partition_row_window", "WITH t AS (SELECT count(*) AS n, CAST(ceil(count(*) / 7.0) AS BIGINT) AS share FROM documents) SELECT CAST(r AS INTEGER) AS part, CAST(share * r AS BIGINT) AS first_row, CAST(greatest(0, least(share, n - share * r)) AS BIGINT) AS rows FROM t, range(7) x(r)")(
    lambda s, d: s.createDataFrame([(i, o, n) for i, (o, n) in enumerate(prepare.row_windows(_table(s, d, "documents").count(), 7))], "part int, first_row bigint, rows bigint")
)
query("row_window_scan", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER () AS n FROM documents) WHERE n > 37 AND n <= 137")(lambda s, d: files.window_of(files.scan(s, f"{d}/documents.parquet"), 37, 100).select("doc_id"))
query("shard_batches", "SELECT label, batch, count(*) AS n FROM (SELECT label, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 16 AS BIGINT) AS batch FROM embeddings) GROUP BY ALL")(
    lambda s, d: prepare.batches(_table(s, d, "embeddings").select("label", "vec_id"), "label", ["vec_id"], 16).groupBy("label", "batch").agg(F.count(F.lit(1)).alias("n"))
)
query("corpus_fingerprint", "SELECT sha256(string_agg(n_name, chr(10) ORDER BY n_name)) AS digest FROM nation")(lambda s, d: _listing(s, d).withColumnRenamed("path", "key").agg(files.corpus_fingerprint(F.col("key")).alias("digest")))
query("upsert_last_write", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")(
    lambda s, d: prepare.upserted(_table(s, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")
)
query("resume_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda s, d: prepare.not_loaded(_table(s, d, "documents"), _table(s, d, "labels"), "doc_id").select("doc_id"))

# --- projections, texts, pooling, statistics ----------------------------------------------------------------------
query("point_id", "SELECT doc_id, regexp_replace(md5('documents.parquet:' || doc_id), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS point_id FROM documents")(
    lambda s, d: _table(s, d, "documents").select("doc_id", point_id(F.lit("documents.parquet"), F.col("doc_id")).alias("point_id"))
)
query("render_columns", "SELECT doc_id, md5('[' || coalesce(lang, 'None') || '] {' || coalesce(source, 'None') || '} ' || coalesce(text, 'None')) AS digest FROM documents")(
    lambda s, d: prepare.render(_table(s, d, "documents"), {"input": "[{lang}] {{{source}}} {text}"}, ["text"]).select("doc_id", F.md5("input").alias("digest"))
)
query(
    "text_windows",
    "WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, text, n, unnest(CASE WHEN n <= 500 THEN [0] ELSE range(0, n, 450) END) AS start FROM t) SELECT doc_id, CAST(CASE WHEN n <= 500 THEN 0 ELSE start // 450 END AS INTEGER) AS chunk, CAST(start AS INTEGER) AS start, md5(substr(text, start + 1, 500)) AS digest FROM w",
)(lambda s, d: prepare.split_texts(_table(s, d, "documents").select("doc_id", "text"), "text", 500, 50).select("doc_id", "chunk", "start", F.md5("piece").alias("digest")))
_BLANK = r"(text IS NULL OR NOT regexp_matches(text, '[^\x20\x09-\x0D]'))"
query("empty_policy_counts", f"SELECT 'skip' AS policy, count(*) AS n FROM documents WHERE NOT {_BLANK} AND NOT (lang IS NULL OR lang = '') UNION ALL SELECT 'null', count(*) FROM documents WHERE NOT {_BLANK} OR NOT (lang IS NULL OR lang = '')")(
    lambda s, d: grid.report([prepare.with_empty_policy(_table(s, d, "documents"), {"body": ["text"], "tag": ["lang"]}, p).agg(F.lit(p).alias("policy"), F.count(F.lit(1)).alias("n")) for p in ("skip", "null")])
)
_POOL = {"mean": "avg(x[j])", "max": "max(x[j])", "cls": "max(x[j]) FILTER (i = 0)", "last": "max(x[j]) FILTER (i = 7)"}
for _how, _expr in _POOL.items():
    query(f"pooling_{_how}", f"WITH t AS (SELECT vec_id, i, CAST(embedding AS DOUBLE[])[i * 8 + 1 : i * 8 + 8] AS x FROM embeddings, range(8) r(i)) SELECT vec_id, CAST(j AS INTEGER) AS j, round({_expr}, 6) + 0.0 AS value FROM t, range(1, 9) y(j) GROUP BY vec_id, j")(
        lambda s, d, how=_how: _table(s, d, "embeddings").select("vec_id", F.posexplode(pooled(tokens_of(doubles(F.col("embedding")), 8, 8), how)).alias("j", "value")).select("vec_id", (F.col("j") + 1).alias("j"), (F.round("value", 6) + F.lit(0.0)).alias("value"))
    )
query("token_stats", "WITH l AS (SELECT len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS n FROM documents WHERE text IS NOT NULL) SELECT count(n) AS n, round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, round(stddev_pop(n), 6) AS std, round(quantile_cont(n, 0.95), 6) AS p95, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS longest, round(avg(ln(n)) FILTER (n > 0), 6) AS mu, round(stddev_pop(ln(n)) FILTER (n > 0), 6) AS sigma FROM l".replace("avg(ln(n))", "avg(CASE WHEN n > 0 THEN ln(n) END)").replace("stddev_pop(ln(n))", "stddev_pop(CASE WHEN n > 0 THEN ln(n) END)"))(
    lambda s, d: prepare.length_stats(_table(s, d, "documents").select(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")).cast("long").alias("tokens")), "tokens").withColumns({c: F.round(c, 6) for c in ("mean", "std", "p95", "p99", "mu", "sigma")})
)
query("padding_efficiency", "WITH b AS (SELECT sum(n_chars) / CAST(max(n_chars) * count(n_chars) AS DOUBLE) AS e FROM documents WHERE n_chars > 0 GROUP BY doc_id // 32) SELECT round(avg(e), 6) AS efficiency, count(*) AS batches FROM b")(
    lambda s, d: prepare.padding(_table(s, d, "documents").filter("n_chars > 0"), "n_chars", F.floor(F.col("doc_id") / 32)).withColumn("efficiency", F.round("efficiency", 6))
)
query("predict_throughput", "SELECT p_partkey, round(50 * 1e12 / (2 * (p_retailprice * 1e6)) * 0.35 / (p_size * 10), 6) AS rate FROM part")(
    lambda s, d: _table(s, d, "part").select("p_partkey", F.round(prepare.throughput(F.lit(50), F.col("p_retailprice") * 1e6, F.lit(0.35), F.col("p_size") * 10), 6).alias("rate"))
)


# --- grids, reports, inspection -----------------------------------------------------------------------------------
@query("sweep_grid", "SELECT CAST(m AS INTEGER) AS m, CAST(ef AS INTEGER) AS ef, name FROM (SELECT unnest([8, 16, 32]) AS m), (SELECT unnest([64, 128]) AS ef), (SELECT r_name AS name FROM region)")
def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    layouts = spark.createDataFrame([(x["m"], x["ef"]) for x in grid.combinations({"m": [8, 16, 32], "ef": [64, 128]})], "m int, ef int")
    return layouts.crossJoin(F.broadcast(_table(spark, d, "region").select(F.col("r_name").alias("name"))))


@query("report_union", "SELECT n_name AS name, n_regionkey AS region, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def report_union(spark: SparkSession, d: str) -> DataFrame:
    return grid.report([_table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), _table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))])


@query("inspect_schema", "SELECT * FROM (VALUES ('vec_id', 'bigint', NULL::INTEGER), ('embedding', 'array<float>', 64), ('label', 'int', NULL)) AS t(\"column\", kind, dims), (SELECT count(*) AS rows, CAST(1 AS BIGINT) AS files FROM embeddings)")
def inspect_schema(spark: SparkSession, d: str) -> DataFrame:
    return files.inspect(_table(spark, d, "embeddings"))


from tessera.plans import jobs  # noqa: E402, F401  more queries
