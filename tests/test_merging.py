"""The checked merge, bounds before the scan, masks beside the product: against plain searches in Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import masks, results, search
from tessera.operators.filters import evaluate

LISTS = "part int, query_id string, hit_ids array<string>, hit_scores array<float>, hit_tie array<bigint>, nan_hits int, applied_threshold float"


def lists(spark, rows):
    return spark.createDataFrame(rows, LISTS)


def test_integer_ties_merge_by_number(spark):
    rows = spark.createDataFrame([(i, [1.0]) for i in (10, 2, 9, 100, 7)], "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(5, [1.0])], "query_id bigint, embedding array<double>")
    parts = [results.partial_lists(search.dense_topk(asked, rows.filter(F.col("vec_id") % 2 == i), "dot", 4, nan="keep"), asked, i) for i in range(2)]
    got = results.merge_lists(search.union(parts), 4, 2, queries=asked).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == ["2", "7", "9", "10"] == [str(r["vec_id"]) for r in search.dense_topk(asked, rows, "dot", 4).orderBy("rank").collect()]


def test_a_checked_merge_searches_each_part_once(spark):
    rows = spark.createDataFrame([(i, [float(i % 9)]) for i in range(200)], "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(5, [1.0]), (6, [-1.0])], "query_id bigint, embedding array<double>")
    told = [{}, {}]
    parts = [results.partial_lists(search.dense_topk(asked, rows.filter(F.col("vec_id") % 2 == i), "dot", 4, nan="keep", told=told[i]), asked, i) for i in range(2)]
    got = results.merge_lists(search.union(parts), 4, 2, queries=asked).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got)[:4] == [("5", 1, "8"), ("5", 2, "17"), ("5", 3, "26"), ("5", 4, "35")] and len(got) == 8
    assert [t["pairs"].value for t in told] == [200, 200]


GOOD = [(0, "1", ["a", "b"], [3.0, 1.0], [1, 2], 0, None), (1, "1", ["c"], [2.0], [3], 0, None)]


@pytest.mark.parametrize(
    "bad, problem",
    [
        ([GOOD[0]], "not once in each part"),
        ([*GOOD, GOOD[1]], "not once in each part"),
        ([GOOD[0], (1, "1", None, [2.0], [3], 0, None)], "null lists"),
        ([GOOD[0], (1, "1", ["c"], [2.0, 1.0], [3], 0, None)], "uneven"),
        ([GOOD[0], (1, "1", ["c"], [2.0], [3, 4], 0, None)], "uneven"),
        ([GOOD[0], (1, "1", ["c", None], [2.0, 1.0], [3, 4], 0, None)], "nulls in lists"),
        ([GOOD[0], (1, "1", ["c", "d"], [2.0, None], [3, 4], 0, None)], "nulls in lists"),
        ([GOOD[0], (1, "1", ["c"], [2.0], [None], 0, None)], "nulls in lists"),
        ([GOOD[0], (1, "1", list("cdef"), [2.0] * 4, [3, 4, 5, 6], 0, None)], "more hits than k"),
        ([(0, "1", ["a"], [3.0], [1], 0, 2.5), (1, "1", ["c"], [2.0], [3], 0, None)], "threshold"),
    ],
)
def test_refusals(spark, bad, problem):
    with pytest.raises(Exception, match=problem):
        results.merge_lists(lists(spark, bad), 3, 2).collect()


def test_queries_that_no_part_has(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id bigint")
    with pytest.raises(Exception, match="first at query 2: in no part"):
        results.merge_lists(lists(spark, GOOD), 3, 2, queries=asked).collect()
    assert results.merge_lists(lists(spark, GOOD), 3, 2, queries=asked.filter("query_id = 1")).count() == 3


def test_thresholds_are_verified(spark):
    fits = [(0, "1", ["a", "b"], [3.0, 2.5], [1, 2], 0, 2.5), (1, "1", ["c"], [2.75], [3], 0, 2.5)]
    assert results.merge_lists(lists(spark, fits), 3, 2).count() == 3
    high = [(0, "1", ["a", "b"], [3.0, 2.5], [1, 2], 0, 2.6), (1, "1", ["c"], [2.75], [3], 0, None)]
    with pytest.raises(Exception, match="trimmed by a threshold"):
        results.merge_lists(lists(spark, high), 3, 2).collect()
    slots = [(0, "1", ["a"], [3.0], [1], 1, 2.6), (1, "1", ["c"], [2.75], [3], 0, None)]  # a place is taken by what is no number
    assert results.merge_lists(lists(spark, slots), 3, 2).count() == 2
    down = spark.createDataFrame([(x,) for x in (0.1, -0.1, 1e30, -3e-45, 0.0, 16777217.0)], "x double").select("x", results.rounded_down(F.col("x")).cast("double").alias("y"))
    assert all(r["y"] <= r["x"] for r in down.collect())


def vectors(n, width=6, seed=3):
    random.seed(seed)
    return [[random.choice([-1.0, 0.0, 0.5, 1.0, 2.0]) for _ in range(width)] for _ in range(n)]


@pytest.mark.parametrize("metric", ["dot", "cosine", "euclidean"])
def test_bounds_leave_rows_unscored(spark, metric):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors(3000))], "vec_id bigint, embedding array<double>").repartition(4)
    asked = rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    plain, bounded = {}, {}
    want = sorted(map(tuple, search.dense_topk(asked, rows, metric, 5, told=plain).collect()))
    assert sorted(map(tuple, search.threshold_topk(asked, rows, metric, 5, share=4, told=bounded).collect())) == want
    assert bounded["pairs"].value == plain["pairs"].value == 30 * 3000 and bounded["scored"].value < plain["scored"].value < 30 * 3000 / 4
    # a bound that lies is found out by the merge
    wrong = asked.select("query_id", F.lit(1e6).alias("bound"))
    lost = results.partial_lists(search.dense_topk(asked, rows, metric, 5, nan="keep", bounds=wrong), asked, 0, wrong)
    with pytest.raises(Exception, match="fewer hits than its threshold"):
        results.merge_lists(lost, 5, 1).collect()


def test_long_and_odd_identifiers(spark):
    rows = spark.createDataFrame([(1, [3e200, 4e200]), (2, [1.0, 0.0]), (3, [-3e200, 4e200])], "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(7, [1e200, 0.0])], "query_id smallint, embedding array<double>")
    got = [(r["vec_id"], round(r["score"], 9)) for r in search.dense_topk(asked, rows, "cosine", 3).orderBy("rank").collect()]
    assert got == [(2, 1.0), (1, 0.6), (3, -0.6)]
    got = search.dense_topk(asked, rows, "euclidean", 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 1, 3] and math.isclose(got[1]["score"], -math.hypot(2e200, 4e200)) and got[0]["query_id"] == 7
    for kind in ("decimal(9,2)", "string", "date"):
        named = asked.withColumn("query_id", F.lit(None).cast(kind))
        many = search.dense_topk_many(named, rows, {"a\x00b": {}}).collect()
        assert len(many) == 3 and many[0]["query_id"] is None and many[0]["spec"] == "a\x00b"


TEXTS = [None, "", "the cat", "The DOG and the cat", "dog", "a b c d", "İstanbul cat", "x-y cat_dog"]
PAYLOAD = "vec_id bigint, embedding array<double>, n bigint, s string, x double, t string, f boolean, ts timestamp"


@pytest.fixture(scope="module")
def both(spark):
    random.seed(11)
    pick = random.choice
    rows = [(i, v, pick([None, 1, 2, 3, 2**53 + 1]), pick([None, "a", "b", ""]), pick([None, 0.5, -0.0, math.nan, math.inf, 2.0]), pick(TEXTS), pick([None, True, False]), None) for i, v in enumerate(vectors(400))]
    corpus = spark.createDataFrame(rows, PAYLOAD).withColumn("ts", F.when(F.col("vec_id") % 3 > 0, F.timestamp_seconds(F.col("vec_id") * 3600)))
    asked = [(i, v, pick([None, 1, 2, 2**53 + 1]), pick([None, [], [1, None], [2, 3]]), pick([None, "a", ""]), pick([None, 0.0, math.nan, 1.0]), pick([None, 2, 9]), pick([None, "", "...", "cat", "CAT the", "cat dog"]), pick([None, True]), "1970-01-0%d" % pick([1, 5])) for i, v in enumerate(vectors(30, seed=4))]
    queries = spark.createDataFrame(asked, "query_id bigint, embedding array<double>, n bigint, ns array<bigint>, s string, low double, high int, phrase string, f boolean, after string")
    return corpus.repartition(3), queries


WHERE = [
    {"must": [{"field": "n", "match_from_query": "n"}]},
    {"must": [{"field": "n", "match_from_query": "ns"}, {"field": "s", "match": ["a", ""]}]},
    {"must": [{"field": "s", "match_from_query": "s"}], "must_not": [{"field": "n", "match_from_query": "n"}]},
    {"must": [{"field": "f", "match_from_query": "f"}]},
    {"must": [{"field": "x", "range_from_query": {"gte": "low"}}]},
    {"must": [{"field": "n", "range_from_query": {"gt": "low", "lte": "high"}}]},
    {"should": [{"field": "n", "match_from_query": "n"}, {"field": "x", "range_from_query": {"lt": "low"}}, {"field": "s", "match": "b"}]},
    {"must": [{"field": "t", "match_text_from_query": "phrase"}]},
    {"should": [{"field": "t", "match_text_from_query": "phrase"}, {"field": "n", "match": 3}], "must_not": [{"field": "x", "range_from_query": {"gt": "low"}}]},
    {"must_not": [{"field": "s", "match": "a"}]},
    {"must": [{"field": "ts", "range_from_query": {"gte": "after"}}]},
]


@pytest.mark.parametrize("where", WHERE)
def test_masks_are_what_the_filter_says(spark, both, monkeypatch, where):
    """The same lists as from all pairs, joined and filtered by the conditions as columns; and none lost to the scan's bounds."""
    corpus, queries = both
    dates = ("ts",) if "ts" in str(where) else ()
    asked = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    test = evaluate(corpus.schema, where, query={c: F.col(f"q_{c}") for c in queries.columns}, query_schema=queries.schema, dates=dates)
    pairs = corpus.crossJoin(asked).filter(test).select(F.col("q_query_id").alias("query_id"), "vec_id")
    want = sorted(map(tuple, pairs.collect()))
    assert want
    got = search.filtered_topk(queries, corpus, where, "dot", 400, dates)
    assert sorted((r["query_id"], r["vec_id"]) for r in got.collect()) == want
    whole = sorted(map(tuple, search.filtered_topk(queries, corpus, where, "cosine", 3, dates).collect()))
    monkeypatch.setattr(search, "CELLS", 900)
    monkeypatch.setattr(search, "QUERY_BYTES", 8 * 6 * 7)
    monkeypatch.setattr(masks, "LISTED", 1)
    assert sorted(map(tuple, search.filtered_topk(queries, corpus, where, "cosine", 3, dates).collect())) == whole


def test_bounds_reach_the_scan(spark, both, tmp_path):
    corpus, queries = both
    corpus.write.parquet(f"{tmp_path}/c")
    rows = spark.read.parquet(f"{tmp_path}/c")
    asked = queries.withColumns({"low": F.lit(0.5), "high": F.lit(2)}).filter("n IS NOT NULL")

    def pushed(where, dates=()):
        plan = search.wanted_rows(asked, rows, where, dates)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan
        return plan[plan.index("PushedFilters") :].split("\n")[0]

    assert "In(n, [" in pushed({"must": [{"field": "n", "match_from_query": "n"}]})
    told = pushed({"must": [{"field": "n", "range_from_query": {"gt": "low", "lte": "high"}}, {"field": "s", "match": "a"}]})
    assert "GreaterThanOrEqual(n,0)" in told and "LessThanOrEqual(n,3)" in told and "EqualTo(s,a)" in told
    assert "GreaterThanOrEqual(x,0.5)" in pushed({"must": [{"field": "x", "range_from_query": {"gte": "low"}}]})
    assert "GreaterThanOrEqual(ts," in pushed({"must": [{"field": "ts", "range_from_query": {"gte": "after"}}]}, ("ts",))
    # of a should each condition widens what is wanted, and one that says nothing ends it
    some = {"should": [{"field": "n", "match_from_query": "n"}, {"field": "s", "match": "b"}]}
    assert "Or(" in pushed(some) and search.wanted_rows(asked, rows, some).count() < rows.count()
    assert search.wanted_rows(asked, rows, {"should": [*some["should"], {"field": "t", "match_text_from_query": "phrase"}]}).count() == rows.count()


def test_no_pairs_are_made(spark, both):
    corpus, queries = both
    for where in WHERE[:9]:
        plan = search.filtered_topk(queries, corpus, where)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" in plan
