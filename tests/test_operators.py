"""Edge cases that the tables do not have."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import has_phrase, windows
from tessera.functions.vectors import maxsim, pooled
from tessera.operators import evaluate, prepare, search
from tessera.operators.filters import evaluate as filtered
from tessera.plans import grid
from tessera.sources import files
from tessera.sources.store import ParquetStore
from tessera.streaming.topk import latest, running_topk


def points(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def test_topk_ties_nulls_and_short_lists(spark):
    corpus = points(spark, [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [math.nan, 0.0]), (7, [0.0, 0.0])])
    asked = points(spark, [(0, [1.0, 0.0])]).withColumnRenamed("vec_id", "query_id")
    for metric in ("dot", "cosine", "euclidean"):
        got = search.dense_topk(asked, corpus, metric, 3).orderBy("rank").collect()
        assert [r["vec_id"] for r in got][:2] == [1, 3]
        assert len(got) == 3
    assert search.dense_topk(asked, corpus.limit(0), "dot", 3).count() == 0
    assert search.dense_topk(asked, corpus, "dot", 10).count() == 4


def test_queries_in_several_blocks(spark, monkeypatch):
    rows = points(spark, [(i, [float(i % 7), float(i % 3)]) for i in range(60)])
    asked = rows.withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, search.dense_topk(asked, rows, "dot", 4).collect()))
    monkeypatch.setattr(search, "QUERY_BYTES", 16 * 9)
    assert sorted(map(tuple, search.dense_topk(asked, rows, "dot", 4).collect())) == whole


def test_partials_merge_to_the_whole(spark):
    rows = points(spark, [(i, [float(i % 5), float(i % 3)]) for i in range(50)])
    asked = rows.filter("vec_id < 4").withColumnRenamed("vec_id", "query_id")
    parts = [search.dense_topk(asked, rows.filter(f"vec_id % 3 = {i}"), "dot", 5) for i in range(3)]
    want = search.dense_topk(asked, rows, "dot", 5)
    assert sorted(map(tuple, search.merge(parts, 5).select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def kept(df, spec, **more):
    test = filtered(df.schema, spec, **more)
    return [r["i"] for r in (df if test is None else df.filter(test)).orderBy("i").collect()]


def test_filters(spark):
    df = spark.createDataFrame([(1, 2**53 + 1, 1.5, "a b"), (2, 2**53, math.nan, "B, c"), (3, None, None, None)], "i int, n bigint, x double, t string")
    assert kept(df, {}) == [1, 2, 3]
    assert kept(df, {"must": [{"field": "n", "match": 2**53 + 1}]}) == [1]
    assert kept(df, {"must": [{"field": "n", "range": {"gt": 2**53}}]}) == [1]
    assert kept(df, {"must": [{"field": "n", "range": {"lt": float("inf")}}]}) == [1, 2]
    assert kept(df, {"must": [{"field": "x", "range": {"gt": 1}}]}) == [1]
    assert kept(df, {"must_not": [{"field": "x", "range": {"gt": 1}}]}) == [2, 3]
    assert kept(df, {"must": [{"field": "t", "match_text": "C b"}]}) == [2]
    assert kept(df, {"must": [{"field": "n", "match": [0.5]}]}) == []
    for bad in ({"field": "n", "match": "x"}, {"field": "t", "match_text": "!"}, {"field": "q", "match": 1}, {"field": "n", "range": {}}, {"field": "n"}):
        with pytest.raises(ValueError):
            filtered(df.schema, {"must": [bad]})


def test_text_functions(spark):
    df = spark.createDataFrame([("x" * 10,), ("abc",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(F.transform(windows(F.col("t"), 4, 1), lambda w: w["start"])).collect()]
    assert got == [[0, 3, 6, 9], [0], [0], None]
    assert [r[0] for r in df.select(has_phrase(F.col("t"), F.lit("!!"))).collect()] == [False] * 4


def test_pooling_and_maxsim_without_tokens(spark):
    df = spark.createDataFrame([([[3.0, 4.0], [0.0, 0.0]],), ([],)], "t array<array<double>>")
    assert [r[0] for r in df.select(pooled(F.col("t"), "cls", True)).collect()] == [[0.6, 0.8], None]
    assert [r[0] for r in df.select(maxsim(F.col("t"), F.col("t"))).collect()] == [25.0, None]


def test_recall_with_repeats_and_short_truth(spark):
    found = spark.createDataFrame([(1, 1, 7, 1.0), (1, 2, 7, 1.0), (1, 3, 9, 0.5)], "query_id bigint, rank int, vec_id bigint, score double")
    truth = spark.createDataFrame([(1, 1, 7, 1.0), (1, 2, 8, 0.5), (2, 1, 5, 1.0)], "query_id bigint, rank int, vec_id bigint, score double")
    got = {r["query_id"]: r for r in evaluate.recall(found, truth, 3).collect()}
    assert (got[1]["hits"], got[1]["near_ties"], got[1]["denom"], got[1]["recall"]) == (1, 1, 2, 0.5)
    assert got[2]["recall"] == 0
    same = evaluate.rank_biased_overlap(truth, truth, 2, 0.9).filter("query_id = 1").first()
    assert abs(same["rbo_ext"] - 1) < 1e-12 and abs(same["rbo_min"] + same["rbo_res"] - 1) < 1e-9


def test_latencies_of_nothing(spark):
    got = evaluate.latencies(spark.createDataFrame([("a", None)], "k string, v double"), "v", "k").first()
    assert (got["n"], got["p95"], got["slowest"]) == (0, 0.0, 0.0)


def test_empty_policies(spark):
    df = spark.createDataFrame([("a", "b"), (" \n", "b"), (None, "")], "x string, y string")
    groups = {"x": ["x"], "y": ["y"]}
    assert [prepare.with_empty_policy(df, groups, p).count() for p in ("skip", "null")] == [1, 2]
    with pytest.raises(Exception, match="empty input"):
        prepare.with_empty_policy(df, groups, "error").collect()


def test_row_windows_and_grid():
    assert prepare.row_windows(5, 4) == [(0, 2), (2, 2), (4, 1), (6, 0)]
    assert grid.combinations({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3, "_name": "a1_b3"}, {"a": 2, "b": 3, "_name": "a2_b3"}]
    assert [grid.insert_action(*x) for x in ((True, True), (False,), (True, False, True), (True,))] == ["recreate", "load", "skip", "abort"]
    assert files.matching(["a/x", "b/y", "a/y"], ["regex:^a", "*y"]) == ["a/x", "a/y", "b/y"]


def test_files_store_and_stream(spark, tmp_path):
    rows = points(spark, [(i, [float(i), 1.0]) for i in range(20)])
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    assert len(files.files(spark, f"{tmp_path}/in")) == 3 and files.files(spark, f"{tmp_path}/none") == []
    assert files.window_of(files.scan(spark, f"{tmp_path}/in"), 5, 9).count() == 9
    store = ParquetStore(spark, f"{tmp_path}/store")
    assert store.missing(rows).count() == 20
    store.upsert(rows.filter("vec_id < 10"), 1)
    store.upsert(points(spark, [(9, [99.0, 0.0])]), 2)
    assert store.points().count() == 10 and store.missing(rows).count() == 10
    asked = points(spark, [(0, [1.0, 0.0])]).withColumnRenamed("vec_id", "query_id")
    assert store.search(asked, k=1).first()["score"] == 99.0
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running = running_topk(spark, stream, asked, f"{tmp_path}/state", f"{tmp_path}/marks", k=3)
    running.awaitTermination(120)
    assert [r["vec_id"] for r in latest(spark, f"{tmp_path}/state", 2).orderBy("rank").collect()] == [19, 18, 17]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{bad\n')
    assert files.json_lines(spark, str(tmp_path / "x.jsonl"), schema="a int").count() == 2
