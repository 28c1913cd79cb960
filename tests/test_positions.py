"""Late fetch by file and row, and counts from footers."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import positions, search
from tessera.sources import files


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Seven files in a folder whose name has a blank, with the same scores everywhere."""
    d = str(tmp_path_factory.mktemp("a b"))
    rows = spark.range(700).select(F.concat(F.lit("id"), (999 - F.col("id")).cast("string")).alias("vec_id"), F.array((F.col("id") % 5).cast("double"), (F.col("id") == 123).cast("double")).alias("embedding"), (F.col("id") * 2).alias("label"))
    rows.repartitionByRange(7, "label").sortWithinPartitions("label").write.parquet(f"{d}/c")
    return f"{d}/c"


def test_winners_alone_are_read(spark, corpus):
    places = positions.layout(spark, corpus)
    assert len(places.names) == 7 and places.rows == 700
    rows = positions.positioned(spark, places, corpus)
    order = [r["label"] for r in rows.orderBy("place").select("label").collect()]
    assert order == list(range(0, 1400, 2))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id int, embedding array<double>")
    told = {}
    found = search.dense_topk(asked.filter("query_id = 2"), rows.select(F.col("place").alias("vec_id"), "embedding"), "dot", 1)
    got = positions.with_payload(spark, places, found, ["vec_id", "label"], told).collect()
    assert [(r["vec_id"], r["label"], r["rank"]) for r in got] == [("id876", 246, 1)] and told["files"] == 1
    found = search.dense_topk(asked.filter("query_id = 1"), rows.select(F.col("place").alias("vec_id"), "embedding"), "dot", 3)
    out = positions.with_payload(spark, places, found, ["label"], told)
    assert [r["label"] for r in out.orderBy("rank").collect()] == [8, 18, 28] and told["files"] == 1 < len(places.names)
    plan = positions.fetched(spark, places, spark.createDataFrame([(3,), (3,), (650,), (-1,), (700,)], "place bigint"), ["label"], told)
    assert sorted(map(tuple, plan.collect())) == [(3, 6), (650, 1300)] and told["files"] == 2
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<label:bigint" in text and "embedding" not in text and "vec_id" not in text
    assert positions.fetched(spark, places, spark.createDataFrame([], "place bigint"), ["label"]).count() == 0


def test_counts_read_no_column(spark, corpus):
    counts = files.file_counts(spark, corpus)
    assert "ReadSchema: struct<>" in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["rows"] for r in counts.collect()) == [100] * 7
    told = files.inspect(spark.read.parquet(corpus)).collect()
    assert {(r["column"], r["dims"], r["rows"], r["files"]) for r in told} == {("vec_id", None, 700, 7), ("embedding", 2, 700, 7), ("label", None, 700, 7)}
    window = files.window_of(files.scan(spark, corpus), 150, 100)
    assert sorted(r["label"] for r in window.collect()) == list(range(300, 500, 2))


def test_points_of_a_table_of_several_files(spark, tmp_path):
    """Identifiers by the place in the table: row numbers of files repeat, and so did the identifiers made of them."""
    import hashlib

    from tessera.plans.catalogue import QUERIES

    for i in range(3):
        spark.range(i * 50, i * 50 + 50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet/{i}")
    got = {r["__id"].replace("-", ""): r["n"] for r in QUERIES["load_points"](spark, str(tmp_path)).collect()}
    assert got == {hashlib.md5(f"documents.parquet:{i}".encode()).hexdigest(): i + 1 for i in range(150)}


def test_a_folder_named_as_a_file_is_one(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/t")
    spark.range(0).write.parquet(f"{tmp_path}/none.parquet")
    told = lambda name: [(r["rows"], r["files"]) for r in files.inspect(spark.read.parquet(f"{tmp_path}/{name}")).collect()]
    assert told("t.parquet") == [(30, 1)] and told("t") == [(30, 3)] and told("none.parquet") == [(0, 0)]
