"""A store read and written by format name: last writes, failed writes, overwrites, and 16-bit vectors."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.sources import pointsource
from tessera.sources.store import ParquetStore


@pytest.fixture(scope="module")
def named(spark):
    pointsource.register(spark)


def points(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, tag string")


def put(rows, path, mode="append"):
    rows.write.format("points").option("path", path).mode(mode).save()


def test_store_by_format_name(spark, named, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(Exception, match="no store"):
        spark.read.format("points").option("path", path).load()
    put(points(spark, [(i, [float(i), 1.0], "a") for i in range(50)]).repartition(3), path)
    put(points(spark, [(3, [99.0, None], None)]), path)
    rows = spark.read.format("points").option("path", path).load()
    assert rows.columns == ["vec_id", "embedding", "tag"] and rows.count() == 51
    log = spark.read.format("points").option("path", path).option("log", "true").load()
    last = {r["vec_id"]: r for r in ParquetStore.last_writes(log, "vec_id").collect()}
    assert len(last) == 50 and last[3]["embedding"] == [99.0, None] and last[3]["tag"] is None and last[4]["tag"] == "a"
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert search.dense_topk(asked, rows.filter("tag = 'a'"), "dot", 1).first()["vec_id"] == 49
    put(points(spark, [(7, [1.0], "new")]), path, "overwrite")
    assert [r["vec_id"] for r in spark.read.format("points").option("path", path).load().collect()] == [7]


def test_failed_write_leaves_nothing(spark, named, tmp_path):
    path = str(tmp_path / "store")
    put(points(spark, [(1, [1.0], "a")]), path)
    bad = points(spark, [(i, [1.0], "b") for i in range(40)]).repartition(4).withColumn("tag", F.when(F.col("vec_id") == 20, F.raise_error(F.lit("broken"))).otherwise(F.col("tag")))
    with pytest.raises(Exception, match="broken"):
        put(bad, path)
    assert [r["vec_id"] for r in spark.read.format("points").option("path", path).load().collect()] == [1]
    assert len(os.listdir(f"{path}/segments")) == 1 == len(pointsource.commits(path))


def test_half_vectors_by_format_name(spark, named, tmp_path):
    x = np.arange(12, dtype=np.float16).reshape(4, 3) / 8
    table = pa.table({"id": pa.array(range(4)), "v": pa.array(list(x), pa.list_(pa.float16()))})
    for i in range(2):
        pq.write_table(table, f"{tmp_path}/{i}.parquet", row_group_size=3)
    rows = spark.read.format("half_vectors").option("path", str(tmp_path)).load()
    assert dict(rows.dtypes) == {"id": "bigint", "v": "array<float>"} and rows.rdd.getNumPartitions() == 4
    assert sorted((r["id"], tuple(r["v"])) for r in rows.collect()) == sorted((i, tuple(map(float, x[i]))) for i in range(4) for _ in range(2))


def test_ties_within_a_write_and_an_empty_store(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "s"))
    asked = spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<float>")
    assert store.search(asked).count() == 0
    store.upsert(points(spark, [(1, [float(i)], str(i)) for i in range(30)]).coalesce(1), 1)
    assert [r["tag"] for r in store.points().collect()] == ["29"]
    store.upsert(points(spark, [(1, [5.0], "x"), (2, [6.0], "y")]), 2)
    assert sorted(r["tag"] for r in store.points().collect()) == ["x", "y"]
