"""Joins and windows over a union of inputs that are partitioned alike: the rows that plain counting gives."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import search, truth


def test_overlap_of_two_searches(spark):
    """Both lists come from searches, so all inputs of the union inside are partitioned by query."""
    rows = spark.range(500).select(F.col("id").alias("vec_id"), F.array((F.col("id") % 10).cast("double")).alias("embedding"))
    asked = rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    known = search.dense_topk(asked, rows, "euclidean", 100)
    found = search.dense_topk(asked, rows.withColumn("vec_id", F.col("vec_id").cast("string")), "euclidean", 10).withColumn("vec_id", F.col("vec_id").cast("bigint"))
    got = {r["query_id"]: round(r["rbo_tolerant"], 9) for r in truth.overlap_tolerant(found, known, 10).collect()}
    assert got == dict.fromkeys(range(0, 500, 100), 0.99)


def test_window_over_a_union(spark):
    some = lambda n: spark.range(n).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    both = search.union([some(1000), some(70)])
    got = both.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("k")))
    assert {r["c"] for r in got.collect()} == {2}
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
