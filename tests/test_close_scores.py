"""Partial lists merge by the scores of the search, as its SQL does, although the scores of results have 32 bits."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import results, search
from tessera.plans.catalogue import ORACLES, QUERIES

#: Products with (1, 1) that are one number in 32 bits.
CLOSE = {8: 2.0**-9, 1: 2.0**-30, 2: 2.0**-29, 3: 2.0**-28, 4: 2.0**-27, 6: 2.0**-26}


def test_scores_that_are_ties_in_32_bits_alone(spark):
    rows = spark.createDataFrame([(i, [1.0, x]) for i, x in CLOSE.items()], "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(5, [1.0, 1.0])], "query_id bigint, embedding array<double>")
    parts = [results.partial_lists(search.dense_topk(asked, rows.filter(F.col("vec_id") % 2 == i), "dot", 4, nan="keep"), asked, i) for i in range(2)]
    found = results.merge_lists(search.union(parts), 4, 2, queries=asked)
    assert [r["vec_id"] for r in found.orderBy("rank").collect()] == ["8", "6", "4", "3"] and dict(found.dtypes)["score"] == "float"
    assert len({r["score"] for r in found.collect()}) == 2


def test_scores_of_both_lengths_agree(spark):
    schema = "part int, query_id string, hit_ids array<string>, hit_scores array<float>, hit_exact array<double>"
    good = [(0, "1", ["a", "b"], [0.1, 1e-9], [0.1, 1e-9]), (1, "1", ["c"], [float("inf")], [1e300])]
    assert [r["vec_id"] for r in results.merge_lists(spark.createDataFrame(good, schema), 3, 2).orderBy("rank").collect()] == ["c", "a", "b"]
    for bad, problem in (([0.1, 1e-8], "scores differ"), ([0.1], "uneven"), ([0.1, None], "nulls in lists"), (None, "null lists")):
        with pytest.raises(Exception, match=problem):
            results.merge_lists(spark.createDataFrame([(*good[0][:4], bad), good[1]], schema), 3, 2).collect()


def test_merge_thresholds_gives_the_rows_of_its_sql(spark, tmp_path):
    """Of 2,000 vectors all products of a query differ, most of them beyond 32 bits alone."""
    step = (F.col("id") * 7919 % 2000) * F.lit(2.0**-40)
    numbers = F.array(F.lit(1.0), step, F.lit(0.0)).cast("array<float>")
    spark.range(2000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 100 == 0, F.array(*[F.lit(x) for x in (0.25, 0.25, 0.0)]).cast("array<float>")).otherwise(numbers).alias("embedding"), F.lit(1).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    db.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    db.sql("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, value DOUBLE)")
    want = db.sql(ORACLES["merge_thresholds"]).fetchall()
    assert sorted(map(tuple, QUERIES["merge_thresholds"](spark, str(tmp_path)).collect())) == sorted(want) and len(want) == 200
