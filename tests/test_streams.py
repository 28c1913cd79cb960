"""Lists as state: the same as a search over all files, also when the stream is stopped and goes on with more files."""

import random

from tessera.operators import search
from tessera.streaming.topk import latest, running_topk


def test_streamed_lists_after_a_restart(spark, tmp_path):
    random.seed(8)
    rows = [(i, [random.choice([0.0, 1.0, 2.0]), random.random()]) for i in range(300)] + [(300, [float("nan"), 1.0]), (301, None)]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(q, [1.0, float(q)]) for q in range(5)], "query_id int, embedding array<double>")

    def run():
        stream = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        running_topk(spark, stream, asked, f"{tmp_path}/lists", f"{tmp_path}/marks", k=7).awaitTermination(200)
        return sorted(map(tuple, latest(spark, f"{tmp_path}/lists").collect()))

    def batch(df):
        return sorted(map(tuple, search.dense_topk(asked, df, "dot", 7).collect()))

    first = corpus.filter("vec_id < 150")
    first.repartition(2).write.parquet(f"{tmp_path}/in")
    assert run() == batch(first)
    corpus.filter("vec_id >= 150").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == batch(corpus)
    assert len(list(tmp_path.glob("lists/batch=*"))) == 3 and sorted(map(tuple, latest(spark, f"{tmp_path}/lists", 1).collect())) == batch(first)


def test_state_has_a_partition_for_so_many_lists(spark, tmp_path):
    """Not one for each shuffle partition of the session, of which each is a task and a store in every micro-batch."""
    corpus = spark.createDataFrame([(i, [float(i % 7)]) for i in range(40)], "vec_id bigint, embedding array<double>")
    corpus.coalesce(1).write.parquet(f"{tmp_path}/in")
    asked = spark.createDataFrame([(q, [1.0]) for q in range(9)], "query_id int, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    stream = spark.readStream.schema(corpus.schema).parquet(f"{tmp_path}/in")
    running_topk(spark, stream, asked, f"{tmp_path}/lists", f"{tmp_path}/marks", k=3).awaitTermination(200)
    assert sorted(map(tuple, latest(spark, f"{tmp_path}/lists").collect())) == sorted(map(tuple, search.dense_topk(asked, corpus, "dot", 3).collect()))
    assert [p.name for p in tmp_path.glob("marks/state/0/*") if p.name.isdigit()] == ["0"] and spark.conf.get("spark.sql.shuffle.partitions") == before
