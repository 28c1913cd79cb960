"""What a pass counts itself: skipped inputs, failed batches and files; and names of grids."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.operators import embedding, load
from tessera.operators.embedding import Entry
from tessera.plans import grid
from tessera.sources import files


def test_skipped_inputs_are_counted_in_the_pass(spark):
    rows = spark.createDataFrame([("a b", "x"), (" ", "y"), (None, None), ("c", "")], "t string, u string")
    told = Observation()
    entries = [Entry("t", "dense", "hashing", input_column="t"), Entry("s", "sparse", "hashing", input_column="t"), Entry("u", "dense", "hashing", input_column="u")]
    assert embedding.embed(rows, entries, drop=["t", "u"], observation=told).filter("t_embedding IS NOT NULL").count() == 2
    assert told.get == {"seen": 4, "skipped_t": 2, "skipped_s": 2, "skipped_u": 2}


def test_failed_batches_are_kept(spark):
    def send(rows):
        if any(r["i"] % 7 == 3 for r in rows):
            error = ValueError("full")
            error.retry = rows[0]["i"] % 2 == 0
            raise error

    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "i bigint, k string").repartition(3)
    told = load.pour(rows, send, "k", 1, attempts=3, sleep=lambda s: None).cache()
    lost = load.lost_rows(told, rows.schema)
    assert sorted(r["i"] for r in lost.collect()) == [3, 10, 17, 24, 31, 38] and {r["error"] for r in lost.collect()} == {"ValueError: full"}
    sums = told.agg(*[F.sum(c).alias(c) for c in ("batches", "points", "retries", "failed")]).first()
    assert tuple(sums) == (40, 34, 6, 6)
    # the rate is that of the job: its tasks share it
    waits = spark.sparkContext.accumulator(0)
    assert load.pour(rows, lambda r: None, "k", 40, per_second=10.0, sleep=lambda s: waits.add(1)).agg(F.sum("points")).first()[0] == 40 and waits.value > 0


def test_poured_files_are_the_same_when_sent_again(spark, tmp_path):
    send = load.FolderSender(f"{tmp_path}/points")
    for _ in range(2):
        send([{"i": 1, "k": "a"}, {"i": 2, "k": "b"}])
    assert spark.read.parquet(f"{tmp_path}/points").count() == 2


def test_files_that_cannot_be_read(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/in")
    (tmp_path / "in" / "bad.parquet").write_bytes(b"PAR1 nothing")
    names = files.files(spark, f"{tmp_path}/in")
    with pytest.raises(ValueError, match="1 of 4 files"):
        load.readable(spark, names)
    good, bad = load.readable(spark, names, most_failed=1)
    assert len(good) == 3 and bad[0][0].endswith("bad.parquet") and spark.read.parquet(*good).count() == 30


def test_grids():
    got = grid.combinations({"hnsw.m": [8, None], "quantization": [{"type": "int8", "bits": 4}, "none"], "n": [1.5]})
    assert got[0] == {"hnsw": {"m": 8}, "quantization": {"type": "int8", "bits": 4}, "n": 1.5, "_name": "m8_quantizationtypeint8_bits4_n1_5"}
    assert got[3] == {"quantization": "none", "n": 1.5, "_name": "quantizationnone_n1_5"} and len(got) == 4
    assert grid.combinations({}) == [{"_name": "default"}] == grid.combinations({"a": [None]})
    assert grid.segment("a.b-c d!") == "a_b_c_d"
    order = grid.by_rebuild_cost(grid.combinations({"ef": [1, 2], "hnsw.m": [8, 16], "x": [0]}))
    assert [(s["hnsw"]["m"], s["ef"]) for s in order] == [(16, 1), (16, 2), (8, 1), (8, 2)]
    assert [s["q"] for s in grid.by_rebuild_cost([{"q": 2, "a": 1}, {"q": 1, "a": 1}, {"q": 3, "a": 0}], ("a", "q"))] == [3, 1, 2]


def test_bounds_of_a_block_stay_small():
    """What a task holds for a block of scores does not grow with queries or rows: ``CELLS`` scores and a few arrays of that size."""
    import tracemalloc

    import numpy as np

    from tessera.operators import search

    q, c = np.ones((search.CELLS // 1024, 8)), np.ones((1024, 8))
    tracemalloc.start()
    search._block_bounds("euclidean", q, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20


def test_scores_of_a_block_stay_small(spark, monkeypatch):
    """The kernel of a dense search gives blocks of a quarter of ``CELLS`` scores to the bounds, whose arrays then fit."""
    import numpy as np
    import pyarrow as pa

    from tessera.operators import search

    asked = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(500)], "query_id bigint, embedding array<double>")
    corpus = spark.createDataFrame([(i, [float(i % 7), 2.0]) for i in range(2000)], "vec_id bigint, embedding array<double>")
    cells, kernels, bounds = [], [], search._block_bounds
    monkeypatch.setattr(search, "_block_bounds", lambda metric, q, c: cells.append(len(q) * len(c)) or bounds(metric, q, c))
    monkeypatch.setattr(search, "_product_pass", lambda rows, sent, kernel, keys, k: kernels.append((kernel, sent)) or rows)
    search.candidates(asked, corpus, "euclidean", 3)
    (kernel, sent), = kernels
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array([[float(i % 7), 2.0] for i in range(2000)])], ["vec_id", "embedding"])
    got = list(kernel(batch, sent, {}))
    assert len(got) == 500 and sum(cells) == 500 * 2000 and max(cells) <= search.CELLS // 4
    assert np.array_equal(got[3][1], [3, 10, 17])


def test_a_slice_of_queries_without_tokens():
    import numpy as np

    from tessera.operators import masks

    none, row, code = np.empty(0, np.int64), np.array([0, 1]), np.array([4, 4])
    assert not masks._all_tokens(none, none, 3, row, code, 2).any()
    assert masks._all_tokens(np.array([1]), np.array([4]), 3, row, code, 2).tolist() == [[False, False], [True, True], [False, False]]


def test_candidates_are_sent_in_slices(spark, monkeypatch):
    """A batch sends its candidates as they come, so what is held does not grow with queries times k; and blocks count the k scores."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField

    from tessera.operators import search

    class Rows:
        sparkSession, schema = spark, spark.range(0).withColumnRenamed("id", "vec_id").schema

        def mapInArrow(self, run, schema):
            return run

    kernel = lambda batch, sent, floors: (((q,), np.arange(10), np.full(10, 1.0 + q)) for q in range(100))
    monkeypatch.setattr(search, "FOUND", 64)
    run = search._product_pass(Rows(), None, kernel, [StructField("query_id", LongType())], 10)
    sent = list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(10))], ["vec_id"])])))
    assert sum(b.num_rows for b in sent) == 1000 and max(b.num_rows for b in sent) < 64 + 10
    assert sorted(x for b in sent for x in b.column(0).to_pylist()) == sorted(list(range(100)) * 10)
    assert search._block_rows(1, 100) * 8 * 101 <= search.QUERY_BYTES and search._block_rows(None, 10) > 1
