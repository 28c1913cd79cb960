"""Scores of all pairs: the size of what is written, what is held, and distances of close vectors."""

import math
from decimal import Decimal
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.operators import search


def test_files_of_pairs_are_small(spark, tmp_path):
    """Equal scores stand together, so a row takes about a third of its three doubles in files (F11)."""
    rows = spark.range(2000).select(F.col("id").alias("vec_id"), F.array(*[F.randn(i) for i in range(16)]).alias("embedding"))
    rows = rows.select("vec_id", F.transform("embedding", lambda x: x / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, y: s + y * y))).alias("embedding")).coalesce(1)
    found = search.dense_scores(rows.withColumnRenamed("vec_id", "query_id"), rows)
    found.select("query_id", "vec_id", *[(F.round(m, 6) + F.lit(0.0)).alias(m) for m in ("dot", "cosine", "euclidean")]).write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 2000 * 2000 and got.groupBy("query_id").agg(F.sum("vec_id").alias("n")).filter("n = 1999000").count() == 2000
    assert sum(p.stat().st_size for p in Path(f"{tmp_path}/out").glob("*.parquet")) < 14 * 2000 * 2000


def test_pairs_come_by_rising_product_in_slices(spark, monkeypatch):
    class Rows:
        sparkSession, schema = spark, spark.range(0).withColumnRenamed("id", "vec_id").schema
        select = filter = lambda self, *_: self
        mapInArrow = lambda self, run, schema: run

    asked = spark.createDataFrame([(i, [float(i), -1.0]) for i in range(30)], "query_id bigint, embedding array<double>")
    vectors = [[float(i % 7), 2.0] for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(vectors)], ["vec_id", "embedding"])
    monkeypatch.setattr(search, "SORTED", 500)
    monkeypatch.setattr(search, "ENTRIES", 64)
    sent = list(search.dense_scores(asked, Rows())(iter([batch])))
    assert max(b.num_rows for b in sent) <= 32  # two components each
    told = [r for b in sent for r in b.to_pylist()]
    for part in (told[:500], told[500:1000], told[1000:]):
        assert len({r["query_id"] for r in part}) == 10 and [r["dot"] for r in part] == sorted(r["dot"] for r in part)
    assert sorted((r["query_id"], r["vec_id"]) for r in told) == [(q, v) for q in range(30) for v in range(50)]
    for r in told:
        q, v = [float(r["query_id"]), -1.0], vectors[r["vec_id"]]
        dot = q[0] * v[0] + q[1] * v[1]
        assert r["dot"] == dot and math.isclose(r["cosine"], dot / math.hypot(*q) / math.hypot(*v), abs_tol=1e-12) and math.isclose(r["euclidean"], -math.dist(q, v), abs_tol=1e-12)


def test_distances_of_close_vectors(spark):
    base = np.random.default_rng(5).normal(size=64) * 1e4
    vectors = [base, base + np.eye(64)[3] * 1e-3, base * 2, np.full(64, 3e200), base[:2]]
    rows = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(vectors)], (9, None)], "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(Decimal("7.50"), base.tolist()), (Decimal("8.00"), base[:2].tolist()), (None, [3e200] * 64)], "query_id decimal(9,2), embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["euclidean"] for r in search.dense_scores(asked, rows, ("euclidean",)).collect()}
    assert len(got) == 9 and got[Decimal("7.50"), 0] == got[Decimal("8.00"), 4] == got[None, 3] == 0
    assert math.isclose(got[Decimal("7.50"), 1], -1e-3, rel_tol=1e-6) and math.isclose(got[Decimal("7.50"), 2], -float(np.linalg.norm(base)), rel_tol=1e-12)
    assert math.isclose(got[None, 0], -24e200, rel_tol=1e-12) and search.dense_scores(asked, rows.limit(0)).count() == 0
