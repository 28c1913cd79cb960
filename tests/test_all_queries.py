"""The searches of the catalogue ask every row that they should, however large the table."""

import pytest
from pyspark.sql import functions as F

from tessera.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """3,000 vectors and as many documents: more queries than the first numbers reach."""
    d = str(tmp_path_factory.mktemp("tables"))
    rows = spark.range(3000)
    numbers = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (F.pmod(F.xxhash64("id", i), F.lit(1000)) / 1000).cast("float"))
    rows.select(F.col("id").alias("vec_id"), numbers.alias("embedding"), (F.col("id") % 10).cast("int").alias("label")).write.parquet(f"{d}/embeddings.parquet")
    rows.select(F.col("id").alias("doc_id"), F.concat(F.lit("the word "), F.col("id") % 50).alias("text")).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["dense_dot_topk", "sparse_dot", "maxsim_dot", "recall_at_k", "topk_tie_ordinal", "hybrid_rrf"])
def test_every_hundredth_row_is_asked(spark, tables, name):
    got = {r["query_id"] for r in QUERIES[name](spark, tables).select("query_id").distinct().collect()}
    assert got == set(range(0, 3000, 100))
