"""What the training-data operators share: scratch tables, Arrow row streams, word scanning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import spread
from tessera.sources.scratch import scratch_path, stored
from tessera.sources.shipping import ship

__all__ = ["SLOTS", "WORD", "free", "maybe_in", "rows_of", "scratch_path", "ship", "spread", "shuffle_partitions", "stored", "table", "word_count"]

#: A word is a maximal run of characters other than ASCII white space. Fixed by the contract.
WORD = r"[^\x20\x09-\x0D]+"

def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(name: str, taken: list[str]) -> str:
    """A column name that none of ``taken`` has, in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


#: Bits of the filter in ``maybe_in``.
SLOTS = 1 << 24


def maybe_in(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` with a column ``maybe``: whether its h may be among those of ``wanted``; true for a few others, never false for one.

    A Bloom filter of one hash: ``SLOTS`` bits in rows of 32,768, so that the broadcast never holds more than ``SLOTS`` / 8 bytes.
    """
    slot = F.expr(f"pmod(h, {SLOTS}L)")
    bits = wanted.groupBy(F.floor(slot / 32768).cast("int").alias("row")).agg(F.bitmap_construct_agg(slot % 32768).alias("bits"))
    at = docs.withColumn("at", F.expr(f"pmod(h, {SLOTS}L)")).join(F.broadcast(bits), F.expr("CAST(floor(`at` / 32768) AS int) = `row`"), "left")
    octet = "cast(conv(hex(substring(bits, cast(`at` % 32768 div 8 + 1 AS int), 1)), 16, 10) AS int)"
    return at.select(*docs.columns, F.expr(f"coalesce(shiftright({octet}, cast(`at` % 8 AS int)) % 2 = 1, false)").alias("maybe"))


def word_count(text: Column) -> Column:
    """Number of words; null counts as 0. Stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Python values of some columns, one row at a time, so that only one long text is held as an object."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    for i in range(batch.num_rows):
        yield tuple(c[i].as_py() for c in columns)
