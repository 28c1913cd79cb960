"""Rows by their place in a corpus of files: searches carry places, and identifiers and payload are read for the winners alone.

The place of a row is its number among all rows, files in the order of their names. How many rows each file has stands in the
files' footers, so places cost no pass over data; they order ties by position, and from a place follow the file and the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import file_counts, scan
from tessera.sources.scratch import stored
from tessera.sources.shipping import ship


@dataclass
class Layout:
    """The files of a corpus in order, and the place of the first row of each; a name and a number for each file."""

    names: list[str]
    firsts: np.ndarray
    rows: int

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.names, self.firsts.tolist(), strict=True)), "filename string, __first bigint")


def layout(spark: SparkSession, *paths: str) -> Layout:
    """From footers alone."""
    counts = sorted((r["filename"], r["rows"]) for r in file_counts(spark, *paths).collect())  # a row for each file
    firsts = list(accumulate((n for _, n in counts), initial=0))
    return Layout([f for f, _ in counts], np.array(firsts[:-1], np.int64), firsts[-1])


def positioned(spark: SparkSession, places: Layout, *paths: str) -> DataFrame:
    """The rows of the files with a column ``place``."""
    rows = scan(spark, *paths).join(F.broadcast(places.frame(spark)), "filename")
    return rows.withColumn("place", F.col("__first") + F.col("file_row_number")).drop("__first", "filename", "file_row_number")


def fetched(spark: SparkSession, places: Layout, wanted: DataFrame, columns: list[str], told: dict | None = None) -> DataFrame:
    """place and ``columns`` of the rows at the places in ``wanted`` (place), each once.

    Only files in which a wanted row lies are opened, and of these only the columns asked for are read. ``told`` gets the number of
    files opened as ``files``.
    """
    ship(spark)
    firsts = spark.sparkContext.broadcast(places.firsts)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False)
            file = np.searchsorted(firsts.value, at, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(file), pa.array(at - firsts.value[file])], ["place", "file", "row"])

    inside = wanted.select(F.col("place").cast("long").alias("place")).filter((F.col("place") >= 0) & (F.col("place") < places.rows)).distinct()
    located = stored(inside.mapInArrow(locate, "place bigint, file bigint, row bigint"), "located")
    opened = sorted(r["file"] for r in located.select("file").distinct().collect())  # at most a number for each file
    if told is not None:
        told["files"] = len(opened)
    if not opened:
        return scan(spark, *[unquote(n) for n in places.names[:1]]).select(F.lit(0).cast("long").alias("place"), *columns).limit(0)
    names = spark.createDataFrame([(i, places.names[i]) for i in opened], "file bigint, filename string")
    rows = scan(spark, *[unquote(places.names[i]) for i in opened]).select(*columns, "filename", F.col("file_row_number").alias("row"))
    return rows.join(located.join(names, "file"), ["filename", "row"]).select("place", *columns)


def with_payload(spark: SparkSession, places: Layout, found: DataFrame, columns: list[str], told: dict | None = None) -> DataFrame:
    """Results of a search whose vec_id is a place (query_id, rank, vec_id, score), with the columns of the winners in place of it."""
    hits = stored(found.withColumnRenamed("vec_id", "place"), "hits")
    return hits.join(fetched(spark, places, hits, columns, told), "place").select("query_id", "rank", "score", *columns)
