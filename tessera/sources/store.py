"""A store of points on Parquet: upsert by identifier, where the last write wins, and an exact search target over it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.operators.prepare import not_loaded, upserted
from tessera.operators.search import dense_topk
from tessera.sources.scratch import stored


class ParquetStore:
    """Each upsert appends a segment; readers keep the last write of each identifier."""

    def __init__(self, spark: SparkSession, root: str, identifier: str = "vec_id") -> None:
        self.spark, self.root, self.identifier = spark, root.rstrip("/"), identifier

    def upsert(self, points: DataFrame, write: int) -> None:
        """Segment ``write`` of the store; a repeated number replaces the segment, so a retry does no harm. Of rows of one identifier the
        last one in the order of ``points`` counts."""
        points.withColumn("__place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{self.root}/write={write}")

    @staticmethod
    def last_writes(log: DataFrame, identifier: str, order: tuple[str, ...] = ("write", "place")) -> DataFrame:
        """The last row of each identifier in a log, without the columns that order it."""
        return upserted(log, identifier, list(order)).drop(*order)

    def points(self) -> DataFrame | None:
        try:
            log = self.spark.read.option("basePath", self.root).option("mergeSchema", True).parquet(f"{self.root}/write=*")
        except AnalysisException:
            return None
        return self.last_writes(log, self.identifier, ("write", "__place"))

    def missing(self, points: DataFrame) -> DataFrame:
        held = self.points()
        return points if held is None else not_loaded(points, held, self.identifier)

    def exists(self, identifiers: DataFrame) -> DataFrame:
        """Of a column of identifiers those that the store has."""
        held = self.points()
        wanted = identifiers.select(self.identifier)
        return wanted.limit(0) if held is None else wanted.join(held.select(self.identifier), self.identifier, "left_semi")

    def compact(self, write: int) -> None:
        """All points as the one segment ``write``, higher than any other; the others go."""
        held = self.points()
        if held is None:
            return
        self.upsert(stored(held, "compact"), write)
        fs, path = self._folder()
        for s in fs.listStatus(path):
            if s.getPath().getName().startswith("write=") and s.getPath().getName() != f"write={write}":
                fs.delete(s.getPath(), True)

    def drop(self) -> None:
        """Delete the store."""
        fs, path = self._folder()
        fs.delete(path, True)

    def _folder(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def search(self, queries: DataFrame, metric: str = "dot", k: int = 10, where: dict | None = None) -> DataFrame:
        """An empty store has no hits."""
        held = self.points()
        if held is None:
            held = queries.select(F.lit(None).cast("bigint").alias(self.identifier), "embedding").limit(0)
            where = None
        return dense_topk(queries, held.withColumnRenamed(self.identifier, "vec_id"), metric, k, where)
