"""Running top-k over a stream of corpus files: each query's list is state, kept by Spark between micro-batches.

A micro-batch passes once through the products of ``search.candidates``; what comes out of it, a few rows for each task and
query, meets the query's list in a state store. Only lists that change are written again. After a restart Spark goes on from
the checkpoint: with the state as of the last whole micro-batch, and the files that come after it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

from tessera.operators.search import candidates

#: Lists in one partition of the state, of which each costs every micro-batch a task and a store.
LISTS = 512
#: The state store that lists in state need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class BestOf(StatefulProcessor):
    """The k best (vec_id, score) of a query, ties to the smaller vec_id; at most k entries of state."""

    def __init__(self, k: int, kind: DataType) -> None:
        self.k, self.kind = k, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getListState("best", StructType([StructField("vec_id", self.kind), StructField("score", DoubleType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803  the interface's names
        held = [tuple(r) for r in self.best.get()]
        now = list(held)
        for r in rows:
            now.append((r["vec_id"], r["score"]))
            if len(now) > 16 * self.k:
                now = self._first(now)
        now = self._first(now)
        if now != held:
            self.best.put(now)
            for rank, (vec_id, score) in enumerate(now, 1):
                yield Row(query_id=key[0], rank=rank, vec_id=vec_id, score=score)

    def _first(self, entries: list[tuple]) -> list[tuple]:
        return sorted(entries, key=lambda e: (-e[1], e[0]))[: self.k]

    def close(self) -> None:
        pass


def running_lists(source: DataFrame, queries: DataFrame, metric: str = "dot", k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score as a stream of changes: the whole list of a query each time that it changes."""
    found = candidates(queries, source, metric, k).filter(~F.isnan("score") & (F.col("score") > F.lit(float("-inf"))))
    query, row = found.schema["query_id"].dataType, found.schema["vec_id"].dataType
    schema = f"query_id {query.simpleString()}, rank int, vec_id {row.simpleString()}, score double"
    return found.groupBy("query_id").transformWithState(BestOf(k, row), schema, "Update", "None")


def running_topk(spark: SparkSession, source: DataFrame, queries: DataFrame, state: str, checkpoint: str, metric: str = "dot", k: int = 10) -> StreamingQuery:
    """Starts the query over all files that are there. ``state/batch=N`` has the lists that changed in micro-batch N; a repeated
    micro-batch replaces its own folder. The state has a partition for each ``LISTS`` queries; a restart keeps what the checkpoint has."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/batch={number}")

    parts = max(1, -(-queries.count() // LISTS))
    settings = dict([PROVIDER, ("spark.sql.shuffle.partitions", str(parts))])
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        lists = running_lists(source, queries, metric, k)
        return lists.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def latest(spark: SparkSession, state: str, batch: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's list as of a micro-batch, by default the last."""
    rows = spark.read.option("basePath", state).parquet(f"{state}/batch=*")
    rows = rows if batch is None else rows.filter(F.col("batch") <= batch)
    last = F.max("batch").over(Window.partitionBy("query_id"))
    return rows.withColumn("__last", last).filter(F.col("batch") == F.col("__last")).select("query_id", "rank", "vec_id", "score")
