"""Streams of points and queries: append to an index batch by batch, answer streamed queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfield.plans.index import AnnIndex


def insert_stream(index: AnnIndex, points: DataFrame, checkpoint: str, rebuild: bool = True, **trigger) -> StreamingQuery:
    """Insert each micro-batch of a stream of points; with rebuild it is searchable when the batch ends.

    A batch that is tried again after a failure is inserted once: points that the index holds are left out.
    """

    def each(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["id"]).join(index.points().select("id"), "id", "left_anti")
        index.insert(new)
        if rebuild:
            index.rebuild()

    return points.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def answer_stream(index: AnnIndex, queries: DataFrame, k: int, recall: float, sink: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the answers to each micro-batch of queries (query_id and a point) to a folder of the sink, one for each batch."""

    def each(batch: DataFrame, number: int) -> None:
        index.search(batch, k, recall).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
