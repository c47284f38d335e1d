"""Streams into collections: each micro-batch is one upsert or delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.catalog import Collection


def upsert_stream(stream: DataFrame, collection: Collection, checkpoint: str, order_by: str | list[str] = "id", once: bool = False) -> StreamingQuery:
    """Start a query that upserts rows (id, vector, and payload and sparse if they are there). A batch
    that is delivered again replaces its own rows, so the result is the same."""

    def write(batch: DataFrame, epoch: int) -> None:
        collection.upsert_df(batch, order_by)

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
