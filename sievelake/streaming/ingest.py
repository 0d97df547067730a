"""Structured Streaming into a store: each micro-batch is one insert, visible to the next query."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from pyspark.sql.streaming import StreamingQuery

    from sievelake.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start inserting. A batch that is replayed after a failure is not inserted twice by this process."""
    done: set[int] = set()

    def insert(batch: DataFrame, number: int) -> None:
        if number not in done and not batch.isEmpty():
            store.insert_frame(batch)
        done.add(number)

    writer = stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
