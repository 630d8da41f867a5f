"""Keeping an index current from a stream of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def ingest_stream(docs: DataFrame, upsert: Callable[[DataFrame], object], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Upsert each micro-batch of a stream of documents (doc_id, title, text, source, metadata, pos).

    BM25 statistics are global, so they're derived from the chunk table when it's next read, not kept as stream state.
    """
    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upsert(batch) and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
