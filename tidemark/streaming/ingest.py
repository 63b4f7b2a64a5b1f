"""Streams into a store, and streams of a store's segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.store.db import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch of key, value (and meta, type, seq) as one commit.

    A batch's number goes into the manifest by the very commit that adds its rows, so
    that a batch replayed after a crash is skipped if it was stored and stored if not.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        if epoch > store.group.doc.get("epochs", {}).get(checkpoint, -1) and not batch.isEmpty():
            store.append(batch, {checkpoint: epoch})

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()
