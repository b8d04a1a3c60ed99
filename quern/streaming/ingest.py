"""Ingestion of a streaming DataFrame: every micro-batch is one idempotent append."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quern.sources.records import RecordStore


def append_stream(source: DataFrame, store: RecordStore, tenant: str, scope: str, checkpoint: str, started: dt.datetime, once: bool = False) -> StreamingQuery:
    """Appends the records of a streaming source, however many a batch has and however long it runs.

    A batch that is run again after a failure is replayed, not appended twice. A checkpoint's batches are known by it and started.
    """
    name = f"{started.isoformat()}|{checkpoint}"

    def append(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.append_numbered(tenant, scope, batch, name, number)

    writer = source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
