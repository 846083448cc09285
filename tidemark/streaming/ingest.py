"""A Structured Streaming query that feeds a store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def stream_into(store: Store, measurement: str, stream: DataFrame, checkpoint: str, *, ts_col: str = "ts_ms", tag_cols: Sequence[str] = (), fields: Sequence[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Insert each micro-batch of ``stream`` once: its number is committed with its points, so one that is run again is left out."""

    def write(batch: DataFrame, number: int) -> None:
        store.insert(measurement, batch, ts_col=ts_col, tag_cols=tag_cols, fields=fields, stream=(checkpoint, number))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
