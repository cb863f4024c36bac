"""Scanning a feed of changing documents in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrain.operators.scan import find_characters


def findings_stream(changes: DataFrame) -> DataFrame:
    """Findings of a streaming frame with ``text``: stateless, so no watermark."""
    return find_characters(changes)


def latest(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last version of each document in a batch: a trigger interval is the quiet time of an editor."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return batch.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def scan_changes(changes: DataFrame, key: str, order: str, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Runs ``sink(findings, batch_id)`` for the latest versions of each batch; without an interval it takes what is there and stops."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(find_characters(latest(batch, key, order)), batch_id)

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
