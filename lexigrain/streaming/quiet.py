"""Scanning a document once it has been still for a while.

Every edit (key, at, version, text) is kept until ``quiet_ms`` have passed since it; it comes out if no
other edit of its document came within that time, else it is dropped. Time is that of the edits (``at``, with a
watermark; then the result depends on the edits alone, not on how they fall into batches) or the clock's
(``live``: ``at`` is when an edit arrives). What waits is keyed state with a timer for the edit that waits longest,
so it outlives a restart from the checkpoint, and is bounded by the edits of a quiet period and the
watermark's delay. Of edits at the same time the one with the greatest version counts. At the end of
a finite feed, edits come out that are still by the last watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lexigrain.operators.scan import find_all

EDIT = StructType([StructField("at", LongType()), StructField("version", LongType()), StructField("text", StringType())])
STORES = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settled(waiting: list[tuple[int, int, str | None]], now: int, quiet_ms: int) -> tuple[list[tuple], list[tuple]]:
    """(edits that were still for the quiet time, edits that wait on), by time and version."""
    waiting = sorted(waiting, key=lambda e: e[:2])
    out, left = [], []
    for e, after in zip(waiting, chain(waiting[1:], [None])):  # noqa: B905  none waiting gives none
        if e[0] + quiet_ms > now:
            left.append(e)
        elif after is None or after[0] - e[0] >= quiet_ms:
            out.append(e)
    return out, left


class QuietEdits(StatefulProcessor):
    def __init__(self, key: str, quiet_ms: int, live: bool):
        self.key, self.quiet_ms, self.live = key, quiet_ms, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EDIT)

    def frame(self, key, edits: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame(edits, columns=["at_ms", "version", "text"])
        rows.insert(0, self.key, [key[0]] * len(rows))
        return rows

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.live else None
        new = []
        for f in rows:
            at = [now] * len(f) if self.live else map(int, f["at_ms"])
            version = [int(v) if v is not None and v == v else 0 for v in f["version"]]
            new += zip(at, version, [t if isinstance(t, str) else None for t in f["text"]], strict=True)
        first = min((e[0] for e in self.waiting.get()), default=None)
        self.waiting.appendList(new)
        # one timer, for the edit that waits longest
        if new and (first is None or min(e[0] for e in new) < first):
            self.handle.registerTimer(min(e[0] for e in new) + self.quiet_ms)
        yield self.frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.live else timerValues.getCurrentWatermarkInMs()
        out, left = settled([tuple(e) for e in self.waiting.get()], now, self.quiet_ms)
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] + self.quiet_ms)
        else:
            self.waiting.clear()
        yield self.frame(key, out)


def quiet_versions(changes: DataFrame, key: str, at: str, version: str = "version", text: str = "text", quiet_ms: int = 500, delay: str = "0 seconds", live: bool = False) -> DataFrame:
    """The edits of a streaming frame after which their document was still: (key, at_ms, version, text). Edits without a key or time are left out.

    Starting a query needs ``with_rocks(spark)``: keyed state with timers is kept in RocksDB.
    """
    rows = changes.select(F.col(key), F.col(at).cast("timestamp").alias("_at"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"), F.col(version).cast("long").alias("version"), F.col(text).cast("string").alias("text"))
    rows = rows.filter(F.col(key).isNotNull() & F.col("_at").isNotNull())
    if not live:
        rows = rows.withWatermark("_at", delay)
    kind = dict(changes.dtypes)[key]
    return rows.groupBy(key).transformWithStateInPandas(QuietEdits(key, quiet_ms, live), f"`{key}` {kind}, at_ms long, version long, text string", "Append", "ProcessingTime" if live else "EventTime")


def with_rocks(spark: SparkSession) -> None:
    spark.conf.set(STORES, ROCKS)


def scan_quiet(changes: DataFrame, key: str, at: str, sink: Callable[[DataFrame, int], object], checkpoint: str, interval: str | None = None, **options) -> StreamingQuery:
    """Runs ``sink(findings, batch_id)`` for the texts that have come to rest in each batch: (key, at_ms, version, and what ``find_all`` adds).

    A batch may come again after a crash; ``BatchLog.commit`` is such a sink. Without an interval it takes what is there and stops.
    """
    with_rocks(changes.sparkSession)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        sink(find_all(batch).drop("text"), batch_id)
        batch.unpersist()

    writer = quiet_versions(changes, key, at, **options).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
