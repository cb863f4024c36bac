"""Findings that follow their documents: a log of what each new version adds and takes back.

The log (``BatchLog``) is also the state: the findings of a document are the sum of its changes. For a batch of
versions only the last of each document is scanned, and only documents of the batch are looked up. A batch that
is in the log already is not worked on again, so a stream may repeat it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexigrain.operators.scan import find_all
from lexigrain.sources.log import BatchLog

#: What makes a finding the same one in two versions.
PLACE = ["name", "severity", "scalar_index", "byte_offset", "line", "column"]
PLACES = "name string, severity string, scalar_index long, byte_offset long, line long, column long"


def diagnostics_log(spark: SparkSession, path: str, key: str, kind: str = "long") -> BatchLog:
    """Rows (key, version, *PLACE, change): ``change`` is how many such findings the version adds, negative where it takes them back."""
    return BatchLog(spark, path, f"`{key}` {kind}, version long, {PLACES}, change long")


def last_versions(changes: DataFrame, key: str) -> DataFrame:
    """One row for each document; a row without text takes the document away. Of equal versions a row with the greater text counts."""
    order = Window.partitionBy(key).orderBy(F.col("version").desc_nulls_last(), F.col("text").desc_nulls_last())
    return changes.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def standing(rows: DataFrame, key: str) -> DataFrame:
    """The findings that stand by these changes: (key, version that brought the last change, *PLACE, change > 0)."""
    return rows.groupBy(key, *PLACE).agg(F.max("version").alias("version"), F.sum("change").alias("change")).filter("change > 0").select(key, "version", *PLACE, "change")


def record_changes(log: BatchLog, changes: DataFrame, batch: int, key: str, version: str = "version", text: str = "text", wanted=None) -> bool:
    """Scans the last versions in ``changes`` and commits what they change as one batch; False if the batch was there.

    ``wanted`` is a condition on the columns of ``changes`` (a language, a file type): documents that do not meet it have no findings.
    """
    if log.committed(batch):
        return False
    rows = changes.select(F.col(key), F.col(version).cast("long").alias("version"), F.col(text).cast("string").alias("text"), (F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))).alias("_wanted"))
    last = last_versions(rows, key)
    now = find_all(last.filter("_wanted").select(key, "version", "text")).groupBy(key, *PLACE).agg(F.count("*").alias("change"))
    before = standing(log.read(), key).join(last.select(key), key, "left_semi").select(key, *PLACE, (-F.col("change")).alias("change"))
    sums = now.unionByName(before).groupBy(key, *PLACE).agg(F.sum("change").alias("change")).filter("change <> 0")
    return log.commit(sums.join(last.select(key, "version"), key).select(key, "version", *PLACE, "change"), batch)


def follow(changes: DataFrame, log: BatchLog, key: str, checkpoint: str, version: str = "version", text: str = "text", wanted=None, fold_every: int = 100, interval: str | None = None) -> StreamingQuery:
    """Keeps ``log`` up to date with a stream of versions; every ``fold_every`` batches the log becomes its sum."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        record_changes(log, batch, batch_id, key, version, text, wanted)
        batch.unpersist()
        if len(log.batches()) >= fold_every:
            log.fold(lambda rows: standing(rows, key))

    writer = changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
