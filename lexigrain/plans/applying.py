"""Applying approved plans to a store of copies, patches, rescans and provenance.

Each is a log of batches, and one apply is one batch of each, written in that order from the batch before it: the copies
as they were stored are diffed, scanned anew and recorded. An apply that ended half-way is taken up where it stopped when
it is repeated with its number, and a repeated one changes nothing, so every repaired document has one record.
Provenance and rescans are JSON lines. A document whose text is not the one planned for is left out and given back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.operators import repair
from lexigrain.operators.scan import find_all
from lexigrain.sources.log import BatchLog, json_records

SIDE = "struct<sha256: string, bytes: long>"
KEPT = "array<struct<line: long, column: long, code_point: long, name: string>>"
UNEXPECTED = "array<struct<name: string, extra: long, description: string>>"
APPLIED = "array<struct<id: long, action: string>>"


def by_collation(names: Column) -> Column:
    """Names sorted as people read them."""
    return F.transform(F.array_sort(F.transform(names, lambda x: F.collate(x, "UNICODE"))), lambda x: F.collate(x, "UTF8_BINARY"))


class RepairStore:
    def __init__(self, spark: SparkSession, folder: str, key: str = "doc_id", kind: str = "long"):
        self.spark, self.folder, self.key = spark, folder, key
        own = f"`{key}` {kind}"
        self.copies = BatchLog(spark, f"{folder}/copies", f"{own}, text string, input {SIDE}, output {SIDE}, applied_edits long, applied {APPLIED}, kept {KEPT}")
        self.patches = BatchLog(spark, f"{folder}/patches", f"{own}, diff string")
        self.rescan_schema = f"{own}, output_sha256 string, expected_residual_names array<string>, actual_finding_names array<string>, expected_residual long, actual_findings long, unexpected {UNEXPECTED}, verified boolean, rescanned_at string"
        self.rescans = BatchLog(spark, f"{folder}/rescans", self.rescan_schema, "json")
        self.record_schema = f"{own}, settings_digest string, input {SIDE}, output {SIDE}, applied {APPLIED}, applied_edits long, kept {KEPT}, approval string, operator string, recorded_at string, verified boolean"
        self.records = BatchLog(spark, f"{folder}/provenance", self.record_schema, "json")

    def apply(self, docs: DataFrame, items: DataFrame, number: int, text: str = "text", settings_digest: str = "", approval: str = "", operator: str | None = None, at: str | None = None) -> DataFrame:
        """Applies the decided ``items`` of ``docs`` as apply ``number``; gives the keys refused because their text has changed. ``at`` is an ISO time, by default now."""
        key = self.key
        planned = docs.join(items.select(key).distinct(), key, "left_semi").select(key, F.col(text).alias("text"))
        copies, drifted = repair.applied(planned, items, key)
        if not self.copies.committed(number):
            self.copies.commit(self._copies(copies, items), number)
        stored = self.copies.read_batch(number)
        if not self.patches.committed(number):
            pairs = stored.filter("applied_edits > 0").select(key, F.col("text").alias("new")).join(planned.select(key, F.col("text").alias("old")), key)
            self.patches.commit(repair.diffs(pairs, key, "old", "new"), number)
        now = F.lit(at) if at else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        if not self.rescans.committed(number):
            self.rescans.commit(self.rescanned(stored).withColumn("rescanned_at", now), number)
        if not self.records.committed(number):
            checked = self.rescans.read_batch(number).select(key, "verified")
            extra = {"settings_digest": F.lit(settings_digest), "approval": F.lit(approval), "operator": F.lit(operator).cast("string"), "recorded_at": now}
            self.records.commit(stored.drop("text").withColumns(extra).join(checked, key), number)
        return drifted.select(key)

    def _copies(self, copies: DataFrame, items: DataFrame) -> DataFrame:
        done = F.col("decision") == "approved"
        per = items.groupBy(self.key).agg(
            F.array_sort(F.collect_list(F.when(done, F.struct(F.col("index").cast("long").alias("id"), "action")))).alias("applied"),
            F.array_sort(F.collect_list(F.when(~done, F.struct("line", "column", F.col("code_point").cast("long").alias("code_point"), "name")))).alias("kept"),
            F.first("input_bytes").alias("input_bytes"),
        )
        side = lambda sha, n: F.struct(F.col(sha).alias("sha256"), n.cast("long").alias("bytes"))
        joined = copies.join(per, self.key)
        return joined.select(self.key, "text", side("input_sha256", F.col("input_bytes")).alias("input"), side("output_sha256", F.octet_length("text")).alias("output"), F.col("n_edits").alias("applied_edits"), "applied", "kept")

    def rescanned(self, copies: DataFrame) -> DataFrame:
        """What a new scan finds in copies (key, text, output, kept), against what their plans left: one row per copy."""
        key = self.key
        found = find_all(copies.select(key, "text")).groupBy(key, "name").agg(F.count("*").alias("n")).groupBy(key).agg(F.collect_list(F.struct("name", "n")).alias("found"))
        rows = copies.join(found, key, "left").select(
            key, F.col("output.sha256").alias("output_sha256"), F.transform("kept", lambda k: k["name"]).alias("expected"), F.coalesce("found", F.array().cast("array<struct<name: string, n: long>>")).alias("found"),
        )
        extra = F.transform("found", lambda x: F.struct(x["name"].alias("name"), (x["n"] - F.size(F.filter("expected", lambda e: e == x["name"]))).cast("long").alias("extra")))
        told = F.transform(F.filter(extra, lambda x: x["extra"] > 0), lambda x: F.struct(x["name"].alias("name"), x["extra"].alias("extra"), F.concat(x["extra"].cast("string"), F.lit(" unexpected "), x["name"], F.lit(" finding(s) in repaired copy")).alias("description")))
        return rows.select(
            key, "output_sha256", by_collation(F.col("expected")).alias("expected_residual_names"),
            by_collation(F.flatten(F.transform("found", lambda x: F.array_repeat(x["name"], x["n"].cast("int"))))).alias("actual_finding_names"),
            F.size("expected").cast("long").alias("expected_residual"), F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("actual_findings"), F.array_sort(told).alias("unexpected"),
        ).withColumn("verified", F.size("unexpected") == 0)

    def provenance(self) -> tuple[DataFrame, DataFrame]:
        """(records, (record, error)) as read back from the JSON lines."""
        base, after = self.records._folders()
        paths = [f"{self.records.path}/batch={b}" for b in after]
        if not paths:
            return self.records.read(), self.spark.createDataFrame([], "record string, error string")
        return json_records(self.spark, paths, self.record_schema)

    def verify(self) -> DataFrame:
        """(key, intact, unexpected, verified) of all records against the copies in the store."""
        records = self.provenance()[0]
        return repair.verified(self.copies.read().select(self.key, "text"), records.select(self.key, F.col("output.sha256").alias("output_sha256"), "kept"), self.key)
