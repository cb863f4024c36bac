"""Scanning a tree of files again and again, reading only what has changed.

A ``Workspace`` keeps two logs: the findings of each run, and a manifest of (path, size, modified, sha256, number of
findings, error, run). A run walks the tree, holds the listing against the manifest, and reads only files that are new
or whose size or time differ; of these only those whose content differs are scanned. Files that are gone leave the
manifest. The manifest's batch is the commit: a run that ends before leaves nothing that counts, and a run over an
unchanged tree reads no file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.plans.files import PLACED, scan_files
from lexigrain.sources.files import extension
from lexigrain.sources.log import BatchLog, shared_folder
from lexigrain.sources.walk import contents, walk

MANIFEST = "path string, batch long, size long, modified long, sha256 string, n_findings long, error string, run long, gone boolean"
FOUND = "path string, run long, member string, name string, code_point long, severity string, safety string, fix string, scalar_index long, byte_offset long, line long, `column` long, detail string"
FIELDS = ["size", "modified", "sha256", "n_findings", "error", "run"]


def standing(rows: DataFrame) -> DataFrame:
    """The newest row of each path, without those that are gone."""
    last = rows.groupBy("path").agg(F.max(F.struct("batch", *FIELDS, "gone")).alias("r"))
    return last.select("path", "r.*").filter("not gone")


class Workspace:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.manifest, self.found = BatchLog(spark, f"{folder}/manifest", MANIFEST), BatchLog(spark, f"{folder}/findings", FOUND)

    def scan(self, roots: list[str], **rules) -> DataFrame:
        """One run; gives (path, error) of folders that could not be listed. ``rules`` are those of ``walk``."""
        spark, scratch = self.spark, shared_folder(self.spark, "workspace")
        batch, run = self.manifest.next_batch(), self.found.next_batch()
        listed, errors = walk(spark, roots, **rules)
        before = standing(self.manifest.read()).drop("batch", "gone")
        known = before.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("sha256").alias("_sha256"), F.col("n_findings").alias("_n"), F.col("error").alias("_error"), F.col("run").alias("_run"))
        # new or touched: read once and kept for the scan's passes
        touched = listed.join(known, "path", "left").filter("_size is null or size <> _size or modified <> _modified")
        touched.write.parquet(f"{scratch}/touched")
        touched = spark.read.schema(touched.schema).parquet(f"{scratch}/touched")
        read = contents(touched.repartition("path")).withColumn("sha256", F.sha2("content", 256))
        read.write.parquet(f"{scratch}/read")
        read = spark.read.schema(read.schema).parquet(f"{scratch}/read")
        held = read.drop("content").join(touched, "path")
        same = F.coalesce((F.col("sha256") == F.col("_sha256")) & F.col("error").isNull(), F.lit(False))
        fresh = read.join(held.filter(~same).select("path"), "path", "left_semi")
        found, files = scan_files(fresh.filter("error is null").select("path", extension(F.col("path")).alias("extension"), "content"))
        self.found.commit(found.select(*PLACED).withColumn("run", F.lit(run)), run)
        counts = files.select("path", F.col("n_findings").alias("n"), F.col("error").alias("scan_error"))
        rows = held.withColumn("same", same).join(counts, "path", "left").select(
            "path", F.lit(batch).alias("batch"), "size", "modified", "sha256", F.when(F.col("same"), F.col("_n")).otherwise(F.coalesce("n", F.lit(0))).alias("n_findings"),
            F.when(F.col("same"), F.col("_error")).otherwise(F.coalesce("error", "scan_error")).alias("error"), F.when(F.col("same"), F.col("_run")).otherwise(F.lit(run)).alias("run"), F.lit(False).alias("gone"),
        )
        gone = before.join(listed, "path", "left_anti").select("path", F.lit(batch).alias("batch"), *FIELDS, F.lit(True).alias("gone"))
        self.manifest.commit(rows.unionByName(gone), batch)
        return errors

    def files(self) -> DataFrame:
        """(path, size, modified, sha256, n_findings, error, run): ``run`` tells which run has scanned the content last."""
        return standing(self.manifest.read()).select("path", *FIELDS)

    def findings(self) -> DataFrame:
        """The findings in the files as they stand."""
        return self.found.read().join(self.files().select("path", "run"), ["path", "run"])

    def compact(self) -> None:
        """Puts the standing manifest in the place of its batches."""
        self.manifest.fold(lambda rows: standing(rows))
