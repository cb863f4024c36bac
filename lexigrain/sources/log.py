"""Append-only logs of batches in a folder that all tasks share.

A batch is written beside the log and then renamed into it, so it is there as a whole or not at
all, and a batch that is there already is left as it is: repeating a commit after a crash
adds nothing. Readers list the batches first and read just these. ``fold`` puts a summary in the
place of all batches up to one, which then counts as committed.

The rename must fail if its target is there, as it does on HDFS and local file systems.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the session's ``spark.checkpoint.dir``; where none is set and all runs on one machine, under a temporary folder that becomes it."""
    sc, setting = spark.sparkContext, "spark.checkpoint.dir"
    found = spark.conf.get(setting, None) or sc.getConf().get(setting) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"{setting} must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexigrain-"))
        found = sc.getCheckpointDir()
    return f"{found}/{name}-{uuid.uuid4().hex}"


def put(rows: DataFrame, folder: str, name: str, form: str = "parquet") -> bool:
    """Writes ``rows`` beside ``folder``'s entries and renames them to ``name`` there; False, and nothing changed, if that is there already."""
    spark = rows.sparkSession
    staged, jvm = f"{folder}/_staged/{uuid.uuid4().hex}", spark._jvm
    rows.write.format(form).save(staged)
    conf = spark._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(x) for x in (staged, f"{folder}/{name}"))
    fs = source.getFileSystem(conf)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(source).toUri(), conf)
    try:
        context.rename(source, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception:
        fs.delete(source, True)
        if not fs.exists(target):
            raise
        return False  # another writer was first
    return True


class BatchLog:
    """Batches of rows of one schema, numbered from 0 up; ``form`` is parquet or json."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, form: str = "parquet"):
        if form not in ("parquet", "json"):
            raise ValueError("a log is parquet or json")
        self.spark, self.path, self.form = spark, path.rstrip("/"), form
        # what is read back may be null anywhere
        self.schema = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folders(self) -> tuple[int, list[int]]:
        """(last batch inside the newest summary or -1, batches after it)."""
        fs, p = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        number = lambda kind: sorted(int(n.removeprefix(kind)) for n in names if n.startswith(kind) and n.removeprefix(kind).isdigit())
        base = max(number("upto="), default=-1)
        return base, [b for b in number("batch=") if b > base]

    def batches(self) -> list[int]:
        """Committed batches that no summary holds; a summary keeps this short."""
        return self._folders()[1]

    def next_batch(self) -> int:
        base, after = self._folders()
        return max([base, *after]) + 1

    def committed(self, batch: int) -> bool:
        base, after = self._folders()
        return batch <= base or batch in after

    def _put(self, rows: DataFrame, name: str) -> bool:
        rows = rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        return put(rows, self.path, name, self.form)

    def commit(self, rows: DataFrame, batch: int) -> bool:
        """False if the batch was there already; ``rows`` is not evaluated then."""
        if batch < 0:
            raise ValueError("batches are numbered from 0 up")
        return not self.committed(batch) and self._put(rows, f"batch={batch}")

    def _read(self, base: int, after: list[int]) -> DataFrame:
        paths = [f"{self.path}/upto={base}"] * (base >= 0) + [f"{self.path}/batch={b}" for b in after]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.format(self.form).schema(self.schema).load(paths)

    def read(self) -> DataFrame:
        """All rows of the newest summary and the batches after it."""
        return self._read(*self._folders())

    def read_batch(self, batch: int) -> DataFrame:
        """The rows of one batch; none if no batch of this number stands in the log by itself."""
        return self._read(-1, [batch] if batch in self._folders()[1] else [])

    def fold(self, summary) -> None:
        """Puts ``summary(rows)`` in the place of all batches so far and removes those that an older summary covers."""
        base, after = self._folders()
        if not after:
            return
        self._put(summary(self._read(base, after)), f"upto={after[-1]}")
        # readers that listed before may still read what the new summary holds; what the one before it held is gone for all
        fs, p = self._fs()
        for s in fs.listStatus(p):
            kind, _, n = s.getPath().getName().partition("=")
            if n.isdigit() and ((kind == "upto" and int(n) < base) or (kind == "batch" and int(n) <= base)):
                fs.delete(s.getPath(), True)


def json_records(spark: SparkSession, path: str | list[str], schema: str | StructType) -> tuple[DataFrame, DataFrame]:
    """(records, (record, error)) of files of JSON lines: blank lines are passed over; a line that is no JSON object, or whose
    fields do not fit ``schema``, is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("record"))
    wanted = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    broken = "_broken"
    parsed = lines.withColumn("p", F.from_json("record", StructType([*wanted.fields]).add(broken, "string"), {"columnNameOfCorruptRecord": broken}))
    ok = F.col(f"p.{broken}").isNull() & F.col("p").isNotNull() & F.ltrim("record").startswith("{")
    return parsed.filter(ok).select([F.col(f"p.`{f.name}`") for f in wanted]), parsed.filter(~ok).select("record", F.lit("not a record of this kind").alias("error"))
