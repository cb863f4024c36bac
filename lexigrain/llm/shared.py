"""Work that must outlive executors goes to the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only where none is set and everything runs on one machine."""
    sc = spark.sparkContext
    found = spark.conf.get(SETTING, None) or sc.getConf().get(SETTING) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lexigrain-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Of each application, the folders that ``written`` made inside ``collected`` and that nothing is to keep.
_left: dict[str, list[str]] = {}
#: Spark's setting by which a query's shuffles are removed when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_collecting: set[str] = set()


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here leave no shuffles behind."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def collected(spark: SparkSession) -> Iterator[None]:
    """Notes what ``written`` makes in here, for ``clear``; queries leave no shuffles behind."""
    app = spark.sparkContext.applicationId
    outer = app in _collecting
    _collecting.add(app)
    try:
        with no_shuffles_left(spark):
            yield
    finally:
        if not outer:
            _collecting.discard(app)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here. ``clear`` spares it with ``keep``."""
    path, app = new_folder(df.sparkSession, name), df.sparkSession.sparkContext.applicationId
    df.write.option("compression", "zstd").parquet(path)
    if app in _collecting and not keep:
        _left.setdefault(app, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def noted(df: DataFrame) -> None:
    """``clear`` takes away what ``df`` reads, if this runs inside ``collected``."""
    app = df.sparkSession.sparkContext.applicationId
    if app in _collecting:
        _left.setdefault(app, []).extend(sorted({f.rpartition("/")[0] for f in df.inputFiles()}))


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What ``written`` makes in here without ``keep`` is taken away at the end; queries leave no shuffles behind. What needs it must be written by then."""
    app = spark.sparkContext.applicationId
    before = _left.pop(app, [])
    try:
        with collected(spark):
            yield
    finally:
        clear(spark)
        if before:
            _left[app] = before


def clear(spark: SparkSession, needed: DataFrame | None = None) -> None:
    """Takes away what ``collected`` has noted, but for the folders that ``needed`` reads. Other results that read them must be written by then."""
    app = spark.sparkContext.applicationId
    noted = _left.pop(app, [])
    read = {f.rpartition("/")[0].rpartition("/")[2] for f in needed.inputFiles()} if noted and needed is not None else set()
    for path in noted:
        if path.rpartition("/")[2] in read:
            _left.setdefault(app, []).append(path)
            continue
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
