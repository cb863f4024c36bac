"""Walking trees of files as jobs: one per level, a task for each share of its folders.

Ignored folders are left out before anything in them is listed, links are never followed, and what cannot be listed is an
error row. The files found are rows (path, size, modified); nothing is gathered in the driver but whether a level
has folders left. Paths are those of local or mounted file systems and of stores that pyarrow opens (``hdfs://``,
``s3://``, ``gs://``); for what only Spark's readers open use ``files.read_files``.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.sources.files import CONTAINERS, IGNORED, TEXT_EXTENSIONS, extension
from lexigrain.sources.log import shared_folder

ENTRY = "path string, kind string, size long, modified long, error string"
#: Entries of a folder that are one batch of rows.
AT_ONCE = 10_000


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def entries(path: str, ignored: frozenset[str]) -> Iterator[tuple]:
    """``ENTRY`` rows of a folder, or of a file given as a root; links and ignored folders give none."""
    from pyarrow import fs

    system, at = opened(path)
    if isinstance(system, fs.LocalFileSystem):
        try:
            if os.path.islink(at):
                return
            if os.path.isfile(at):
                s = os.stat(at)
                yield path, "file", s.st_size, s.st_mtime_ns // 1000, None
                return
            with os.scandir(at) as found:
                for e in found:
                    if e.is_symlink():
                        continue
                    child = f"{path.rstrip('/')}/{e.name}"
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in ignored:
                            yield child, "dir", None, None, None
                    elif e.is_file(follow_symlinks=False):
                        s = e.stat(follow_symlinks=False)
                        yield child, "file", s.st_size, s.st_mtime_ns // 1000, None
        except OSError as e:
            yield path, "error", None, None, f"could not enumerate input: {path}: {e.strerror}"
        return
    try:
        own = system.get_file_info(at)
        found = [own] if own.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    except OSError as e:
        yield path, "error", None, None, f"could not enumerate input: {path}: {e}"
        return
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    for i in found:
        if i.type == fs.FileType.Directory and i.base_name not in ignored:
            yield head + i.path, "dir", None, None, None
        elif i.type == fs.FileType.File:
            yield head + i.path, "file", i.size, (i.mtime_ns or 0) // 1000, None


def listing(folders: DataFrame, ignored: frozenset[str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for f in frames:
            for path in f["path"]:
                for row in entries(path, ignored):
                    held.append(row)
                    if len(held) >= AT_ONCE:
                        yield frame(held)
                        held = []
        yield frame(held)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["path", "kind", "size", "modified", "error"])
        return out.astype({"size": "Int64", "modified": "Int64"})

    return folders.select("path").mapInPandas(run, ENTRY)


def walk(spark: SparkSession, roots: list[str], extensions: list[str] | None = None, all_files: bool = False, ignored: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, size, modified), (path, error)) below ``roots``: each level is written before the next is listed."""
    left_out = frozenset([*IGNORED, *(ignored or [])])
    folder, level, n = shared_folder(spark, "walk"), spark.createDataFrame([(r.rstrip("/") or "/",) for r in roots], "path string").distinct(), 0
    while n == 0 or not level.isEmpty():
        listing(level.repartition("path"), left_out).write.parquet(f"{folder}/level={n}")
        level = spark.read.schema(ENTRY).parquet(f"{folder}/level={n}").filter("kind = 'dir'").select("path")
        n += 1
    found = spark.read.schema(ENTRY).parquet(*[f"{folder}/level={k}" for k in range(n)])
    kinds = [e.lower() for e in (TEXT_EXTENSIONS if extensions is None else extensions)] + CONTAINERS
    wanted = F.lit(True) if all_files else extension(F.col("path")).isin(*kinds)
    return found.filter("kind = 'file'").filter(wanted).select("path", "size", "modified"), found.filter("kind = 'error'").select("path", "error")


def path_order(path: Column | str) -> list[Column]:
    """Sort keys for paths as people read them: by the root collation (a before B, é beside e), then byte by byte."""
    c = F.col(path) if isinstance(path, str) else path
    return [F.collate(c, "UNICODE"), c]


def contents(files: DataFrame) -> DataFrame:
    """(path, content, error) of the files named in ``path``, read by the tasks, each file once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:  # a row at a time: the memory is that of one file
                try:
                    system, at = opened(path)
                    with system.open_input_stream(at) as s:
                        row = (path, s.read(), None)
                except OSError as e:
                    row = (path, None, f"read failed: {e}")
                yield pd.DataFrame([row], columns=["path", "content", "error"])

    return files.select("path").mapInPandas(run, "path string, content binary, error string")
