"""Streams of PDF files of any size, read in blocks.

Every block of a file is a task's read: it finds the stream marks that begin in it, with an overlap of a mark's length. The marks of
a file, a few bytes for each stream, are then paired in order (where a stream ends, and so whether a mark opens one, hangs on what
came before), and each stream is read by its range, wherever blocks end. Rows are those of ``containers.pdf_streams``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.sources.containers import MAX_STREAM_BYTES, MEMBERS, inflated
from lexigrain.sources.log import shared_folder
from lexigrain.sources.walk import opened

BLOCK_BYTES = 32 << 20
MARK, CLOSING = b"stream", b"end"
#: Bytes before a stream in which its dictionary is looked for.
HEAD = 2000


def marks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, at, closes, error): every ``stream`` in the files (path, size), and whether ``end`` stands before it. A file that is none of PDF is an error row."""
    blocks = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.greatest("size", F.lit(1)) - 1) / block_bytes))).alias("block"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, block in zip(f["path"], f["block"], strict=True):
                try:
                    rows = [(path, at, closes, None) for at, closes in found(path, block * block_bytes, block_bytes)]
                except (OSError, ValueError) as e:
                    rows = [(path, None, None, str(e))] if block == 0 else []
                yield pd.DataFrame(rows, columns=["path", "at", "closes", "error"]).astype({"at": "Int64", "closes": "boolean"})

    return blocks.repartition("path", "block").mapInPandas(run, "path string, at long, closes boolean, error string")


def found(path: str, start: int, n: int) -> list[tuple[int, bool]]:
    system, at = opened(path)
    with system.open_input_file(at) as f:
        if f.read(5) != b"%PDF-":
            if start == 0:
                raise ValueError("not a PDF file")
            return []
        before = min(start, len(CLOSING))
        f.seek(start - before)
        data = f.read(before + n + len(MARK) - 1)
    return [(start - before + m.start(), data[max(0, m.start() - 3) : m.start()] == CLOSING) for m in re.finditer(MARK, data) if m.start() >= before]


def paired(at: list[int], closes: list[bool]) -> list[tuple[int, int]]:
    """(opening mark, ``endstream``) of each stream; any mark outside a stream opens one, and one that nothing closes is none."""
    out, begun = [], None
    for p, c in zip(at, closes, strict=True):
        if begun is None:
            begun = p
        elif c and p - len(CLOSING) >= begun + len(MARK):
            out.append((begun, p - len(CLOSING)))
            begun = None
    return out


def ranges(found_marks: DataFrame) -> DataFrame:
    """(path, no, begins, ends) of the streams of each file."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("at")
        pairs = paired(f["at"].tolist(), f["closes"].tolist())
        return pd.DataFrame([(f["path"].iloc[0], k, a, b) for k, (a, b) in enumerate(pairs)], columns=["path", "no", "begins", "ends"])

    return found_marks.filter("error is null").groupBy("path").applyInPandas(run, "path string, no long, begins long, ends long")


def stream(path: str, begins: int, ends: int) -> bytes | None:
    """The data of one stream, inflated if that is its filter; null if it has no dictionary or does not inflate."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        start = max(0, begins - HEAD)
        f.seek(start)
        dictionary = f.read(begins - start)
        if b">>" not in dictionary:
            return None
        f.seek(begins + len(MARK))
        data = f.read(ends - begins - len(MARK))
    for line in (b"\r\n", b"\n", b"\r"):
        if data.startswith(line):
            data = data[len(line) :]
            break
    for line in (b"\r\n", b"\n"):
        if data.endswith(line):
            data = data[: -len(line)]
            break
    return inflated(data) if b"/FlateDecode" in dictionary and 0 < len(data) <= MAX_STREAM_BYTES else data


def pdf_members(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``MEMBERS`` rows of PDF files (path, size). Memory: a block, or a stream."""
    spark, folder = files.sparkSession, shared_folder(files.sparkSession, "pdf")
    marks(files, block_bytes).write.parquet(f"{folder}/marks")
    all_marks = spark.read.parquet(f"{folder}/marks")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, no, begins, ends in zip(*(f[c] for c in ("path", "no", "begins", "ends")), strict=True):
                data = stream(path, begins, ends)
                if data is not None:
                    yield pd.DataFrame([(path, no, data)], columns=["path", "no", "data"])

    ranges(all_marks).repartition("path", "no").mapInPandas(run, "path string, no long, data binary").write.parquet(f"{folder}/streams")
    kept = spark.read.parquet(f"{folder}/streams")
    # streams are numbered among those that are kept; the numbers are small rows
    numbers = kept.select("path", "no", (F.row_number().over(Window.partitionBy("path").orderBy("no")) - 1).alias("k"))
    good = kept.join(numbers, ["path", "no"]).select("path", F.concat(F.lit("stream#"), F.col("k").cast("string")).alias("member"), "data", F.lit(None).cast("string").alias("error"))
    bad = all_marks.filter("error is not null").select("path", F.lit(None).cast("string").alias("member"), F.lit(None).cast("binary").alias("data"), "error")
    assert good.columns == [c.split(" ")[0] for c in MEMBERS.split(", ")]
    return good.unionByName(bad)
