"""Members of ZIP packages and streams of PDF files, as rows."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexigrain.sources.walk import opened

# Limits against archive bombs.
MAX_ENTRIES, MAX_ENTRY_BYTES, MAX_STREAM_BYTES = 10_000, 128 << 20, 64 << 20
MEMBERS = "path string, member string, data binary, error string"


def zip_members(content: bytes, pattern: str) -> list[tuple[str | None, bytes | None, str | None]]:
    """(name, data, None) of the members whose name fits, read one by one; (None, None, error) if the package is bad."""
    out: list[tuple[str | None, bytes | None, str | None]] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            infos = z.infolist()
            if len(infos) > MAX_ENTRIES:
                raise ValueError(f"more than {MAX_ENTRIES} entries")
            for i in infos:
                if not re.search(pattern, i.filename):
                    continue
                if i.file_size > MAX_ENTRY_BYTES:
                    raise ValueError(f"{i.filename}: more than {MAX_ENTRY_BYTES} bytes")
                if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise ValueError(f"{i.filename}: compression method {i.compress_type}")
                with z.open(i) as f:
                    data = f.read(MAX_ENTRY_BYTES + 1)
                if len(data) > MAX_ENTRY_BYTES:
                    raise ValueError(f"{i.filename}: more than {MAX_ENTRY_BYTES} bytes")
                out.append((i.filename, data, None))
    except (zipfile.BadZipFile, ValueError, OSError, zlib.error, EOFError) as e:
        return [(None, None, str(e))]
    return out


# Packages by ranged reads: the directory at a file's end, then the bytes of wanted members only.

ENTRIES = "path string, member string, size long, packed long, method int, at long, error string"
#: Bytes of packed members that are one task's work.
GROUP_BYTES = 64 << 20


def _entries(path: str) -> list[tuple]:
    try:
        system, at = opened(path)
        with system.open_input_file(at) as f, zipfile.ZipFile(f) as z:
            infos = z.infolist()
        if len(infos) > MAX_ENTRIES:
            raise ValueError(f"more than {MAX_ENTRIES} entries")
    except (zipfile.BadZipFile, ValueError, OSError, EOFError) as e:
        return [(path, None, None, None, None, None, str(e))]
    return [(path, i.filename, i.file_size, i.compress_size, i.compress_type, i.header_offset, None) for i in infos]


def zip_directory(files: DataFrame) -> DataFrame:
    """``ENTRIES`` of the packages named in ``path``: their directories are read, and nothing else. A bad package is one error row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                yield pd.DataFrame(_entries(path), columns=["path", "member", "size", "packed", "method", "at", "error"]).astype({c: "Int64" for c in ("size", "packed", "method", "at")})

    return files.select("path").mapInPandas(run, ENTRIES)


def _member(f, at: int, packed: int, size: int, method: int) -> bytes:
    """One member, by its place in an open file."""
    if size > MAX_ENTRY_BYTES:
        raise ValueError(f"more than {MAX_ENTRY_BYTES} bytes")
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"compression method {method}")
    f.seek(at)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\3\4":
        raise ValueError("bad local header")
    f.seek(at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    data = f.read(packed)
    if len(data) < packed:
        raise ValueError("truncated data")
    if method == zipfile.ZIP_DEFLATED:
        d = zlib.decompressobj(-15)
        data = d.decompress(data, size + 1)
        if not d.eof and not (len(data) == size and not d.decompress(d.unconsumed_tail, 1) and d.eof):
            raise ValueError("data does not end where the directory says")
    if len(data) != size:
        raise ValueError("data is not as long as the directory says")
    return data


def zip_contents(entries: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``MEMBERS`` of these rows of ``zip_directory`` (filter them first). Members close to one another are a task's work; a large
    package is read by many tasks. Memory: one member."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, f = None, None
        for rows in frames:
            for path, member, size, packed, method, at in zip(*(rows[c] for c in ("path", "member", "size", "packed", "method", "at")), strict=True):
                try:
                    if path != name:
                        system, place = opened(path)
                        name, f = path, system.open_input_file(place)
                    out = (path, member, _member(f, int(at), int(packed), int(size), int(method)), None)
                except (ValueError, OSError, zlib.error) as e:
                    out = (path, member, None, f"{member}: {e}")
                yield pd.DataFrame([out], columns=["path", "member", "data", "error"])

    good = entries.filter("error is null").withColumn("_group", F.floor(F.col("at") / group_bytes))
    placed = good.repartition("path", "_group").sortWithinPartitions("path", "at").drop("_group", "error")
    bad = entries.filter("error is not null").select("path", F.lit(None).cast("string").alias("member"), F.lit(None).cast("binary").alias("data"), "error")
    return placed.mapInPandas(run, MEMBERS).unionByName(bad)


class ZipMembers(DataSource):
    """``spark.read.format("zip_members").option("member", pattern).load(path)``: (path, member, size, data) of one package.

    The directory is read once to make a partition of each group of wanted members; ``member`` is a regular expression that
    names are searched for, ``groupBytes`` the packed bytes of a partition. A bad package or member raises. For many packages
    take ``zip_directory`` and ``zip_contents``, which read the directories in tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "path string, member string, size long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return ZipReader(self.options)


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern, self.group_bytes = options["path"], options.get("member", ""), int(options.get("groupBytes", GROUP_BYTES))

    def partitions(self) -> list[InputPartition]:
        found = _entries(self.path)
        if found and found[0][-1]:
            raise ValueError(f"{self.path}: {found[0][-1]}")
        groups: dict[int, list[tuple]] = {}
        for e in found:
            if re.search(self.pattern, e[1]):
                groups.setdefault(e[5] // self.group_bytes, []).append(e)
        return [InputPartition(g) for g in groups.values()] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value:
            system, at = opened(self.path)
            with system.open_input_file(at) as f:
                for path, member, size, packed, method, place, _ in partition.value:
                    yield path, member, size, _member(f, place, packed, size, method)


#: What stands before a stream (up to 2000 bytes), its line end, its data, the line end before its close.
STREAM = re.compile(rb"stream(?:\r\n|\n|\r)?(?P<data>.*?)(?:\r?\n)?endstream", re.DOTALL)


def inflated(data: bytes, most: int = MAX_ENTRY_BYTES) -> bytes | None:
    """The inflated data, or null if it is broken or larger than ``most``."""
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, most + 1)
    except zlib.error:
        return None
    return out if d.eof and len(out) <= most else None


def pdf_streams(content: bytes) -> list[tuple[str | None, bytes | None, str | None]]:
    """Streams with a dictionary before them, inflated where that is their filter; what does not inflate is left out."""
    if content[:5] != b"%PDF-":
        return [(None, None, "not a PDF file")]
    kept = []
    for m in STREAM.finditer(content):
        dictionary = content[max(0, m.start() - 2000) : m.start()]
        packed = b"/FlateDecode" in dictionary and 0 < len(m["data"]) <= MAX_STREAM_BYTES
        data = inflated(m["data"]) if packed else m["data"]
        if b">>" in dictionary and data is not None:
            kept.append(data)
    return [(f"stream#{k}", data, None) for k, data in enumerate(kept)]


def unpacked(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``MEMBERS`` of container files; ``patterns`` maps extensions to member names.

    ``.pdf`` takes no pattern. Memory: one file and its largest wanted members.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, ext, content in zip(f["path"], f["extension"], f["content"], strict=True):
                got = pdf_streams(content) if ext == ".pdf" else zip_members(content, patterns[ext])
                yield pd.DataFrame([(path, m, d, e) for m, d, e in got], columns=["path", "member", "data", "error"])

    return files.filter(F.col("extension").isin(*patterns, ".pdf")).select("path", "extension", "content").mapInPandas(run, MEMBERS)


def members(files: DataFrame, patterns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """((path, member, data), (path, error)) of ``unpacked``."""
    rows = unpacked(files, patterns)
    return rows.filter("error is null").drop("error"), rows.filter("error is not null").select("path", "error")
