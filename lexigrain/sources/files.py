"""Reading trees of text and container files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions read as text by default, containers, and folders left out.
TEXT_EXTENSIONS = (
    ".a2ml .adoc .affine .c .cc .cpp .css .csv .deed .ex .exs .gleam .h .hpp .hs .html .idr .ipynb .java .jl .js .json "
    ".jsx .k9 .md .ml .ncl .res .rs .sh .svg .tex .toml .ts .tsx .txt .v .xml .yaml .yml .zig"
).split()
CONTAINERS = [".docx", ".pptx", ".xlsx", ".pdf"]
IGNORED = [".git", ".lake", "_build", "deps", "external_corpora", "node_modules", "target"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)\z", 1))


def wanted(path: Column, extensions: list[str] | None = None, all_files: bool = False, ignored: list[str] | None = None) -> Column:
    ext = extension(path)
    kind = F.lit(True) if all_files else ext.isin(*(extensions or TEXT_EXTENSIONS), *CONTAINERS)
    return kind & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, [*IGNORED, *(ignored or [])])))


def read_files(spark: SparkSession, roots: list[str], extensions: list[str] | None = None, all_files: bool = False, ignored: list[str] | None = None) -> DataFrame:
    """(path, extension, content) of the files under ``roots`` that the rules select. A missing root raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    return files.filter(wanted(F.col("path"), extensions, all_files, ignored)).select("path", extension(F.col("path")).alias("extension"), "content")


def decoded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, errors): malformed UTF-8 is an error of the file, never a finding. A byte order mark stays in the text."""
    text = files.filter(~F.col("extension").isin(*CONTAINERS))
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return text.filter(good).withColumn("text", F.decode("content", "UTF-8")).drop("content"), text.filter(~good).select("path", F.lit("malformed UTF-8").alias("error"))
