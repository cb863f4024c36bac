"""Files of any kind to findings: texts, markup with its idioms, packages and PDF, each file with its error or none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.operators import office, scan, styles
from lexigrain.sources.files import CONTAINERS, decoded

PLACED = ["path", "member", "name", "code_point", "severity", "safety", "fix", "scalar_index", "byte_offset", "line", "column", "detail"]


def scan_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, files) of (path, extension, content): ``PLACED``, and (path, n_findings, error) for every file."""
    texts, bad = decoded(files)
    none = lambda df: df.withColumns({"member": F.lit(None).cast("string"), "detail": F.lit(None).cast("string")}).select(*PLACED)
    inside, broken = office.find_in_containers(files.filter(F.col("extension").isin(*CONTAINERS)))
    found = none(scan.find_all(texts)).unionByName(none(styles.find_hidden_styles(texts, F.col("extension")))).unionByName(inside.select(*PLACED))
    counts = found.groupBy("path").agg(F.count("*").alias("n_findings"))
    errors = bad.unionByName(broken).groupBy("path").agg(F.min("error").alias("error"))
    return found, files.select("path").join(counts, "path", "left").join(errors, "path", "left").select("path", F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"), "error")
