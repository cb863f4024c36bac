"""Marked regions of texts: what stands from a marker line to the next end marker, exchanged for a table or held against it.

A text that has no such region is left as it is and told so. The tables are small (the catalogue, settings): one text each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BEGIN, END = "BEGIN GENERATED TABLE", "END GENERATED TABLE"
#: Columns of a rendered catalogue entry.
ENTRY = "code_point long, name string, severity string, description string"


def begin_line(family: str) -> str:
    return f"{BEGIN} ({family})"


def rendered(table: DataFrame, family: str) -> DataFrame:
    """(region): one row, the marker lines and between them a JSON line for each entry of ``ENTRY`` by code point."""
    fields = [c.split(" ")[0] for c in ENTRY.split(", ")]
    rows = table.select(F.struct("code_point", F.to_json(F.struct(*fields)).alias("line")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    lines = F.concat(F.array(F.lit(begin_line(family))), F.transform("rs", lambda r: r["line"]), F.array(F.lit(END)))
    return rows.select(F.array_join(lines, "\n").alias("region"))


def bounds(text: Column, family: str) -> tuple[Column, Column]:
    """(place of the marker from 1, place after the end marker); null where there is none."""
    at = F.nullif(F.locate(begin_line(family), text), F.lit(0))
    end = F.nullif(F.locate(END, F.substr(text, at)), F.lit(0))
    return at, at + end - 1 + len(END)


def region(text: Column, family: str) -> Column:
    """The region with its markers, or null."""
    at, after = bounds(text, family)
    return F.substr(text, at, after - at)


def problem(text: Column, family: str) -> Column:
    """What keeps a region from being found, or null."""
    at, after = bounds(text, family)
    return F.when(text.isNull(), "no text").when(at.isNull(), f'missing marker "{begin_line(family)}"').when(after.isNull(), f'missing "{END}" after {begin_line(family)}')


def spliced(text: Column, family: str, new: Column) -> Column:
    """The text with ``new`` in the region's place; as it was where there is no region."""
    at, after = bounds(text, family)
    return F.coalesce(F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, after)), text)


def synchronised(docs: DataFrame, table: DataFrame, family: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` brought up to date, ``drifted`` (was it behind) and ``problem``."""
    t = F.col(text)
    new = docs.crossJoin(F.broadcast(rendered(table, family).withColumnRenamed("region", "_new")))  # one row
    out = new.withColumns({"drifted": F.coalesce(region(t, family) != F.col("_new"), F.lit(False)), "problem": problem(t, family), "_text": spliced(t, family, F.col("_new"))})
    return out.drop(text, "_new").withColumnRenamed("_text", text)


def entries(docs: DataFrame, family: str, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` and one row per entry that a rendered region holds."""
    lines = F.split(region(F.col(text), family), "\n")
    inner = docs.withColumn("_line", F.explode(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))))).drop(text)
    return inner.withColumn("_e", F.from_json("_line", ENTRY)).select(*[c for c in inner.columns if c != "_line"], "_e.*")
