"""The minimum detector: ten characters and the C0 controls, columns in UTF-16 units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.operators.scan import matches

# Fixed values: (name, code point, severity, fix).
ARTIFACTS = [
    ("NULL", 0x0000, "critical", "remove"),
    ("NBSP", 0x00A0, "error", "replace:20"),
    ("ZWSP", 0x200B, "error", "remove"),
    ("BOM", 0xFEFF, "warning", "remove"),
    ("SHY", 0x00AD, "info", "remove"),
    ("LRM", 0x200E, "info", "remove"),
    ("RLM", 0x200F, "info", "remove"),
    ("WJ", 0x2060, "info", "remove"),
    ("ZWNJ", 0x200C, "warning", "keep"),
    ("ZWJ", 0x200D, "warning", "keep"),
]
PATTERN = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{A0}\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]"
REMOVED = "".join(chr(cp) for _, cp, _, fix in ARTIFACTS if fix == "remove")
RANK = "case severity when 'critical' then 4 when 'error' then 3 when 'warning' then 2 else 1 end"


def byte_hex(cp: Column) -> Column:
    h = F.lower(F.hex(cp))
    return F.lpad(h, (F.length(h) + F.pmod(F.length(h), F.lit(2))).cast("int"), F.lit("0"))


def definition(cp: Column) -> Column:
    """Struct of name, severity and fix; null if the code point is none of them."""
    entry = lambda name, severity, fix: F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), F.lit(fix).alias("fix"))
    out = F.when(cp.between(1, 8) | cp.isin(11, 12) | cp.between(14, 31), entry("C0_CONTROL", "critical", "review")).when(cp == 127, entry("DELETE", "critical", "review"))
    for name, code, severity, fix in ARTIFACTS:
        out = out.when(cp == code, entry(name, severity, fix))
    return out


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Findings with line, UTF-16 column, value, hexadecimal, name, severity and fix."""
    rows = matches(df, PATTERN, text).withColumn("byte_value", F.ascii("hit").cast("long"))
    line = F.substring_index(F.substr(F.col(text), F.lit(1), F.col("scalar_index").cast("int")), "\n", -1)
    wide = F.regexp_count(line, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    rows = rows.withColumn("column", F.col("column") + wide).withColumn("_d", definition(F.col("byte_value")))
    rows = rows.withColumns({"name": F.col("_d.name"), "severity": F.col("_d.severity"), "fix": F.col("_d.fix"), "hex_value": byte_hex(F.col("byte_value"))})
    return rows.drop("_d", "scalar_index", "byte_offset")


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    rank = {"critical": 4, "error": 3, "warning": 2, "info": 1}[severity]
    return findings.filter(f"{RANK} >= {rank}")


def fixed(text: Column) -> Column:
    """Removable characters gone, no-break spaces plain."""
    return F.translate(text, "\u00a0" + REMOVED, " ")


def fix_count(text: Column) -> Column:
    """Removals only."""
    return (F.length(text) - F.length(F.translate(text, REMOVED, ""))).cast("long")


def _lines(findings: DataFrame, key: list[str], line: Column) -> DataFrame:
    w = F.array_sort(F.collect_list(F.struct("line", "column", line.alias("s"))))
    return findings.groupBy(*key).agg(w.alias("rows"))


def hex_listing(findings: DataFrame, key: list[str]) -> DataFrame:
    """One text per document with findings."""
    line = F.concat(F.lit("0x"), F.upper("hex_value"), F.lit(" ["), "name", F.lit("] at L:"), "line", F.lit(" C:"), "column")
    return _lines(findings, key, line).select(*key, F.array_join(F.transform("rows", lambda r: r["s"]), "\n").alias("listing"))


def report(df: DataFrame, findings: DataFrame, key: list[str]) -> DataFrame:
    """One text per document, clean ones included."""
    line = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "name", F.lit(" (0x"), F.upper("hex_value"), F.lit(") at L:"), "line", F.lit(" C:"), "column", F.lit(" - "), "fix", F.lit("\n"))
    got = _lines(findings, key, line)
    head = F.concat(F.lit("Found "), F.size("rows").cast("string"), F.lit(" invisible artifact(s):\n"))
    text = F.concat(head, F.array_join(F.transform("rows", lambda r: r["s"]), ""))
    return df.select(*key).join(got, key, "left").select(*key, F.when(F.col("rows").isNull(), "No invisible artifacts detected.").otherwise(text).alias("report"))
