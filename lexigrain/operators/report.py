"""Reports over findings: lines, listings, annotations, records and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.text import escape_markdown, escape_workflow, hex4, page_metrics

RANKS = {"info": 1, "warning": 2, "error": 3, "critical": 4}
FINDING = ["name", "code_point", "utf8_hex", "line", "column", "byte_offset", "scalar_index", "severity", "safety", "fix", "fix_with", "description"]


def rank(severity: Column) -> Column:
    """0 for an unknown severity."""
    out = F.lit(0)
    for name, n in RANKS.items():
        out = F.when(severity == name, n).otherwise(out)
    return out


def at_or_above(findings: DataFrame, severity: str) -> DataFrame:
    return findings.filter(F.col("severity_rank") >= RANKS[severity])


def _or(c: Column, other: str = "-") -> Column:
    return F.coalesce(c.cast("string"), F.lit(other))


def _point(other: Column) -> Column:
    return F.when(F.col("code_point").isNull(), other).otherwise(F.concat(F.lit("U+"), hex4(F.col("code_point"))))


def finding_line(path: Column) -> Column:
    where = F.when(F.col("line").isNull(), "-").otherwise(F.concat_ws(":", "line", "column"))
    return F.concat(path, F.lit(":"), where, F.lit(": "), F.upper("severity"), F.lit(" "), "name", F.lit(" "), _point(F.lit("-")), F.lit(" ["), _or(F.col("utf8_hex")), F.lit("] ("), "safety", F.lit(")"))


def finding_detail(context: Column | None = None) -> Column:
    rows = [F.concat(F.lit("    "), "unicode_name", F.lit(" · category "), "category"), F.concat(F.lit("    "), "description")]
    return F.concat_ws("\n", *rows, *([F.concat(F.lit("    context: "), context)] if context is not None else []))


def hex_line(path: Column) -> Column:
    cp = F.when(F.col("code_point").isNull(), "----").otherwise(hex4(F.col("code_point")))
    return F.concat(F.lit("0x"), cp, F.lit(" ["), "name", F.lit("] "), path, F.lit(" L:"), _or(F.col("line")), F.lit(" C:"), _or(F.col("column")), F.lit(" B:"), _or(F.col("byte_offset")))


def annotation(path: Column, blocking: Column) -> Column:
    """A workflow command of a build service."""
    message = F.concat("name", F.lit(" "), _point(F.col("name")), F.lit(" ("), "severity", F.lit(")"))
    return F.concat(F.lit("::"), F.when(blocking, "error").otherwise("warning"), F.lit(" file="), path, F.lit(",line="), _or(F.col("line"), "1"), F.lit(",col="), _or(F.col("column"), "1"), F.lit("::"), escape_workflow(message))


def plain_annotation(path: Column, blocking: Column) -> Column:
    level = F.when(blocking, "error").otherwise("warning")
    return F.concat(path, F.lit(":"), _or(F.col("line"), "1"), F.lit(":"), _or(F.col("column"), "1"), F.lit(": "), level, F.lit(": "), "name", F.lit(" "), _point(F.lit("-")), F.lit(" ("), "severity", F.lit(")"))


def _ordered(rows: list[str]) -> Column:
    return F.array_sort(F.collect_list(F.struct("byte_offset", "code_point", *[c for c in rows if c not in ("byte_offset", "code_point")])))


def text_report(findings: DataFrame, key: str) -> DataFrame:
    """(key, report): the lines of a document in order."""
    lines = findings.withColumn("s", finding_line(F.col(key).cast("string")))
    return lines.groupBy(key).agg(_ordered(["name", "s"]).alias("r")).select(key, F.array_join(F.transform("r", lambda x: x["s"]), "\n").alias("report"))


def records(docs: DataFrame, findings: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One record per document, clean ones included: findings array, scanned_scalars, finding_count."""
    per = findings.groupBy(key).agg(_ordered(FINDING).alias("findings"))
    kind = dict(per.dtypes)["findings"]
    return docs.select(key, F.length(text).cast("long").alias("scanned_scalars")).join(per, key, "left").withColumns({
        "findings": F.coalesce("findings", F.array().cast(kind)),
        "finding_count": F.coalesce(F.size("findings"), F.lit(0)).cast("long"),
    })


def summary(docs: DataFrame, findings: DataFrame, key: str, threshold: str, errors: DataFrame | None = None) -> DataFrame:
    """One row: documents, findings, blocking findings and status (0 clean, 1 blocking, 2 if anything could not be read)."""
    n = docs.agg(F.count("*").alias("n_documents"))
    f = findings.agg(F.count("*").alias("n_findings"), F.count_if(F.col("severity_rank") >= RANKS[threshold]).alias("n_blocking"), F.countDistinct(key).alias("n_with_findings"))
    bad = errors.agg(F.count("*").alias("n_errors")) if errors is not None else n.select(F.lit(0).cast("long").alias("n_errors"))
    # three one-row frames
    return n.crossJoin(f).crossJoin(bad).withColumn("status", F.when(F.col("n_errors") > 0, 2).when(F.col("n_blocking") > 0, 1).otherwise(0).cast("long"))


def summary_line(summaries: DataFrame, threshold: Column) -> DataFrame:
    """``summaries`` (as ``summary`` gives them) with ``line``, the closing line of an audit in a build, of a fixed form: how many
    files could not be scanned, or what was found."""
    n = lambda c: F.col(c).cast("string")
    failed = F.concat(n("n_errors"), F.lit(" file(s) could not be scanned (scanner errors fail distinctly from findings)"))
    found = F.concat(F.lit("scanned "), n("n_documents"), F.lit(" file(s); "), n("n_findings"), F.lit(" finding(s), "), n("n_blocking"), F.lit(" blocking at threshold "), threshold)
    return summaries.withColumn("line", F.when(F.col("n_errors") > 0, failed).otherwise(found))


def status_bar(docs: DataFrame, findings: DataFrame, key: str, text: str = "text", with_metrics: bool = False) -> DataFrame:
    """(key, n, status, tooltip): what an editor shows for each document."""
    counted = docs.join(findings.groupBy(key).agg(F.count("*").alias("n")), key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    n, some = F.col("n").cast("string"), F.col("n") > 0
    shown = F.when(some, F.concat(F.lit("$(warning) "), n, F.lit(" invisible"))).otherwise("$(check) Clean")
    if with_metrics:
        m = page_metrics(F.coalesce(F.col(text), F.lit("")))
        shown = F.concat(shown, F.lit(" | "), m["chars"].cast("string"), F.lit(" chars, "), m["words"].cast("string"), F.lit(" words"))
    tooltip = F.when(some, F.concat(n, F.when(F.col("n") > 1, " invisible characters detected. Click to scan.").otherwise(" invisible character detected. Click to scan."))).otherwise("No invisible characters detected")
    return counted.select(key, "n", shown.alias("status"), tooltip.alias("tooltip"))


def by_name(findings: DataFrame) -> DataFrame:
    return findings.groupBy("name", "severity").agg(F.count("*").alias("n"))


def by_severity(findings: DataFrame) -> DataFrame:
    """Counts per severity and their total (severity null)."""
    return findings.rollup("severity").agg(F.count("*").alias("n"))


def by_document(findings: DataFrame, key: str) -> DataFrame:
    """Counts per document and their total (key null)."""
    return findings.rollup(key).agg(F.count("*").alias("n"))


def page(findings: DataFrame, key: str, floor: str = "info", contains: str = "", offset: int = 0, rows: int = 20) -> DataFrame:
    """One screen of findings: severity floor, case-blind name filter, ordered by document and place."""
    shown = findings.filter((F.col("severity_rank") >= RANKS[floor]) & F.contains(F.lower("name"), F.lit(contains.lower())))
    return shown.orderBy(key, F.coalesce("byte_offset", F.lit(0)), "code_point", "name").offset(offset).limit(rows)


def markdown(records_: DataFrame, key: str) -> DataFrame:
    """(key, markdown): a heading and a table per record; text from findings is escaped."""
    cell = lambda x: F.concat(F.lit("| "), x["severity"], F.lit(" | "), escape_markdown(x["name"]), F.lit(" | "), F.when(x["line"].isNull(), "—").otherwise(F.concat_ws(":", x["line"], x["column"])), F.lit(" | "), escape_markdown(x["safety"]), F.lit(" | "), escape_markdown(x["description"]), F.lit(" |"))
    head = F.concat(F.lit("## "), escape_markdown(F.col(key).cast("string")), F.lit("\n\n"), F.col("finding_count").cast("string"), F.lit(" finding(s)\n"))
    rows = F.array_join(F.transform("findings", cell), "\n")
    table = F.when(F.col("finding_count") > 0, F.concat(F.lit("\n| Severity | Name | Position | Safety | Description |\n|---|---|---|---|---|\n"), rows, F.lit("\n"))).otherwise("")
    return records_.select(key, F.concat(head, table).alias("markdown"))
