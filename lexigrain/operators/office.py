"""Hidden content in office packages and PDF files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.catalogue import catalogue
from lexigrain.operators.scan import any_of, find_characters, matches, positions
from lexigrain.sources.containers import MEMBERS, unpacked, zip_contents, zip_directory
from lexigrain.sources.log import shared_folder

#: Member names that hold text, by extension.
TEXT_MEMBERS = {
    ".docx": r"^word/(?:document|header\d+|footer\d+|footnotes|endnotes|comments)\.xml$",
    ".pptx": r"^ppt/slides/slide\d+\.xml$",
    ".xlsx": r"^xl/(?:sharedStrings|workbook|worksheets/sheet\d+)\.xml$|^xl/_rels/workbook\.xml\.rels$",
}
NODES = {".docx": "w:t|w:instrText", ".pptx": "a:t", ".xlsx": "t"}
FINDING = ["path", "member", "code_point", "utf8_hex", "name", "category", "severity", "safety", "fix", "scalar_index", "byte_offset", "line", "column", "detail"]


def _shaped(rows: DataFrame, name: Column | str, severity: Column | str, detail: Column | None = None, category: str = "ooxml") -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.withColumns({
        "name": lit(name), "severity": lit(severity), "category": F.lit(category), "safety": F.lit("ambiguous"), "fix": F.lit("review"),
        "code_point": F.lit(None).cast("long"), "utf8_hex": F.lit(None).cast("string"), "detail": detail if detail is not None else F.lit(None).cast("string"),
    }).select(*FINDING)


def text_nodes(members: DataFrame, nodes: str) -> DataFrame:
    """(path, member, text, inner, inner_start) per text node; ``inner_start`` is where its contents begin in the member."""
    pattern = rf"(?s)<(?:{nodes})(?:\s[^>]*)?>.*?</(?:{nodes})>"
    rows = matches(members, pattern).drop("hit_no")
    opening = F.length(F.regexp_extract("hit", r"(?s)^<[^>]*>", 0))
    inner = F.regexp_extract("hit", r"(?s)^<[^>]*>(.*)</[^>]*>\z", 1)
    return rows.select("path", "member", "text", inner.alias("inner"), (F.col("scalar_index") + opening).alias("inner_start"))


def entity_code(e: Column) -> Column:
    """The code point of ``#160`` or ``#xA0`` without the mark; a decimal one ends at its first other character."""
    value = F.when(F.startswith(e, F.lit("x")), F.conv(F.substr(e, F.lit(2)), 16, 10)).otherwise(F.nullif(F.regexp_extract(e, "^[0-9]+", 0), F.lit("")))
    return value.try_cast("long")


def find_entities(df: DataFrame, text: str = "text") -> DataFrame:
    """Numeric character references to catalogued characters, at the reference; the columns of ``df`` stay."""
    rows = matches(df, "&#(?:x?[0-9a-fA-F]+);", text).drop("hit_no")
    rows = rows.withColumn("code_point", entity_code(F.regexp_extract("hit", "&#(x?[0-9a-fA-F]+);", 1)))
    found = rows.join(F.broadcast(catalogue(df.sparkSession)), "code_point")
    return found.withColumns({"name": F.concat("name", F.lit("_ENTITY")), "fix": F.lit("review"), "utf8_hex": F.lit(None).cast("string")})


def find_in_nodes(members: DataFrame, nodes: str) -> DataFrame:
    """Characters and references inside text nodes, placed in the member."""
    t = text_nodes(members, nodes)

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumns(positions(F.col("text"), F.col("inner_start") + F.col("scalar_index"))).withColumn("detail", F.lit(None).cast("string")).select(*FINDING)

    return placed(find_characters(t, "inner")).unionByName(placed(find_entities(t, "inner")))


def find_in_word(members: DataFrame) -> DataFrame:
    blocks = matches(members, r"(?s)<w:rPr>.*?</w:rPr>")
    size = F.regexp_extract("hit", r'<w:sz\s+w:val="(\d+)"\s*/>', 1).try_cast("long")
    return (
        _shaped(blocks.filter(F.col("hit").rlike(r"<w:vanish\s*/>")), "OOXML_HIDDEN_RUN", "warning")
        .unionByName(_shaped(blocks.filter(F.col("hit").rlike(r"<w:webHidden\s*/>")), "OOXML_WEB_HIDDEN_RUN", "info"))
        .unionByName(_shaped(blocks.filter(size <= 2), "OOXML_SUSPICIOUS_FONT_SIZE", "warning", F.concat(size.cast("string"), F.lit(" half-points"))))
    )


def find_in_slides(members: DataFrame) -> DataFrame:
    return _shaped(matches(members, r'<p:(?:sp|pic|graphicFrame|grpSp|cxnSp)\b[^>]*\bhidden="1"'), "OOXML_HIDDEN_SHAPE", "info")


def sheet_names(members: DataFrame) -> DataFrame:
    """(path, member, display): sheets by way of the workbook's relationships."""
    tags = lambda member, tag: members.filter(F.col("member") == member).select("path", F.explode(F.regexp_extract_all("text", F.lit(rf"<{tag}\b[^>]*>"), F.lit(0))).alias("tag"))
    attr = lambda a: F.regexp_extract("tag", rf'\s{a}="([^"]*)"', 1)
    sheets = tags("xl/workbook.xml", "sheet").select("path", attr("r:id").alias("rid"), attr("name").alias("display"))
    rels = tags("xl/_rels/workbook.xml.rels", "Relationship").select("path", attr("Id").alias("rid"), F.concat(F.lit("xl/"), F.regexp_replace(attr("Target"), "^(?:/?xl/|/)", "")).alias("member"))
    return rels.join(sheets, ["path", "rid"]).select("path", "member", "display")


def find_empty_formulas(members: DataFrame) -> DataFrame:
    """Cells with a formula and no cached value."""
    sheets = members.filter(F.col("member").rlike(r"^xl/worksheets/sheet\d+\.xml$"))
    cells = matches(sheets, r"(?s)<c\b[^>]*?(?:/>|>.*?</c>)")
    value = F.regexp_extract("hit", r"(?s)<v(?:\s[^>]*)?>(.*?)</v>", 1)
    has_v = F.col("hit").rlike(r"(?s)<v(?:\s[^>]*)?>.*?</v>")
    has_f = F.col("hit").rlike(r"(?s)<f(?:\s[^>]*)?>.*?</f>|<f(?:\s[^>]*)?/>")
    formula = F.trim(F.regexp_extract("hit", r"(?s)<f(?:\s[^>]*)?>(.*?)</f>", 1))
    short = F.when(F.length(formula) > 80, F.concat(F.left(formula, F.lit(80)), F.lit("…"))).otherwise(formula)
    ref = F.coalesce(F.nullif(F.regexp_extract("hit", r'^<c\b[^>]*?\br="([A-Z]+\d+)"', 1), F.lit("")), F.lit("?"))
    rows = cells.filter(has_f & (~has_v | (F.trim(value) == ""))).join(sheet_names(members), ["path", "member"], "left")
    where = F.concat(F.coalesce("display", "member"), F.lit("!"), ref, F.lit(": "), short, F.lit(", cached value "), F.when(has_v, "empty").otherwise("absent"))
    return _shaped(rows, "EMPTY_FORMULA_CELL", "warning", where)


PDF_OPERATORS = [
    ("PDF_INVISIBLE_TEXT", r"(?<=^|\s)3\s+Tr\b"),
    ("PDF_ZERO_FONT", r"/[\w.+#-]+\s+0(?:\.0+)?\s+Tf\b"),
    ("PDF_ZERO_WIDTH", r"(?<=^|\s)-?0(?:\.0+)?\s+Tz\b"),
]


def find_in_pdf(streams: DataFrame) -> DataFrame:
    """Text operators that paint nothing, in streams with text blocks."""
    content = streams.filter(F.col("text").rlike(r"\bBT\b") & F.col("text").rlike(r"\bET\b"))
    rows = any_of(content, [(pattern,) for _, pattern in PDF_OPERATORS])
    return _shaped(rows, F.get(F.lit([name for name, _ in PDF_OPERATORS]), F.col("rule")), "warning", category="pdf")


def find_in_containers(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) over office packages and PDF files (path, extension, content).

    The members are unpacked once, into the shared folder, for the passes that look at them."""
    rows = unpacked(files, TEXT_MEMBERS)
    folder = shared_folder(files.sparkSession, "members")
    rows.write.parquet(folder)
    rows = files.sparkSession.read.schema(MEMBERS).parquet(folder)
    return find_in_members(rows.filter("error is null").drop("error"), rows.filter("error is not null").select("path", "error"))


def find_in_packages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) over office packages named in ``path``: of each the directory and the wanted members are read."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1))
    wanted = F.lit(False)
    for e, pattern in TEXT_MEMBERS.items():
        wanted |= (ext == e) & F.col("member").rlike(pattern)
    rows = zip_contents(zip_directory(files.filter(ext.isin(*TEXT_MEMBERS))).filter(wanted | F.col("error").isNotNull()))
    folder = shared_folder(files.sparkSession, "members")
    rows.write.parquet(folder)
    rows = files.sparkSession.read.schema(MEMBERS).parquet(folder)
    return find_in_members(rows.filter("error is null").drop("error"), rows.filter("error is not null").select("path", "error"))


def find_in_members(rows: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) over (path, member, data) rows."""
    rows = rows.withColumn("extension", F.lower(F.regexp_extract("path", r"(\.[^./]+)\z", 1)))
    good = F.is_valid_utf8(F.col("data").cast("string"))
    pdf = F.col("extension") == ".pdf"  # streams that are no text are binary, not errors
    errors = errors.unionByName(rows.filter(~pdf & ~good).select("path", F.concat("member", F.lit(": malformed UTF-8")).alias("error")))
    texts = rows.filter(good).withColumn("text", F.regexp_replace(F.decode("data", "UTF-8"), r"^\x{FEFF}", "")).drop("data")
    of = lambda e: texts.filter(F.col("extension") == e).drop("extension")
    shared = of(".xlsx").filter(F.col("member") == "xl/sharedStrings.xml")
    parts = [
        find_in_nodes(of(".docx"), NODES[".docx"]), find_in_word(of(".docx")), find_in_nodes(of(".pptx"), NODES[".pptx"]), find_in_slides(of(".pptx")),
        find_in_nodes(shared, NODES[".xlsx"]), find_empty_formulas(of(".xlsx")), find_in_pdf(of(".pdf")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, errors
