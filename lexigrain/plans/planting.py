"""Deterministic planting of hidden characters, in Spark and in SQL, for tables that have none."""

from __future__ import annotations

import io
import zipfile
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERTS = ["\u200b", "\u200d", "\ufeff", "\u202e", "\u3000", "\ufe0f", "\U000e0041", "\u00ad", "\u034f", "e\u0301\u0302\u0303", "e\u0301\u0302\u0303\u0304", "\u2028\u0001"]


def planted_text(text: Column, doc_id: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    t = F.when(doc_id % 3 == 0, F.concat(F.translate(F.substring(t, 1, 200), " ", "\u00a0"), F.substr(t, F.lit(201)))).otherwise(t)
    p = (1 + doc_id % 40).cast("int")
    c = F.element_at(F.array(*map(F.lit, INSERTS)), (doc_id % 12 + 1).cast("int"))
    t = F.concat(F.substr(t, F.lit(1), p), c, F.substr(t, p + 1))
    return F.when(doc_id % 5 == 0, F.concat(F.lit("\U0001f600"), t)).otherwise(t)


def planted(documents: DataFrame) -> DataFrame:
    return documents.filter("doc_id is not null").select("doc_id", planted_text(F.col("text"), F.col("doc_id")).alias("text"))


def deep(documents: DataFrame) -> DataFrame:
    """Hidden characters all through and at the very end: every blank of one document in seven, and a space and a stack of marks behind each text."""
    t = F.coalesce("text", F.lit(""))
    dense = F.when(F.col("doc_id") % 7 == 0, F.translate(t, " ", "\u00a0")).otherwise(t)
    return documents.filter("doc_id is not null").select("doc_id", F.concat(dense, F.lit("\n\u200be\u0301\u0302\u0303\u0304\u0305")).alias("text"))


def spaced_text(text: Column, doc_id: Column) -> Column:
    """Untidy white space: other line endings, double blanks, trailing tabs, runs of blank lines."""
    t = F.coalesce(text, F.lit(""))
    t = F.when(doc_id % 3 == 0, F.replace(t, F.lit(". "), F.lit(".  "))).otherwise(t)
    t = F.when(doc_id % 4 == 1, F.replace(t, F.lit("\n"), F.lit(" \t\n\n\n\n\n"))).otherwise(t)
    t = F.when(doc_id % 5 == 2, F.concat(F.lit("\n\n  "), t, F.lit("\n\n"))).otherwise(t)
    return F.when(doc_id % 2 == 0, F.replace(t, F.lit("\n"), F.lit("\r\n"))).otherwise(t)


def spaced(documents: DataFrame) -> DataFrame:
    return documents.filter("doc_id is not null").select("doc_id", spaced_text(F.col("text"), F.col("doc_id")).alias("text"))


def styled(pages: DataFrame) -> DataFrame:
    """Pages with one hidden-style idiom or numeric reference each."""
    snippets = ['<p style="font-size: 0px">x</p>', "<b style='color : transparent'>x</b>", '<i style="opacity:0.0;">x</i>', '<p style="display:none">x</p>', '<p style="visibility: collapse">x</p>', '<p style="text-indent: -9999px">x</p>', '<p aria-hidden="true">x</p>', '<p style="clip: rect(0, 0, 0, 0)">x</p>', "a&#160;b&#x200B;c&#65;", '<p style="color:#fff; background:#fff">x</p>']
    s = F.element_at(F.array(*map(F.lit, snippets)), (F.col("page_id") % len(snippets) + 1).cast("int"))
    return pages.filter("page_id is not null").select("page_id", "url", F.concat(F.coalesce("html", F.lit("")), s).alias("text"))


# Packages and PDF files made of the tables: what they hide follows from a number k.


def _zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def word_package(k: int, escaped: str) -> bytes:
    run = ("<w:vanish/>", "<w:webHidden/>", '<w:sz w:val="2"/>', '<w:sz w:val="24"/>', '<w:vanish/><w:webHidden/><w:sz w:val="1"/>')[k % 5]
    return _zipped({"word/document.xml": f"<w:r><w:t>{escaped}</w:t></w:r><w:rPr>{run}</w:rPr>", "word/styles.xml": "<w:t>\u00a0</w:t>"})


def slide_package(k: int, escaped: str) -> bytes:
    hidden = ' hidden="1"' if k % 2 else ""
    return _zipped({"ppt/slides/slide1.xml": f"<p:sp{hidden}/><a:t>{escaped}</a:t>"})


def sheet_package(k: int, escaped: str) -> bytes:
    value, formula = ("", "<v></v>", "<v>2</v>")[k % 3], "SUM(" + "A1," * 30 * (k % 2) + "A1)"
    return _zipped({
        "xl/sharedStrings.xml": f"<t>{escaped}</t>", "xl/workbook.xml": f'<sheet name="S{k}" sheetId="1" r:id="rId1"/>',
        "xl/_rels/workbook.xml.rels": '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>', "xl/worksheets/sheet1.xml": f'<c r="B{k % 7 + 1}"><f>{formula}</f>{value}</c><c r="C1"><v>1</v></c>',
    })


def pdf_file(k: int, escaped: str) -> bytes:
    shown = escaped.encode("ascii", "ignore").decode().replace("(", "").replace(")", "").replace("stream", "")
    body = f"BT {('3 Tr', '/F1 0 Tf', '0 Tz', '0 Tr', '/F1 0 Tf 0 Tz')[k % 5]} ({shown}) Tj ET\n".encode()
    packed = k % 3 > 0
    head = b"<< /Filter /FlateDecode >>" if packed else b"<< >>"
    return b"%PDF-1.4\n1 0 obj " + head + b"\nstream\n" + (zlib.compress(body) if packed else body) + b"\nendstream\nendobj\n"


def text_file(k: int, escaped: str) -> bytes:
    return escaped.encode()


#: Kinds by a document's number modulo their count; what a file hides follows from the quotient.
KINDS = [(".docx", word_package), (".pptx", slide_package), (".xlsx", sheet_package), (".pdf", pdf_file), (".md", text_file)]


def packed(documents: DataFrame) -> DataFrame:
    """(path, extension, content): every document's planted text in a file of a kind by its number; one in eleven is broken."""
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    rows = planted(documents).select("doc_id", F.element_at(F.array(*[F.lit(e) for e, _ in KINDS]), (F.col("doc_id") % len(KINDS) + 1).cast("int")).alias("extension"), text.alias("text"))

    def run(frames):
        for f in frames:
            f["content"] = [b"broken \xc3" if k % 11 == 10 else dict(KINDS)[e](k // len(KINDS), t) for k, e, t in zip(f["doc_id"], f["extension"], f["text"], strict=True)]
            f["path"] = [f"{k}{e}" for k, e in zip(f["doc_id"], f["extension"], strict=True)]
            yield f[["path", "extension", "content"]]

    return rows.mapInPandas(run, "path string, extension string, content binary")


def _chars(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


PLANTED_SQL = f"""planted AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN chr(128512) ELSE '' END || substr(t, 1, p) || ([{', '.join(map(_chars, INSERTS))}])[doc_id % 12 + 1] || substr(t, p + 1) AS t
  FROM (SELECT doc_id, 1 + doc_id % 40 AS p, CASE WHEN doc_id % 3 = 0 THEN replace(substr(x, 1, 200), ' ', chr(160)) || substr(x, 201) ELSE x END AS t
        FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents WHERE doc_id IS NOT NULL))
)"""
DEEP_SQL = f"""planted AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(coalesce(text, ''), ' ', chr(160)) ELSE coalesce(text, '') END || {_chars(chr(10) + chr(0x200B) + "e" + "".join(map(chr, range(0x301, 0x306))))} AS t FROM documents WHERE doc_id IS NOT NULL
)"""
SPACED_SQL = """spaced AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(t, chr(10), chr(13) || chr(10)) ELSE t END AS t FROM (
    SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN chr(10) || chr(10) || '  ' || t || chr(10) || chr(10) ELSE t END AS t FROM (
      SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN replace(t, chr(10), ' ' || chr(9) || repeat(chr(10), 5)) ELSE t END AS t FROM (
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(coalesce(text, ''), '. ', '.  ') ELSE coalesce(text, '') END AS t FROM documents WHERE doc_id IS NOT NULL)))
)"""
STYLED_SQL = """styled AS (
  SELECT page_id, url, coalesce(html, '') || (['<p style="font-size: 0px">x</p>', '<b style=''color : transparent''>x</b>', '<i style="opacity:0.0;">x</i>', '<p style="display:none">x</p>', '<p style="visibility: collapse">x</p>', '<p style="text-indent: -9999px">x</p>', '<p aria-hidden="true">x</p>', '<p style="clip: rect(0, 0, 0, 0)">x</p>', 'a&#160;b&#x200B;c&#65;', '<p style="color:#fff; background:#fff">x</p>'])[page_id % 10 + 1] AS t
  FROM pages WHERE page_id IS NOT NULL
)"""
