"""Files, packages, PDF streams, markup idioms, settings and streams."""

from __future__ import annotations

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lexigrain.operators import office, styles
from lexigrain.plans.settings import SettingsError, parsed
from lexigrain.sources import containers, files
from lexigrain.streaming import feed

NBSP = "\u00a0"


def package(**members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return b.getvalue()


def pdf(stream: str):
    data = zlib.compress(stream.encode())
    return b"%PDF-1.4\n1 0 obj << /Filter /FlateDecode /Length " + str(len(data)).encode() + b" >>\nstream\n" + data + b"\nendstream\nendobj\n"


def scanned(spark, *rows):
    df = spark.createDataFrame([(f"f{k}{ext}", ext, content) for k, (ext, content) in enumerate(rows)], "path string, extension string, content binary")
    found, errors = office.find_in_containers(df)
    return sorted((r.path, r.name, r.detail) for r in found.collect()), errors.count()


def test_word(spark):
    xml = f'<w:r><w:rPr><w:vanish/></w:rPr><w:t>a&#160;b{NBSP}</w:t></w:r><w:rPr><w:sz w:val="1"/></w:rPr>'
    got, errors = scanned(spark, (".docx", package(word__document_dot_xml=xml)))
    assert [x[1] for x in got] == ["NBSP", "NBSP_ENTITY", "OOXML_HIDDEN_RUN", "OOXML_SUSPICIOUS_FONT_SIZE"] and errors == 0


def test_slides_and_sheets(spark):
    slide = f'<p:sp hidden="1"/><a:t>{NBSP}</a:t>'
    sheet = '<c r="A1"><f>1+1</f><v>2</v></c><c r="B1"><f>SUM(A1)</f></c>'
    book = '<sheet name="Budget" sheetId="1" r:id="rId1"/>'
    rels = '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
    got, errors = scanned(
        spark, (".pptx", package(ppt__slides__slide1_dot_xml=slide)),
        (".xlsx", package(**{"xl__worksheets__sheet1_dot_xml": sheet, "xl__workbook_dot_xml": book, "xl/_rels/workbook.xml.rels": rels})),
    )
    assert [(x[1], x[2]) for x in got] == [("NBSP", None), ("OOXML_HIDDEN_SHAPE", None), ("EMPTY_FORMULA_CELL", "Budget!B1: SUM(A1), cached value absent")] and errors == 0


def test_pdf(spark):
    got, errors = scanned(spark, (".pdf", pdf("BT 3 Tr (x) Tj ET")), (".pdf", pdf("BT /F1 0 Tf 0 Tz (x) Tj ET")), (".pdf", pdf("no text 3 Tr")), (".pdf", b"nothing"), (".docx", b"no zip"))
    assert [x[1] for x in got] == ["PDF_INVISIBLE_TEXT", "PDF_ZERO_FONT", "PDF_ZERO_WIDTH"] and errors == 2


def test_bad_member_is_an_error(spark):
    got, errors = scanned(spark, (".docx", package(word__document_dot_xml=b"\xc3\x28")))
    assert got == [] and errors == 1
    assert containers.zip_members(b"PK", ".")[0][2]


def test_files(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, data in {"a.md": b"\xef\xbb\xbfok", "b.txt": b"\xc3\x28", "c.bin": b"x", "node_modules/d.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    got = files.read_files(spark, [str(tmp_path)])
    texts, errors = files.decoded(got)
    assert [(r.path.rsplit("/")[-1], r.text) for r in texts.collect()] == [("a.md", "\ufeffok")]
    assert [r.path.rsplit("/")[-1] for r in errors.collect()] == ["b.txt"]
    with pytest.raises(Exception):  # noqa: B017
        files.read_files(spark, [str(tmp_path / "missing")]).count()


def test_styles(spark):
    df = spark.createDataFrame([(".html", "a{font-size:0}"), (".css", "a{font-size:0}"), (".txt", "a{font-size:0}"), (".html", "color:#fff;background:#FFF; font-size:0.5em")], "ext string, text string")
    got = sorted((r.ext, r.name, r.severity) for r in styles.find_hidden_styles(df, F.col("ext")).collect())
    assert got == [(".css", "HIDDEN_STYLE_ZERO_FONT", "info"), (".html", "HIDDEN_STYLE_SAME_COLOR", "warning"), (".html", "HIDDEN_STYLE_ZERO_FONT", "warning")]


def test_entities_end_at_another_character(spark):
    df = spark.createDataFrame([("&#160abc;&#xA0;&#65;&#99999999999999999999;",)], "text string")
    assert [r.code_point for r in office.find_entities(df).collect()] == [160, 160]


def test_settings():
    s, warnings = parsed(json.dumps({"scanner": {"threshold": "Warning", "odd": 1}, "artifacts": [{"code_point": "0xAD", "name": "SHY", "severity": "info", "fix_action": "remove"}], "profiles": {"p": {"max_blank_lines": 3}}, "workspaces": {"w": {"max_chars": 5, "transform": "p"}}}))
    assert s.threshold == "warning" and s.overrides == ((0xAD, "SHY", "info", "remove"),) and warnings == ["scanner.odd: not known"] and s.profiles["p"].max_blank_lines == 3
    with pytest.raises(SettingsError) as e:
        parsed(json.dumps({"scanner": {"threshold": "x", "zalgo_max_combining": 1}, "workspaces": {"w": {"transform": "none", "max_chars": 0}}}))
    assert len(str(e.value).split("\n")) == 4


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 1, f"a{NBSP}"), (1, 2, "clean now"), (2, 1, f"{NBSP}b")], "doc_id long, version long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    changes = spark.readStream.schema("doc_id long, version long, text string").parquet(str(tmp_path / "in"))
    q = feed.scan_changes(changes, "doc_id", "version", lambda f, _: f.select("doc_id", "name").write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [(r.doc_id, r.name) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(2, "NBSP")]


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
