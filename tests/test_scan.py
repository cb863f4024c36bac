"""Positions, stacks, toggles and overrides of findings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexigrain.catalogue import catalogue, entries
from lexigrain.operators import report, scan
from lexigrain.plans.audit import audit
from lexigrain.plans.settings import Settings

NBSP, ZWJ, SMILE = "\u00a0", "\u200d", "\U0001f600"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def places(df):
    return sorted((r.doc_id, r.line, r.column, r.byte_offset, r.scalar_index) for r in df.collect())


CASES = [
    (f"{SMILE}x{NBSP}y", (1, 3, 5, 2)),
    (f"{SMILE}{NBSP}", (1, 2, 4, 1)),
    (f"a\r\nb{NBSP}c", (2, 2, 4, 4)),
]


@pytest.mark.parametrize("dense", [False, True])
def test_positions(spark, dense):
    df = docs(spark, *[t for t, _ in CASES], f"one{NBSP}\ntwo{NBSP}\nthree", "", None, "plain")
    got = places(scan.find_characters_dense(df, ["doc_id"]) if dense else scan.find_characters(df))
    assert got == [(i, *p) for i, (_, p) in enumerate(CASES)] + [(3, 1, 4, 3, 3), (3, 2, 4, 9, 8)]


def test_plans_agree_on_many_hits(spark):
    df = docs(spark, *[(f"a{NBSP}\u200b\n{SMILE}\u0301\u0302\u034f" * k) + "end\n" for k in range(0, 200, 37)])
    one, two, auto = (places(x) for x in (scan.find_characters(df), scan.find_characters_dense(df, ["doc_id"]), scan.find_characters_auto(df, ["doc_id"])))
    assert one == two == auto and one


def test_catalogue(spark):
    by = {e.code_point: e for e in entries()}
    assert len(by) == 603 == catalogue(spark).count()
    assert by[0xFFFE].name == "REVERSED BOM" and by[0xFFFE].severity == "critical"
    assert by[0x85].name == "C1_NEL" and by[0x85].severity == "warning"
    assert by[0xE0041].unicode_name == "TAG LATIN CAPITAL LETTER A"
    assert not by.keys() & {0x41, 0x20, 0x09, 0x0A, 0x0D, 0xE9, 0x4E2D, 0x1F600, 0xE0000, 0xE0080}


def test_stacks(spark):
    m = "\u0301"
    df = docs(spark, "a" + 3 * m, "a" + 4 * m, 5 * m, f"a{4 * m}b{4 * m}", "e\u0301 naïve", None)
    got = sorted((r.doc_id, r.scalar_index, r.combining_marks, r.cluster_scalars) for r in scan.find_stacked_marks(df).collect())
    assert got == [(1, 1, 4, 5), (2, 0, 5, 5), (3, 1, 4, 5), (3, 6, 4, 5)]
    assert "no base character" in scan.find_stacked_marks(df).filter("doc_id = 2").first().description


def test_a_joiner_is_a_character_and_a_mark(spark):
    got = {r.name for r in scan.find_all(docs(spark, "a" + 4 * "\u034f")).collect()}
    assert got == {"CGJ", "ZALGO_RUN"}


def test_toggles_and_overrides(spark):
    df = docs(spark, f"\u202e\ufe0f\U000e0041{NBSP}\u00ad")
    all_ = scan.find_characters(df)
    assert {r.name for r in scan.toggled(all_, bidi=False, tags=False, variation_selectors=False).collect()} == {"NBSP", "SHY"}
    rows = spark.createDataFrame([(0xAD, "SOFT", "critical", "keep"), (0xA0, "HARD", "info", "replace:2D")], "code_point long, name string, severity string, fix_action string")
    got = {r.name: (r.severity, r.severity_rank, r.safety, r.fix, r.fix_with) for r in scan.overridden(all_, rows).collect()}
    assert got["SOFT"] == ("critical", 4, "semantic", "keep", None) and got["HARD"] == ("info", 1, "mechanical", "replace", "-")
    assert got["RLO"][0] == "critical"


def test_audit_status(spark):
    assert audit(docs(spark, "clean"), "doc_id").summary.first().status == 0
    assert audit(docs(spark, "\u202e"), "doc_id").summary.first().status == 1
    errors = spark.createDataFrame([("x", "malformed UTF-8")], "path string, error string")
    assert audit(docs(spark, "clean"), "doc_id", errors=errors).summary.first().status == 2
    limited = Settings(workspaces={"w": {"max_words": 2}})
    found = audit(docs(spark, "one two three"), "doc_id", limited, workspace="w").findings
    assert [(r.name, r.line) for r in found.collect()] == [("CONSTRAINT_WORDS", None)]


def test_lines(spark):
    f = scan.find_characters(docs(spark, f"a{NBSP}b"))
    r = f.select(report.finding_line(F.lit("p")).alias("a"), report.hex_line(F.lit("p")).alias("b"), report.annotation(F.lit("p"), F.lit(True)).alias("c")).first()
    assert r.a == "p:1:2: ERROR NBSP U+00A0 [C2 A0] (mechanical)"
    assert r.b == "0x00A0 [NBSP] p L:1 C:2 B:1"
    assert r.c == "::error file=p,line=1,col=2::NBSP U+00A0 (error)"


def test_empty_tables(spark):
    empty = docs(spark, "x").limit(0)
    assert scan.find_all(empty).count() == 0
    assert report.records(empty, scan.find_characters(empty), "doc_id").count() == 0
