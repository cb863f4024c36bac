"""PDF by blocks, marked regions, settings with every problem told."""

from __future__ import annotations

import json
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lexigrain.catalogue import catalogue
from lexigrain.operators import regions
from lexigrain.plans.settings import SettingsError, loaded, parsed
from lexigrain.sources import containers, pdf


def pdf_bytes(r, n):
    out = [b"%PDF-1.7\n"]
    for _ in range(n):
        kind = r.randrange(8)
        body = r.choice([b"BT 3 Tr (x) Tj ET", r.randbytes(200).replace(b"stream", b""), b"", b"\r\n", b"x\r", b"no end of stream here"])
        packed = zlib.compress(body)
        line = r.choice([b"\n", b"\r\n", b"\r", b""])
        out.append({
            0: b"<< /Filter /FlateDecode >>" + r.choice([b"\n", b""]) + b"stream" + line + packed + r.choice([b"\n", b"\r\n", b""]) + b"endstream",
            1: b"<< >>\nstream" + line + body + b"\nendstream\n", 2: b"endstream", 3: b"stream", 4: b"<< /Filter /FlateDecode >> stream\nbroken\nendstream",
            5: b"streamendstream", 6: r.randbytes(r.randrange(3000)), 7: b"<< >> stream\n" + body + b"\r\nendstreamstream",
        }[kind])
    return b"".join(out)


def test_pdf_by_blocks_gives_what_the_whole_gives(spark, tmp_path):
    r, rows, want = random.Random(4), [], {}
    for k in range(12):
        data = pdf_bytes(r, k * 3) if k else b"no PDF"
        path = str(tmp_path / f"{k}.pdf")
        (tmp_path / f"{k}.pdf").write_bytes(data)
        rows.append((path, len(data)))
        want |= {(path, m): (d, e) for m, d, e in containers.pdf_streams(data)}
    files = spark.createDataFrame(rows, "path string, size long")
    for block in (64, 1000, 1 << 20):
        got = pdf.pdf_members(files, block).collect()
        assert {(x.path, x.member): (None if x.data is None else bytes(x.data), x.error) for x in got} == want and len(got) == len(want)


def test_pdf_of_more_than_two_gigabytes(spark, tmp_path):
    path = str(tmp_path / "large.pdf")
    with open(path, "wb") as f:  # the hole takes no disk
        f.write(b"%PDF-1.7\n<< >> stream\nfirst\nendstream\n")
        f.seek((2 << 30) + 12_345)
        f.write(b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(b"last") + b"\nendstream\n")
    files = spark.createDataFrame([(path, os.path.getsize(path))], "path string, size long")
    assert sorted((x.member, bytes(x.data)) for x in pdf.pdf_members(files).collect()) == [("stream#0", b"first"), ("stream#1", b"last")]


# regions


def test_a_catalogue_table_round_trip(spark):
    table = catalogue(spark).filter("severity = 'critical'").select("code_point", "name", "severity", "description")
    fresh = regions.rendered(table, "critical").first().region
    texts = [f"head\n// {fresh}\ntail {regions.END}", f"x {regions.begin_line('critical')}\nold\n{regions.END} y", f"{regions.begin_line('critical')}\nno end", "none", None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    out = {r.doc_id: r for r in regions.synchronised(docs, table, "critical").collect()}
    assert [out[k].drifted for k in range(6)] == [False, True, False, False, False, False]
    assert out[0].text == texts[0] and out[1].text == f"x {fresh} y" and [out[k].text for k in range(2, 6)] == texts[2:]
    assert out[0].problem is out[1].problem is None and "missing" in out[2].problem and out[3].problem.startswith("missing marker") and out[4].problem == "no text"
    back = regions.entries(docs.filter("doc_id = 0"), "critical").drop("doc_id")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, table.collect())) and back.count() > 5
    # one entry changed: told as drift
    other = table.withColumn("severity", F.when(F.col("code_point") == back.first().code_point, "info").otherwise(F.col("severity")))
    assert [r.drifted for r in regions.synchronised(docs.filter("doc_id = 0"), other, "critical").collect()] == [True]


# settings


@pytest.mark.parametrize(("given", "problems"), [
    ("[]", 1), ("{", 1), ('{"scanner": []}', 1), ('{"scanner": {"zalgo": 1, "bidi": null, "exclude_paths": "x", "threshold": 3, "context_radius": true}}', 5),
    ('{"artifacts": {}}', 1), ('{"artifacts": [1, {}, {"code_point": "zz", "name": 1, "severity": "odd", "fix_action": "replace:110000"}]}', 9),
    ('{"artifacts": [{"code_point": "A0", "name": "X", "severity": "info", "fix_action": "eat"}, {"code_point": 160, "name": "X", "severity": "info", "fix_action": "keep"}]}', 2),
    ('{"profiles": 1}', 1), ('{"profiles": {"p": 3, "q": {"trim_lines": "yes", "max_blank_lines": -1, "target_line_ending": 2}}, "workspaces": {"w": [], "v": {"max_chars": "9", "transform": ["p"]}}}', 7),
])
def test_every_problem_of_settings_is_told(given, problems):
    with pytest.raises(SettingsError) as e:
        parsed(given)
    told = str(e.value).split("\n")
    assert len(told) == problems, told


def test_settings_are_loaded_from_a_file(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"scanner": {"threshold": "error"}, "odd": 1, "profiles": {"p": {"trim_lines": False, "colour": "x"}}}, indent=1))
    s, warnings = loaded(spark, str(tmp_path / "s.json"))
    assert s.threshold == "error" and s.profiles["p"].trim_lines is False and warnings == ["settings.odd: not known", "profiles.p.colour: not known"]
    (tmp_path / "bad.json").write_text('{"scanner": 1, "artifacts": 2}')
    with pytest.raises(SettingsError) as e:
        loaded(spark, str(tmp_path / "bad.json"))
    assert [line.split(": ")[0].endswith("bad.json") for line in str(e.value).split("\n")] == [True, True]
