"""What the findings of round 4 were about."""

from __future__ import annotations

import os
import random
import tempfile

import numpy as np
from pyspark.sql import functions as F

from lexigrain import catalogue, queries
from lexigrain.llm import line_dedup, shared
from tests.llm.test_operators import frame, got


def changed(r: random.Random, text: str, n: int) -> str:
    t = list(text)
    for _ in range(n):
        i = r.randrange(len(t) + 1)
        t[i : i + r.randint(0, 1)] = r.choice(["", "x", "漢"])
    return "".join(t)


def test_pairs_compared_side_by_side(monkeypatch):
    """Edit distances of many pairs at once, narrow and wide bands alike, are those of one pair at a time."""
    r = random.Random(7)
    texts = ["".join(r.choices("abcdeé ", k=r.choice([0, 1, 9, 60, 150, 700]))) for _ in range(150)]
    pairs = [(a, changed(r, a, r.randint(0, 1 + len(a) // 4))) for a in texts]
    pairs = [x if r.random() < 0.5 else x[::-1] for x in pairs]
    for percent in (60, 80, 90):
        most = [(100 - percent) * max(map(len, x)) // 100 for x in pairs]
        want = [line_dedup.edit_distance(*x, m) <= m for x, m in zip(pairs, most, strict=True)]
        assert 0 < sum(want) < len(want)
        monkeypatch.setattr(line_dedup, "SOME", 1)
        assert line_dedup.similar(pairs, percent).tolist() == want
        short, long = zip(*(sorted(x, key=len) for x in pairs), strict=True)
        o = [k for k in np.argsort([-len(x) for x in long], kind="stable") if len(long[k]) - len(short[k]) <= most[k]]
        assert line_dedup.within([short[k] for k in o], [long[k] for k in o], np.array([most[k] for k in o])).tolist() == [want[k] for k in o]


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    """Lines of a cut cluster go to few tasks beside their own block's, by length, and link as in one piece."""
    r = random.Random(11)
    rows = []
    for k in range(240):
        n = 20 + k // 2
        rows.append((k, " ".join("".join(r.choices("abcdefghij", k=6)) if r.random() < 0.02 else f"word{i}" for i in range(n)), "en", "s", 1))
    docs = frame(spark, rows)
    whole = got(line_dedup.remove_lines(docs), "doc_id", "text", "n_removed_lines")
    assert 0 < sum(x[2] for x in whole) < 240
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    searched, given = line_dedup.searched, []

    def seen(lines, *rest):
        given.append(lines.count())
        return searched(lines, *rest)

    monkeypatch.setattr(line_dedup, "searched", seen)
    assert got(line_dedup.remove_lines(docs), "doc_id", "text", "n_removed_lines") == whole
    # every line against every other one of fifteen blocks would be 3600 lines
    assert len(given) == 3 and sum(given) < 7 * 240


def test_line_dedup_leaves_little_behind(spark):
    """Only the places of removed lines stay in the shared folder, and no file of a shuffle stays."""
    r = random.Random(13)
    docs = frame(spark, [(k, "one line stands in all of them\n" + " ".join("".join(r.choices("abcdefghij", k=8)) for _ in range(12)), "en", "s", 1) for k in range(60)])
    folder = shared.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = line_dedup.remove_lines(docs)
    assert [x.partition("-")[0] for x in set(os.listdir(folder)) - before] == ["removed"]
    assert got(out, "doc_id", "n_removed_lines") == [(k, int(k > 0)) for k in range(60)]


def test_a_plan_is_scanned_for_once(spark):
    """Verification scans the copies and the originals beside the plan, which is read back where it is used."""
    rows = frame(spark, [(k, f"one{chr(160)}two three​ four {k}", "en", "s", 1) for k in range(9)])
    with tempfile.TemporaryDirectory() as folder:
        rows.write.parquet(f"{folder}/documents.parquet")
        _, items = queries._plan(spark, folder)
        assert not any("documents.parquet" in f for f in items.inputFiles())
        out = queries.repair_verification(spark, folder)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("regexp_extract_all") <= 4  # two passes over either
        assert {x.version for x in out.collect()} == {"original"}


def test_character_class_looks_at_few_ranges(spark):
    """The class has the catalogue's characters, whatever is left out, and most ranges stand behind one that is around them."""
    chars = spark.range(0x110000).filter("id < 55296 or id > 57343").withColumn("c", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")).filter("ascii(c) = id")
    known = {e.code_point for e in catalogue.entries()}
    high = frozenset(c for c in known if c >= 0x300)
    for without in (frozenset(), frozenset([0x200B, 0x34F, 0]), high):
        found = {x.id for x in chars.filter(F.col("c").rlike(catalogue.character_class(without))).collect()}
        assert found == (known - without) & {x.id for x in chars.filter(F.col("id").isin(*known)).select("id").collect()}
    assert catalogue.character_class().partition("&&")[0].count("-") < 8
