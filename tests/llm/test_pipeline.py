"""The stages, each on its own input, and the whole."""

from __future__ import annotations

import itertools
import math
import random

import corpus_pipeline as p
from lexigrain.llm import line_dedup, quality
from lexigrain.llm.vocab import vocabulary_path
from test_operators import brute_components, brute_leaks, brute_quality, corpus, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(tag: str, n: int = 60) -> str:
    return "\n".join(" ".join(f"{tag}{k}{j}" for j in "abcdefgh") for k in range(n // 8))


def write(spark, path, rows, items):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_stages(spark, tmp_path):
    near = text("near", 64)
    rows = [(1, text("one"), "xx", "s", 1), (2, "short", "xx", "s", 1), (3, near, "xx", "s", 1), (4, near.replace("near3c", "other"), "xx", "s", 1), (5, text("five") + "\n" + " ".join(f"q{k}" for k in range(20)), "xx", "s", 1), (6, text("one"), "xx", "s", 1)]
    write(spark, str(tmp_path), rows, [(0, " ".join(f"q{k}" for k in range(16)))])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    assert ids(p.quality_rules(spark, docs, d)) == [1, 3, 4, 5, 6]
    lines = p.dedup_lines(spark, docs, d)
    assert ids(lines) == [1, 2, 3, 4, 5] and lines.columns == docs.columns
    assert ids(p.one_of_each_group(spark, docs.unionAll(docs), d)) == [1, 2, 3, 5]
    assert ids(p.without_benchmark(spark, docs, d)) == [1, 2, 3, 4, 6]
    assert sorted({r.doc_id for r in p.packed(spark, docs, d).collect()}) == [1, 2, 3, 4, 5, 6]
    whole = p.run(spark, d)
    assert {r.doc_id for r in whole.collect()} == {1, 3, 4} and len(p.STAGES) == 5


def test_empty_and_null_rows(spark, tmp_path):
    write(spark, str(tmp_path / "a"), [], [])
    assert p.run(spark, str(tmp_path / "a")).count() == 0
    write(spark, str(tmp_path / "b"), [(None, None, None, None, None), (1, None, None, None, None), (2, "", None, None, 0)], [(None, None)])
    assert p.run(spark, str(tmp_path / "b")).count() == 0


def test_clashing_columns_and_chained_stages(spark, tmp_path):
    near = text("near", 64)
    rows = [(1, text("one"), "xx", "s", 1), (3, near, "xx", "s", 1), (4, near.replace("near3c", "other"), "xx", "s", 1), (5, text("five") + "\n" + " ".join(f"q{k}" for k in range(20)), "xx", "s", 1), (6, text("one"), "xx", "s", 1)]
    write(spark, str(tmp_path), rows, [(0, " ".join(f"q{k}" for k in range(16)))])
    docs, d = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    names = ["gone", "mark", "gone_id", "gone_mark", "twice_id", "twice_mark", "row_mark", "n_lines", "n_removed_lines", "component", "node", "kept"]
    docs = docs.withColumns({n: docs["doc_id"] for n in names})
    docs = docs.unionAll(docs)
    # each stage on what the one before gave, unwritten
    for stage, left in ((p.quality_rules, [1, 1, 3, 3, 4, 4, 5, 5, 6, 6]), (p.one_of_each_group, [1, 3, 5]), (p.without_benchmark, [1, 3]), (p.dedup_lines, [1, 3])):
        docs = stage(spark, docs, d)
        assert ids(docs) == left and docs.columns[5:] == names and all(r.gone == r.doc_id == r.mark for r in docs.collect())


def brute_line_stage(rows, percent=90):
    """Texts after all pairs of different lines were compared; documents without a word left are gone."""
    occ = sorted((i, k, line_dedup.normal(x).decode()) for i, t, *_ in rows if t is not None for k, x in enumerate(t.encode().split(b"\n")))
    occ = [o for o in occ if o[2]]
    group = {n: n for _, _, n in occ}
    for a, b in itertools.combinations(group, 2):
        most = (100 - percent) * max(len(a), len(b)) // 100
        if group[a] != group[b] and abs(len(a) - len(b)) <= most and line_dedup.edit_distance(a, b, most) <= most:
            old, new = group[a], group[b]
            group = {k: new if v == old else v for k, v in group.items()}
    first = {}
    for i, k, n in occ:
        first.setdefault(group[n], (i, k))
    gone = {(i, k) for i, k, n in occ if first[group[n]] != (i, k)}
    out = []
    for i, t, *_ in rows:
        new = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)
        if new == t or words(new):
            out.append((i, new))
    return sorted(out, key=str)


def within(x, band):
    """The bands of a document, wider by the share of ``FULL_TOKENS`` that it lacks."""
    slack = max(0, 1 - x.n_tokens / quality.FULL_TOKENS)
    values = (x.word_chars / x.n_tokens, x.word_chars / x.n_tokens_2, x.n_byte_tokens / x.n_tokens, x.token_entropy / math.log2(min(x.n_tokens, 32_000))) if x.n_tokens > 1 else ()
    return all(low * (1 - slack) <= v <= high * (1 + slack) for v, (low, high) in zip(values, (band.chars_per_token, band.chars_per_token_2, band.byte_share, band.evenness), strict=False))


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage on its own input: random texts with copies, near copies, shared passages and odd rows."""
    r = random.Random(11)
    rows = [x for x in dict.fromkeys(corpus(21, 50)) if len(x[1] or "") < 4000]
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(r.choices(vocabulary, k=n))) for k, n in enumerate((30, 13, 9))]
    rows += [(500 + k, "so " + r.choice(items)[1] + " it goes", "en", "s", 1) for k in range(6)]
    write(spark, str(tmp_path), rows, items)
    docs, d = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    texts = lambda df: sorted(((x.doc_id, x.text) for x in df.collect()), key=str)
    passed = {i for i, t, *_ in rows for n in [brute_quality(t)] if n[0] >= 10 and 100 * n[4] <= 20 * n[0]}
    given = quality.counts(docs, vocabulary_path(p.PIECES), vocabulary_path(p.RANKS), ["doc_id"]).collect()  # themselves held against brute force
    in_band = {x.doc_id for x in given if within(x, p.BANDS["en"])}
    assert ids(p.quality_rules(spark, docs, d)) == sorted(passed & in_band) and 10 < len(passed & in_band) < len(passed)
    assert texts(p.dedup_lines(spark, docs, d)) == brute_line_stage(rows)
    assert ids(p.one_of_each_group(spark, docs, d)) == sorted(i for i, _, c in brute_components(rows, 5, 80) if c == i)
    leaks = {i for i, _ in brute_leaks(rows, items)}
    assert len(leaks) == 6 and ids(p.without_benchmark(spark, docs, d)) == sorted(i for i, *_ in rows if i not in leaks)


def test_rows_of_one_id(spark, tmp_path):
    """Repeated ids: unrelated texts both stay, a copy goes alone, equal rows become one; inner names of columns stay."""
    a, b = text("aa"), text("bb")
    rows = [(1, a, "xx", "s", 1), (1, b, "xx", "s", 1), (2, b, "xx", "s", 1), (2, "", "xx", "s", 0), (3, "", "xx", "s", 0), (4, text("dd"), "xx", "s", 1), (4, text("dd"), "xx", "s", 1), (None, a, "xx", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = p.one_of_each_group(spark, docs, str(tmp_path))
    assert sorted(((x.doc_id or 0, x.text) for x in out.collect())) == sorted([(0, a), (1, a), (1, b), (2, ""), (3, ""), (4, text("dd"))])
    from pyspark.sql import functions as F

    held = p.dedup_lines(spark, docs.withColumns({"n_lines": F.lit("mine"), "n_removed_lines": F.lit(7)}), str(tmp_path))
    assert {(x.n_lines, x.n_removed_lines) for x in held.collect()} == {("mine", 7)}
