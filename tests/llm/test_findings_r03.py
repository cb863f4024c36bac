"""What the findings of round 3 were about."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest

from lexigrain.llm import ngram_join, quality, suffix_dedup
from lexigrain.llm.arrays import U
from lexigrain.llm.components import connected_components
from lexigrain.llm.vocab import vocabulary_path
from tests.llm.test_operators import frame


def test_bands_are_fitted_on_all_labelled_documents(spark):
    """5001 labelled ids are all taken, and the bands of the pipeline's stage rest on each of them."""
    ids = spark.range(5001).withColumnRenamed("id", "doc_id")
    assert quality.label_sample(ids, ids.selectExpr("doc_id", "1 AS quality")).count() == 5001

    docs = frame(spark, [(k, " ".join(f"{w}{'ab'[k % 2]}" for w in "where were we all when the rain came down again".split()), "en", "s", 1) for k in range(40)])
    labels = docs.selectExpr("doc_id", "int(doc_id % 4 > 0) AS quality")
    p, q = vocabulary_path("piece_bpe_32k.model"), vocabulary_path("byte_bpe_multi_50k.tiktoken")
    counted = quality.counts(docs, p, q, ["doc_id", "lang"])
    bands = {(x.lang, x.script): x.bands for x in quality.fitted_to(counted, labels).collect()}
    good = quality.measured(counted).filter("doc_id % 4 > 0").selectExpr("avg(chars_per_token) AS m", "avg(ln(n_tokens)) AS u").first()
    b = bands["en", "Latin"]["chars_per_token"]
    assert abs(b.level + b.slope * good.u - good.m) < 1e-9
    kept = quality.kept_documents(docs, {}, p, q, labels)
    assert kept.columns == docs.columns and kept.count() == 40


def test_a_shared_line_makes_no_cluster(spark):
    """Documents with a line of sixteen words in common and nothing else do not meet, so that clusters do not grow with the table."""
    r = random.Random(3)
    line = " ".join(f"line{k}" for k in range(16))
    rows = [(k, " ".join(f"w{r.randrange(10**9)}" for _ in range(90)) + " " + line, "en", "s", 1) for k in range(300)]
    keys = ngram_join.fingerprint_rows(frame(spark, rows), 5, 80).distinct()
    met = connected_components(keys.alias("a").join(keys.alias("b"), "h").selectExpr("a.node AS a", "b.node AS b"))
    assert max(x["count"] for x in met.groupBy("component").count().collect()) <= 30


@pytest.mark.parametrize("percent", [30, 50, 80, 90])
def test_links_of_sets_of_any_size_meet(percent):
    """Of 300 pairs of each size, as different as links may be, all share a fingerprint."""
    r = np.random.default_rng(5)
    for size in [*range(1, 30), 45, 60, 120]:
        differ = size * (100 - percent) // percent
        if not differ:
            continue
        sets, pairs = [], 300
        for _ in range(pairs):
            larger = np.sort(r.integers(0, 2**63, size + differ).astype(U))
            sets += [np.sort(r.choice(larger, size, replace=False)), larger]
        s = ngram_join.Sets.__new__(ngram_join.Sets)
        s.size = np.array([len(x) for x in sets])
        s.tokens, s.doc, s.begin = np.concatenate(sets), np.repeat(np.arange(len(sets)), s.size), np.cumsum(s.size) - s.size
        d, h = ngram_join.fingerprints(s, np.ones(len(sets), bool), percent)
        keys = [set() for _ in sets]
        for x, y in zip(d.tolist(), h.tolist(), strict=True):
            keys[x].add(y)
        assert all(keys[2 * k] & keys[2 * k + 1] for k in range(pairs)), size


def test_texts_of_documents_without_a_cluster_stay(spark):
    """Before texts are shuffled to their members, most others are left out, and no member is."""
    docs = spark.range(20000).withColumnRenamed("id", "doc_id")
    left = {x.doc_id for x in ngram_join.only_marked(docs, docs.filter("doc_id % 50 = 7")).collect()}
    assert {k for k in range(20000) if k % 50 == 7} <= left and len(left) < 4000
    assert ngram_join.only_marked(docs, docs.limit(0)).count() == 0


def test_parts_by_members_hold_every_row_once(spark):
    """All members are in the first part, with few others, and a row is in one part only."""
    docs = spark.range(20000).selectExpr("id - 9 AS doc_id").unionAll(spark.range(50).selectExpr("id AS doc_id"))
    for share in (3, 50):
        first, rest = ngram_join.parted(docs, docs.filter(f"pmod(doc_id, {share}) = 1"))
        a, b = ([x.doc_id for x in part.collect()] for part in (first, rest))
        assert sorted(a + b) == sorted(x.doc_id for x in docs.collect()) and not set(a) & set(b)
        assert all(k % share != 1 for k in b) and len(a) < 20000 // share + 4000
    first, rest = ngram_join.parted(docs, docs.limit(0))
    assert first.count() == 0 and rest.count() == 20050


def test_texts_without_a_repeat_stay_out_of_shuffles(spark):
    """Of 400 long texts six share a passage: shuffles hold and leave a small part of the texts."""
    r = random.Random(6)
    make = lambda k: "".join(r.choices("abcdefghijklmnopqrstuvwxyz .,ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=k))
    passage = make(500)
    rows = [(k, make(5000) + (chr(0x100 + k) + passage + chr(0x200 + k) if k % 70 == 5 else "") + make(5000), "en", "s", 1) for k in range(400)]

    def shuffled():
        top = spark.sparkContext.getConf().get("spark.local.dir")
        return {f: os.path.getsize(f) for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_") and os.path.exists(f := f"{d}/{x}")}

    docs = frame(spark, rows).localCheckpoint()
    before = shuffled()
    out = suffix_dedup.remove_repeats(docs)
    got_ = {x.doc_id: (x.n_removed, x.n_spans) for x in out.collect()}
    assert got_ == {k: (500, 1) if k % 70 == 5 else (0, 0) for k in range(400)}
    assert sum(n for f, n in shuffled().items() if f not in before) < 2_000_000
