"""Quiet-period scans, findings that are taken back, logs of batches."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexigrain.operators.scan import find_all
from lexigrain.sources.log import BatchLog, json_records
from lexigrain.streaming import diagnostics, quiet

START = datetime(2024, 1, 1)
SCHEMA = "doc_id long, at timestamp, version long, text string"
NBSP, STACK = "\u00a0", "e\u0301\u0302\u0303\u0304"


def edits(spark, rows):
    return spark.createDataFrame([(d, START + timedelta(milliseconds=ms), v, t) for d, ms, v, t in rows], SCHEMA).coalesce(1)


def run_quiet(spark, tmp_path, **options):
    quiet.with_rocks(spark)
    changes = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = quiet.quiet_versions(changes, "doc_id", "at", **options).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    return sorted((r.doc_id, r.version) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_two_edits_within_the_period_give_one_scan(spark, tmp_path):
    edits(spark, [(1, 0, 1, f"a{NBSP}"), (1, 300, 2, "b"), (2, 0, 1, "x"), (3, 100, 1, None)]).write.parquet(str(tmp_path / "in"))
    assert run_quiet(spark, tmp_path) == []  # the watermark stands at 300
    # after a restart: document 1 goes on within the period, and time passes for the others
    edits(spark, [(1, 700, 3, "c"), (9, 5_000, 1, "later")]).write.mode("append").parquet(str(tmp_path / "in"))
    assert run_quiet(spark, tmp_path) == [(1, 3), (2, 1), (3, 1)]
    edits(spark, [(9, 5_600, 2, "z"), (9, 9_000, 3, "end")]).write.mode("append").parquet(str(tmp_path / "in"))
    assert run_quiet(spark, tmp_path) == [(1, 3), (2, 1), (3, 1), (9, 1), (9, 2)]


def test_late_edits_within_the_delay_count(spark, tmp_path):
    edits(spark, [(1, 0, 1, "a"), (1, 1_200, 3, "c")]).write.parquet(str(tmp_path / "in"))
    run_quiet(spark, tmp_path, delay="2 seconds")
    edits(spark, [(1, 800, 2, "b"), (5, 9_000, 1, "x")]).write.mode("append").parquet(str(tmp_path / "in"))
    assert run_quiet(spark, tmp_path, delay="2 seconds") == [(1, 1), (1, 3)]


def test_settled_edits():
    r = random.Random(3)
    for _ in range(300):
        es = sorted({(r.randrange(3000), v, "t") for v in range(r.randrange(9))})
        want = [e for e, f in zip(es, [*es[1:], None]) if f is None or f[0] - e[0] >= 500]
        out, left = quiet.settled(r.sample(es, len(es)), 10_000, 500)
        assert (out, left) == (want, [])
        # in steps of time, with each edit known when its time has come
        waiting, got = [], []
        for now in range(0, 4_000, 100):
            waiting += [e for e in es if now - 100 < e[0] <= now]
            out, waiting = quiet.settled(waiting, now, 500)
            got += out
        assert got == want and not waiting


def test_live_scan(spark, tmp_path):
    import time

    edits(spark, [(1, 0, 1, "a"), (1, 1, 2, f"b{NBSP}{STACK}")]).write.parquet(str(tmp_path / "in"))
    changes = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    log = BatchLog(spark, str(tmp_path / "log"), "doc_id long, version long, name string")
    q = quiet.scan_quiet(changes, "doc_id", "at", log.commit, str(tmp_path / "cp"), "200 milliseconds", live=True)
    try:
        for _ in range(120):
            time.sleep(0.5)
            got = sorted(map(tuple, log.read().collect()))
            if got:
                break
    finally:
        q.stop()
    assert got == [(1, 2, "NBSP"), (1, 2, "ZALGO_RUN")]


def versions(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, version long, text string, lang string")


def sums(df):
    return {tuple(r)[:-1]: r[-1] for r in df.groupBy("doc_id", "name", "scalar_index").agg(F.sum("change").alias("n")).filter("n <> 0").collect()}


def test_changes_sum_up_to_a_full_scan(spark, tmp_path):
    r, log, texts = random.Random(8), diagnostics.diagnostics_log(spark, str(tmp_path / "log"), "doc_id"), {}
    for batch in range(4):
        rows = []
        for v in range(12):
            d = r.randrange(6)
            t = r.choice([None, "", *("".join(r.choices(["a", NBSP, "\u200b", STACK], k=4)) for _ in range(6))])
            rows.append((d, batch * 100 + v, t, r.choice(["en", "xx"])))
            texts[d] = (t, rows[-1][3])
        df = versions(spark, rows)
        assert diagnostics.record_changes(log, df, batch, "doc_id", wanted=F.col("lang") == "en")
        assert not diagnostics.record_changes(log, df, batch, "doc_id")  # repeated after a crash
        now = spark.createDataFrame([(d, t) for d, (t, lang) in texts.items() if lang == "en"], "doc_id long, text string")
        want = Counter((x.doc_id, x.name, x.scalar_index) for x in find_all(now).collect())
        assert sums(log.read()) == dict(want)
        if batch == 2:
            log.fold(lambda x: diagnostics.standing(x, "doc_id"))
            assert log.batches() == [] and log.committed(1) and sums(log.read()) == dict(want)


def test_following_a_stream(spark, tmp_path):
    log = diagnostics.diagnostics_log(spark, str(tmp_path / "log"), "doc_id")
    for k, rows in enumerate([[(1, 1, f"a{NBSP}", "en"), (2, 1, NBSP, "en")], [(1, 2, "a", "en"), (None, 1, NBSP, "en")], [(2, 2, f"x{NBSP}", "en")]]):
        versions(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes = spark.readStream.schema("doc_id long, version long, text string, lang string").parquet(str(tmp_path / "in"))
        diagnostics.follow(changes, log, "doc_id", str(tmp_path / "cp"), fold_every=2).awaitTermination()
        assert sums(log.read()) == [{(1, "NBSP", 1): 1, (2, "NBSP", 0): 1}, {(2, "NBSP", 0): 1}, {(2, "NBSP", 1): 1}][k]


def test_log_of_batches(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"), "a long, b string")
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    assert log.read().count() == 0 and log.commit(df, 3) and not log.commit(df, 3) and log.commit(df.withColumn("b", F.lit(None)), 5)
    (tmp_path / "log" / "batch=6").mkdir()  # never made by a commit: empty
    (tmp_path / "log" / "_staged" / "left-over").mkdir(parents=True)
    assert sorted(map(tuple, log.read().collect()), key=str) == [(1, "x"), (1, None)] and log.batches() == [3, 5, 6]
    # two writers of one batch: the second one finds it there
    assert not log._put(df, "batch=5") and log.read().count() == 2
    for k in range(7, 10):
        log.commit(df, k)
        log.fold(lambda x: x.groupBy("b").agg(F.sum("a").alias("a")).select("a", "b"))
    assert sorted(map(tuple, log.read().collect()), key=str) == [(1, None), (4, "x")] and log.committed(4) and not log.committed(10)
    assert {p.name for p in (tmp_path / "log").iterdir() if "=" in p.name} == {"upto=9", "upto=8", "batch=9"}
    with pytest.raises(ValueError):
        log.commit(df, -1)


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": ["x"]}\n\n[1]\n{"a": \n{"a": "no number"}\n{"b": null}\n7\n')
    good, bad = json_records(spark, str(tmp_path / "a.jsonl"), "a long, b array<string>")
    assert sorted(map(tuple, good.collect()), key=str) == [(1, ["x"]), (None, None)]
    assert sorted(r.record for r in bad.collect()) == ["7", "[1]", '{"a": ', '{"a": "no number"}']
