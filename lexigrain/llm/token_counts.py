"""Token counts kept as additive rollups that signed deltas maintain.

A change feed has rows ``(op, source, lang, tokenizer_version, old_tokens,
new_tokens)`` with ``op`` insert, delete or revise. Each batch is reduced to one
signed delta per key and enters the store whole, by a rename; a later commit of the same
batch takes its place, empty or not: totals do not move when it is repeated.
``fold`` adds the batches it finds committed to a rollup table and notes their numbers;
totals are the rollup and the deltas since. A rollup counts once its note is in place, so
a fold that was cut short is done again. Commits may run beside a fold: a batch that lands
after the fold has looked is not in its note and counts as a delta, and one that is committed
anew meanwhile is exchanged. A batch that is folded is closed: committing
the same delta again changes nothing, another one raises.

Defined results: null keys form their own groups; a null count is 0; an unknown or
null ``op`` raises in the job; keys whose totals are all zero are not returned; an
empty batch commits an empty delta; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lexigrain.llm.arrays import chunks
from lexigrain.llm.packing import token_rows
from lexigrain.llm.shared import exists
from lexigrain.llm.vocab import word_bpe_tokens
from lexigrain.sources.log import put

KEYS = ["source", "lang", "tokenizer_version"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"
#: Two tokenizer versions that both Spark and SQL can count: blank-separated words, and letter/digit runs plus single marks.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "marks-1": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"}


def signed_delta(changes: DataFrame) -> DataFrame:
    """One row per key: the change in documents and tokens. Aggregated before the shuffle, so one hot source is one row a task."""
    old, new = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("old_tokens", "new_tokens"))
    op = F.col("op")
    bad = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(bad.cast("int"))
    tokens = F.when(op == "insert", new).when(op == "delete", -old).when(op == "revise", new - old)
    return changes.select(*KEYS, docs.alias("d"), tokens.alias("t")).groupBy(*KEYS).agg(F.sum("d").cast("long").alias("n_docs"), F.sum("t").alias("n_tokens"))


class TokenLedger:
    """A store of committed deltas and rollups under ``path``.

    A delta is written beside the store and renamed into it as the batch's next attempt; the newest attempt counts. Readers list the
    attempts and read just these.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def note(self) -> Row | None:
        """The newest note: version, the rollup's folder, the batches in it as ranges, and which attempt of a batch it holds if not the first."""
        versions = [int(n.removeprefix("version=")) for n in folders(self.spark, f"{self.path}/notes")]
        return self.spark.read.schema(NOTE).parquet(f"{self.path}/notes/version={max(versions)}").first() if versions else None

    def folded(self) -> tuple[int, set[int]]:
        """(version of the rollup, 0 for none; the batches in it)."""
        n = self.note()
        return (n.version, {b for r in n.ranges for b in range(r.first, r.last + 1)}) if n else (0, set())

    def attempts(self) -> dict[int, int]:
        """The newest committed attempt of every batch that has a delta in the store."""
        out: dict[int, int] = {}
        for name in folders(self.spark, f"{self.path}/deltas"):
            batch, _, attempt = name.removeprefix("batch=").partition(".")
            out[int(batch)] = max(int(attempt), out.get(int(batch), 0))
        return out

    def delta(self, *at: tuple[int, int]) -> DataFrame:
        """The deltas of these (batch, attempt)."""
        if not at:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/deltas/batch={b}.{k}" for b, k in at])

    def commit(self, changes: DataFrame, batch_id: int) -> None:
        """Idempotent: what the batch held before counts no more. A crash or a reader in between meets the old delta or the new one."""
        new, note = signed_delta(changes), self.note()
        if note and held(note, batch_id) is not None:
            old = self.delta((batch_id, held(note, batch_id)))
            if not (new.exceptAll(old).isEmpty() and old.exceptAll(new).isEmpty()):
                raise ValueError(f"batch {batch_id} is folded and its delta differs")
            return
        attempt = self.attempts().get(batch_id, -1) + 1
        while not put(new, f"{self.path}/deltas", f"batch={batch_id}.{attempt}"):
            attempt += 1  # another writer of the same batch was first; the last one counts

    def parts(self, note: Row | None, attempts: dict[int, int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(deltas to add, deltas to take away) beside the rollup. A batch committed anew while it was folded is exchanged."""
        own = {b: held(note, b) if note else None for b in attempts}
        return [(b, k) for b, k in attempts.items() if own[b] != k], [(b, k) for b, k in own.items() if k is not None and k != attempts[b]]

    def sums(self, note: Row | None, attempts: dict[int, int]) -> DataFrame:
        more, less = self.parts(note, attempts)
        rows = self.delta(*more).unionAll(self.delta(*less).select(*KEYS, -F.col("n_docs"), -F.col("n_tokens")))
        if note:
            rows = rows.unionAll(self.spark.read.schema(SCHEMA).parquet(f"{self.path}/rollups/{note.rollup}"))
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")

    def fold(self) -> None:
        """Takes the batches committed so far, and no others, into the rollup."""
        note, attempts = self.note(), self.attempts()
        if not any(self.parts(note, attempts)):
            return
        version, rollup = (note.version if note else 0) + 1, uuid.uuid4().hex
        put(self.sums(note, attempts), f"{self.path}/rollups", rollup)
        batches = sorted(set(attempts) | self.folded()[1])
        first = [b for b, before in zip(batches, [None, *batches], strict=False) if before is None or b != before + 1]
        last = [b for b, after in zip(batches, [*batches[1:], None], strict=True) if after is None or b + 1 != after]
        row = (version, rollup, list(zip(first, last, strict=True)), [(b, k) for b, k in attempts.items() if k])
        # of two folds at once one gets the version, the other leaves nothing that counts
        put(self.spark.createDataFrame([row], NOTE).coalesce(1), f"{self.path}/notes", f"version={version}")

    def totals(self) -> DataFrame:
        return self.sums(self.note(), self.attempts())


NOTE = "version long, rollup string, ranges array<struct<first: long, last: long>>, attempts array<struct<batch: long, attempt: long>>"


def held(note: Row, batch: int) -> int | None:
    """The attempt of a batch that a rollup holds, or null."""
    if not any(r.first <= batch <= r.last for r in note.ranges):
        return None
    return next((a.attempt for a in note.attempts if a.batch == batch), 0)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries that were committed under a folder; what is staged begins with a low line."""
    if not exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [x.getPath().getName() for x in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return [n for n in names if not n.startswith("_")]


def vocabulary_counts(documents: DataFrame, path: str, version: str) -> DataFrame:
    """(doc_id, source, lang, ``version``): every text's tokens in a public vocabulary (a ``tokenizers`` file of word pieces), without special ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_bpe_tokens(path)
        for batch in batches:
            for lo, hi, buf, offs in chunks(batch.column("text")):
                rows, n_rows = token_rows(tokens, buf, offs)
                ends = np.concatenate([[0], np.cumsum(tokens.length[rows])])[np.cumsum(np.append(0, n_rows))]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "source", "lang")), pa.array(np.diff(ends).astype(np.int64))], names=["doc_id", "source", "lang", version])

    return documents.select(F.col("doc_id").cast("long"), "source", "lang", F.col("text").cast("string")).mapInArrow(run, f"doc_id long, source string, lang string, `{version}` long")


def counted(documents: DataFrame) -> DataFrame:
    """Every document's count under each of ``TOKENIZERS``, and the estimate that stands in before it is counted."""
    text = F.coalesce("text", F.lit(""))
    counts = [F.regexp_count(text, F.lit(p)).cast("long").alias(v) for v, p in TOKENIZERS.items()]
    return documents.select("doc_id", "source", "lang", F.coalesce(F.floor(F.col("n_chars") / 6), F.lit(0)).cast("long").alias("estimate"), *counts)


def changes(counts: DataFrame, op: str, version: str, old: str | None = None, new: str | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    return counts.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), (F.col(old) if old else none).alias("old_tokens"), (F.col(new) if new else none).alias("new_tokens"))
