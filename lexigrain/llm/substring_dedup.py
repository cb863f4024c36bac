"""Removal of word windows that an earlier document already has, by level-wise doubling.

Levels are window lengths, each at most twice the one before, up to ``window``. At the
first, every window of the full length names one of its sub-windows of base length (the
one with the least hash), so equal windows name equal sub-windows and only about one
word in four starts a row. Sub-windows that stand in one document alone end there;
windows whose named sub-window is repeated go on to the next length, and so on until
no candidate is left or the full length is reached. There, a window is removed if a
document with a smaller doc_id has it too.

Rows are hash and document only, first combined in each batch: one row per hash goes into
the shuffle, however many copies a batch holds, and what a batch already proves is sent
on under a key of its own. Answers are hashes as well; a document finds their places anew.

Defined results: null or empty texts have no words; rows with a null doc_id are returned
and take no part; rows that share a doc_id do not remove each other's words; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.arrays import BASE, U, chunks, covered, grams, mix, words, Sums
from lexigrain.llm.windows import leftmost_least, lists, signed

#: ``proved`` is a hash that needs no more comparing; ``key`` is then one that meets no other.
ROWS = "key long, doc_id long, proved long"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def lengths(window: int, base: int) -> list[int]:
    out = [window]
    while out[0] > base:
        out.insert(0, max(base, -(-out[0] // 2)))
    return out


class Chunk:
    """Words of a chunk of documents, and which windows of the full length lie in one document."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, window: int, base: int):
        self.window, self.base = window, base
        self.start, self.end, self.doc = words(buf, offs)
        self.w = Sums(buf).spans(self.start, self.end)
        self.n_words = np.bincount(self.doc, minlength=len(offs) - 1)
        self.first = np.cumsum(self.n_words) - self.n_words
        n = len(self.w) - window + 1
        self.valid = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def named(self) -> np.ndarray:
        """For each valid window: place of its named sub-window."""
        return leftmost_least(grams(self.w, self.base), self.window - self.base + 1)[self.valid]

    def among(self, at: np.ndarray, length: int, answers: list[np.ndarray]) -> np.ndarray:
        """Which of the windows at these places their own document's answers name."""
        n = [len(x) for x in answers]
        if not sum(n):
            return np.zeros(len(at), bool)
        has = np.array(n) > 0
        out = has[self.doc[at]]
        own = U(1) + np.arange(len(n)).astype(U)
        ask = mix(grams(self.w, length)[at[out]] ^ own[self.doc[at[out]]] * BASE)
        out[out] = np.isin(ask, mix(np.concatenate(answers).view(U) ^ np.repeat(own, n) * BASE))
        return out


def emitted(h: np.ndarray, doc: np.ndarray, last: bool) -> pa.RecordBatch:
    """A batch's rows: for each hash the witness with the smallest document, and what the batch proves.

    Before the last level a hash with two documents is proved for all of them; at the
    last, for all but the smallest.
    """
    o = np.lexsort((doc, h))
    h, doc = h[o], doc[o]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
    new = new_h | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(h)]
    h, doc, first = h[new], doc[new], new_h[new]
    later = ~first
    proved = later.copy()
    if not last:
        proved[:-1] |= later[1:]
    key = np.concatenate([h[first], mix(h[proved] ^ mix(doc[proved].astype(U)))])
    answer = pa.array(np.concatenate([h[first], h[proved]]).view(np.int64), mask=np.arange(len(key)) < int(first.sum()))
    return pa.RecordBatch.from_arrays([signed(key), pa.array(np.concatenate([doc[first], doc[proved]])), answer], names=["key", "doc_id", "proved"])


def level_rows(docs: DataFrame, window: int, base: int, length: int, before: int | None) -> DataFrame:
    """Rows of one level; ``before`` is the length whose ``answers`` the documents carry, none at the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("doc_id" if before is None else "answers").is_valid())
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            answers = None if before is None else lists(batch.column("answers"))
            found: list[list[np.ndarray]] = [[], []]
            for lo, hi, buf, offs in chunks(batch.column("text")):
                c = Chunk(buf, offs, window, base)
                if before is None:
                    at = np.unique(c.named())
                elif before == base:
                    named = c.named()
                    places, where = np.unique(named, return_inverse=True)
                    at = c.valid[c.among(places, base, answers[lo:hi])[where]]
                else:
                    at = c.valid[c.among(c.valid, before, answers[lo:hi])]
                found[0].append(grams(c.w, length)[at])
                found[1].append(ids[lo + c.doc[at]])
            if found[0]:
                yield emitted(*map(np.concatenate, found), last=length == window)

    return docs.mapInArrow(run, ROWS)


def answered(rows: DataFrame, last: bool) -> DataFrame:
    """(doc_id, answers): hashes that another document has too (at the last level: a smaller one)."""
    w = Window.partitionBy("key")
    rows = rows.withColumn("least", F.min("doc_id").over(w))
    if last:
        rows = rows.filter("proved is not null or doc_id > least")
    else:
        rows = rows.withColumn("most", F.max("doc_id").over(w)).filter("proved is not null or most > least")
    # at most a document's own windows
    return rows.select("doc_id", F.coalesce("proved", "key").alias("h")).groupBy("doc_id").agg(F.collect_list("h").alias("answers"))


def remove_repeats(documents: DataFrame, window: int = 13, base: int = 7) -> DataFrame:
    """``RESULT`` per row of ``documents``."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    levels = lengths(window, base)
    base, before = levels[0], None
    carried = docs
    for n in levels:
        found = answered(level_rows(carried, window, base, n, before), last=n == window)
        carried, before = docs.join(found, "doc_id", "left"), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = lists(batch.column("answers"))
            for lo, hi, buf, offs in chunks(batch.column("text")):
                c = Chunk(buf, offs, window, base)
                gone = covered(len(c.w), c.valid[c.among(c.valid, window, answers[lo:hi])], window)
                removed = np.bincount(c.doc[gone], minlength=hi - lo)
                data, sha = buf.tobytes(), []
                for d in range(hi - lo):
                    if removed[d]:
                        k = np.arange(c.first[d], c.first[d] + c.n_words[d])
                        k = k[~gone[k]]
                        kept = [data[a:b] for a, b in zip(c.start[k].tolist(), c.end[k].tolist(), strict=True)]
                    else:
                        kept = data[offs[d] : offs[d + 1]].split()
                    sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(c.n_words), pa.array(removed), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return carried.mapInArrow(run, RESULT)
