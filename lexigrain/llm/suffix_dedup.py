"""Removal of repeated byte strings with a sparse suffix array.

Sorting every suffix would move each document hundreds of times over, so the array holds
the suffixes at named places only: of every string of ``length`` bytes, the place among
its first ``width`` with the least hash of eight bytes. Equal strings name the same place,
so a repeat shows up among the suffixes at named places, about 1.5 % of all for the usual
128. Any string that names a place m holds the ``length - width + 1`` bytes from m on, its
core; the strings of one place differ in how many bytes before m and after the core they
take, and are found again from the ``width - 1`` bytes on either side.

1. Suffixes whose core occurs once end there (one hash a suffix; equal ones of a batch are
   combined before the shuffle).
2. The others become rows (core, right bytes, left bytes). ``repartitionByRange`` samples
   splitters and deals them out by leading token, the core's fingerprint, then the bytes
   after it, so that even one hot core is cut into ranges.
3. Each bucket sorts its rows by multikey quicksort over eight-byte words and compares
   strings of equal core. The first and the last core of a bucket may go on beyond it:
   their strings that stand alone here are compared across the boundaries by hash.

Texts are shuffled only where they have suffixes of the array, and at the end only where they
have repeats (a bit field of their ids tells most others, which are judged where they are read).
Each step is written before the next, and its shuffles are taken away.

Equality of cores rests on two independent 64-bit hashes, that of the bytes around them on
their comparison (within a bucket) or on hashes of both (across buckets).

Defined results: null or empty texts have no bytes; a row with a null doc_id takes part
like any other; repeated rows are documents of their own and match each other; matches
never cross documents; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.arrays import BASE, U, Sums, byte_table, chunks, mix, powers
from lexigrain.llm.ngram_join import only_marked, parted
from lexigrain.llm.shared import no_shuffles_left, written
from lexigrain.llm.windows import POS_BITS, firsts, gathered, leftmost_least, lists, own_place, row_marks, second_hash, signed

NAME_BYTES = 8
SECOND = mix(byte_table() ^ U(0x2545F4914F6CDD1D))
ROWS = "h long, salt long, doc_id long, place long, proved boolean"
SUFFIXES = "core long, core_2 long, right binary, left binary, low int, high int, doc_id long, place long"
#: A string is (place, number of strings from there on): runs that start one after the other.
FOUND = "h long, doc_id long, place long, n int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Rows of one bucket, about 150 MB, and of the slices that it is compared in.
BUCKET_ROWS, SLICE_ROWS = 250_000, 16_000


class Chunk:
    """The named places of a chunk of documents and the strings that name them."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int, width: int):
        self.buf, self.offs, self.core = buf, offs, length - width + 1
        self.sums = Sums(buf)
        self.marks = row_marks(buf, offs, self.sums)
        n = len(buf) - length + 1
        if n <= 0:
            self.at = self.low = self.high = self.doc = np.zeros(0, np.int64)
            return
        starts = np.arange(len(buf) - NAME_BYTES + 1)
        named = leftmost_least(self.sums.spans(starts, starts + NAME_BYTES), width)[:n]
        ends = np.repeat(offs[1:], np.diff(offs))[:n]
        ok = np.flatnonzero(np.arange(n) + length <= ends)
        named = named[ok]
        # strings that name one place start one after the other
        new = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1]])) if len(named) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(named))[: len(new)] - 1
        self.at, first, final = named[new], ok[new], ok[last]
        #: how many bytes before the place the strings take
        self.low, self.high = self.at - final, self.at - first
        self.doc = np.searchsorted(offs, self.at, side="right") - 1

    def cores(self) -> np.ndarray:
        return self.sums.spans(self.at, self.at + self.core)

    def second_cores(self) -> np.ndarray:
        return Sums(self.buf, SECOND).spans(self.at, self.at + self.core)

    def place(self, k: np.ndarray) -> np.ndarray:
        d = self.doc[k]
        return (self.marks[d] << POS_BITS) | (self.at[k] - self.offs[d])


def first_pass(docs: DataFrame, length: int, width: int) -> DataFrame:
    """One row per core and batch to compare; the other suffixes of a core that a batch repeats are proved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            found: list[list[np.ndarray]] = [[], [], []]
            for lo, _hi, buf, offs in chunks(batch.column("text")):
                c = Chunk(buf, offs, length, width)
                for x, y in zip(found, (c.cores(), ids[lo + c.doc], c.place(np.arange(len(c.at)))), strict=True):
                    x.append(y)
            if found[0]:
                h, d, p = map(np.concatenate, found)
                o, first, again = firsts(h, d, p)
                salt = np.where(first, 0, p[o] ^ (d[o] << 20) | 1)
                yield pa.RecordBatch.from_arrays([signed(h[o]), *(pa.array(x) for x in (salt, d[o], p[o], again))], names=["h", "salt", "doc_id", "place", "proved"])

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


def suffixes(docs: DataFrame, candidates: DataFrame, length: int, width: int) -> DataFrame:
    """The rows of the sparse suffix array: ``right`` and ``left`` (read backwards) hold up to ``width - 1`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = batch.column("doc_id").to_numpy(zero_copy_only=False), lists(batch.column("places"))
            for lo, hi, buf, offs in chunks(batch.column("text")):
                c = Chunk(buf, offs, length, width)
                flag = np.zeros(len(buf) + 1, bool)
                for d in range(hi - lo):
                    flag[offs[d] + own_place(places[lo + d], int(c.marks[d]))] = True
                k = np.flatnonzero(flag[c.at])
                if not len(k):
                    continue
                at, low, high, d = c.at[k], c.low[k], c.high[k], c.doc[k]
                data, back = buf.tobytes(), buf[::-1].tobytes()
                end = at + c.core
                # what any of these strings takes, no more
                right = [data[a:b] for a, b in zip(end.tolist(), (end + width - 1 - low).tolist(), strict=True)]
                n = len(buf)
                left = [back[a:b] for a, b in zip((n - at).tolist(), (n - at + high).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [signed(c.cores()[k]), signed(c.second_cores()[k]), pa.array(right, pa.binary()), pa.array(left, pa.binary()), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(ids[lo + d].astype(np.int64)), pa.array(c.place(k))],
                    names=[x.split()[0] for x in SUFFIXES.split(", ")],
                )

    return only_marked(docs.select("doc_id", "text"), candidates).join(candidates, "doc_id").mapInArrow(run, SUFFIXES)


def padded(column: list[bytes], width: int) -> np.ndarray:
    """Rows of ``width`` bytes, zeros behind."""
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in column), np.uint8).reshape(len(column), width)


def multikey_sort(keys: np.ndarray) -> np.ndarray:
    """Order of rows of words: three-way partition by a pivot word; only the equal part goes on to the next word."""
    out = np.arange(len(keys))
    todo = [(0, len(keys), 0)]
    while todo:
        lo, hi, word = todo.pop()
        while hi - lo > 1 and word < keys.shape[1]:
            part = out[lo:hi]
            x = keys[part, word]
            if hi - lo <= 64:  # few rows: all remaining words at once
                out[lo:hi] = part[np.lexsort(keys[part, word:].T[::-1])]
                break
            pivot = np.partition(x, len(x) // 2)[len(x) // 2]
            less, more = x < pivot, x > pivot
            equal = ~(less | more)
            out[lo:hi] = np.concatenate([part[less], part[equal], part[more]])
            a, b = lo + int(less.sum()), hi - int(more.sum())
            todo += [(lo, a, word), (b, hi, word)]
            lo, hi, word = a, b, word + 1
    return out


def context_hashes(side: np.ndarray) -> np.ndarray:
    """For each row the hashes of its first 0, 1, ... bytes."""
    p, _ = powers(side.shape[1] + 1)
    table = mix(np.arange(1, 257, dtype=U) * BASE)
    out = np.zeros((side.shape[0], side.shape[1] + 1), U)
    np.cumsum(table[side] * p[: side.shape[1]], axis=1, out=out[:, 1:])
    return out


def repeats(core: np.ndarray, r: np.ndarray, lf: np.ndarray, low: np.ndarray, high: np.ndarray, copies: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted rows, each with its number of copies: (does string [row, bytes before] repeat, does it ask across boundaries, its hash)."""
    group = np.cumsum(np.concatenate([[True], core[1:] != core[:-1]])) - 1
    edge = (group == 0) | (group == group[-1])
    hr, hl = context_hashes(r[:, : width - 1]), context_hashes(lf[:, : width - 1])
    seen, ask = np.zeros((len(core), width), bool), np.zeros((len(core), width), bool)
    asked = np.zeros((len(core), width), U)
    own = second_hash(core)
    several = np.bincount(group)[group] > 1
    for before in range(width):
        k = np.flatnonzero((low <= before) & (before <= high) & (several | edge | (copies > 1)))
        h = mix(own[k] + mix(hl[k, before] + U(before)) * BASE + second_hash(hr[k, width - 1 - before]))
        o = np.argsort(h, kind="stable")
        same = h[o][1:] == h[o][:-1]
        again = copies[k] > 1
        again[o[1:][same]] = again[o[:-1][same]] = True
        seen[k, before] = again
        first = np.zeros(len(k), bool)
        first[o[np.concatenate([[True], ~same])[: len(k)]]] = True
        e = first & edge[k]  # one witness of each string
        ask[k[e], before], asked[k[e], before] = True, h[e]
    return seen, ask, asked


def compared(rows: DataFrame, width: int) -> DataFrame:
    """``FOUND``: runs of repeated strings (h null), and strings of boundary cores by hash.

    A bucket is sorted as a whole and compared in slices, so memory does not follow the
    hottest core; a core cut by a slice is treated like one cut by a bucket.
    """
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)  # a bucket: bounded by the number of ranges
        if not sum(x.num_rows for x in got):
            return
        t = pa.Table.from_batches(got)
        core, core_2, low, high, doc, place = (t.column(n).to_numpy().astype(np.int64) for n in ("core", "core_2", "low", "high", "doc_id", "place"))
        r, lf = (padded(t.column(n).to_pylist(), width) for n in ("right", "left"))
        keys = np.concatenate([(core.view(U) ^ U(1 << 63))[:, None], (core_2.view(U) ^ U(1 << 63))[:, None], r.view(">u8").astype(U), lf.view(">u8").astype(U), (low << 32 | high).view(U)[:, None]], axis=1)
        o = multikey_sort(keys)  # cores in the order of the ranges: signed
        new = np.concatenate([[True], (keys[o[1:]] != keys[o[:-1]]).any(axis=1)])
        kind, heads = np.cumsum(new) - 1, o[new]
        copies = np.bincount(kind)
        core, low, high, r, lf = mix(core[heads].view(U) ^ mix(core_2[heads].view(U))), low[heads], high[heads], r[heads], lf[heads]
        for a in range(0, len(heads), SLICE_ROWS):
            z = min(a + SLICE_ROWS, len(heads))
            seen, ask, asked = repeats(core[a:z], r[a:z], lf[a:z], low[a:z], high[a:z], copies[a:z], width)
            lo, hi = np.searchsorted(kind, [a, z])
            own = o[lo:hi]
            # a string that takes b bytes before its place starts at place - b
            rev = np.zeros((hi - lo, width + 2), np.int8)
            rev[:, 1:-1] = seen[kind[lo:hi] - a, ::-1]
            step = np.diff(rev, axis=1)
            row, first = np.nonzero(step == 1)
            last = np.nonzero(step == -1)[1]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(row), pa.int64()), pa.array(doc[own[row]]), pa.array(place[own[row]] - (width - 1 - first)), pa.array((last - first).astype(np.int32))], names=names)
            row, before = np.nonzero(ask)
            k = heads[a + row]
            yield pa.RecordBatch.from_arrays([signed(asked[row, before]), pa.array(doc[k]), pa.array(place[k] - before), pa.array(np.ones(len(row), np.int32))], names=names)

    return rows.mapInArrow(run, FOUND)


def remove_repeats(documents: DataFrame, length: int = 400, width: int = 128) -> DataFrame:
    """``RESULT`` per row: every byte under a string of ``length`` bytes that starts anywhere else too is removed."""
    if width % 8 or not NAME_BYTES < width <= length // 2:
        raise ValueError("width: a multiple of 8, at most half the length")
    spark = documents.sparkSession
    own, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    # rows without an id go by their text
    docs = documents.select(F.coalesce(own, F.xxhash64(text)).alias("doc_id"), text.alias("text"), own.alias("own_id"))
    w = Window.partitionBy("h", "salt")
    with no_shuffles_left(spark):
        rows = first_pass(docs, length, width).withColumn("n", F.count("*").over(w)).filter("proved or n > 1")
        candidates = written(gathered(rows.select("doc_id", "place")), "candidates")
        rows = written(suffixes(docs, candidates, length, width), "suffixes")
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // BUCKET_ROWS + 1)
        dealt = rows.repartitionByRange(ranges, "core", "core_2", "right", "left", "doc_id", "place")
        found = written(compared(dealt, width), "repeats")
        across = found.filter("h is not null").withColumn("c", F.count("*").over(Window.partitionBy("h"))).filter("c > 1")
        runs = found.filter("h is null").select("doc_id", "place", "n").unionAll(across.select("doc_id", "place", "n"))
        runs = runs.groupBy("doc_id").agg(F.collect_list("place").alias("places"), F.collect_list(F.col("n").cast("long")).alias("counts"))
        runs = written(runs, "runs")
        repeating, others = parted(docs, runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, counts = lists(batch.column("places")), lists(batch.column("counts"))
            for lo, hi, buf, offs in chunks(batch.column("text")):
                marks = row_marks(buf, offs)
                removed, spans, sha = [], [], []
                for d in range(hi - lo):
                    text, p = buf[offs[d] : offs[d + 1]], places[lo + d]
                    gone = np.zeros(len(text), bool)
                    if len(p):
                        own = p >> POS_BITS == marks[d]
                        start, n = own_place(p, int(marks[d])), counts[lo + d][own]
                        diff = np.zeros(len(text) + 1, np.int32)
                        np.add.at(diff, start, 1)
                        np.add.at(diff, start + n - 1 + length, -1)
                        gone = np.cumsum(diff)[: len(text)] > 0
                    removed.append(int(gone.sum()))
                    spans.append(int((gone[1:] & ~gone[:-1]).sum() + (gone[:1]).sum()))
                    sha.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("own_id").slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                    names=[x.split()[0] for x in RESULT.split(", ")],
                )

    # texts without a repeat are judged where they are read
    none = F.lit(None).cast("array<long>")
    others = others.withColumns({"places": none, "counts": none})
    return repeating.join(runs, "doc_id", "left").unionByName(others).mapInArrow(run, RESULT)
