"""Periodic runs of words: sparse diagonals of a text against itself.

Two equal words q apart are a step on the diagonal of lag q; consecutive steps add up, and a
diagonal that ends after max(least - q, q) steps or more is a run of period q. Instead of
every earlier occurrence of every word, only those are looked at that a long enough diagonal
must go through: a run with a period of k to 2k - 1 (k = 8, 16, ...) repeats windows of k
words at its own lag (and one with a period under 8 windows of ``least / 2``), so a place takes the
earlier occurrences of its window within that band of lags alone. Windows deep inside a
run of a much smaller period are passed over as later ends: a run that shows only there
would be part of that run. What is left are a few occurrences for each place and band, however
often a word or window is repeated: time is n log n in the words of a text. Diagonals found in
part are drawn out to both ends; those inside a run of a smaller period are not runs of
their own.

Windows are compared by 64-bit hashes; the runs found are verified word by word.

Defined results: a null or empty text has no words, no runs and collapses to the empty text;
repeated rows are rows of their own; an empty table gives no rows; of the columns only doc_id
and text are read. A text is one task's work, and is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.arrays import BASE, U, Sums, chunks, grams, mix, powers, ranges, words

RUN = "struct<start: long, length: long, period: long>"
WORD = "[^\\x20\\x09-\\x0D]+"


class WordSums:
    """Hashes of spans of words in constant time."""

    def __init__(self, w: np.ndarray):
        p, self.q = powers(len(w) + 1)
        self.c = np.zeros(len(w) + 1, U)
        np.cumsum(w * p[: len(w)], out=self.c[1:])

    def raw(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.c[start + n] - self.c[start]) * self.q[start]

    def ahead(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words are equal from a and from b on, at most ``most``."""
        return self.search(most, lambda n: self.raw(a, n) == self.raw(b, n))

    def behind(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words are equal just before a and just before b."""
        return self.search(most, lambda n: self.raw(a - n, n) == self.raw(b - n, n))

    @staticmethod
    def search(most: np.ndarray, equal) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = equal(mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


class Diagonals:
    """Runs of a chunk of documents; words are numbered through, ``first`` is each document's own first."""

    def __init__(self, w: np.ndarray, doc: np.ndarray, n_docs: int, least: int):
        self.w, self.doc, self.least = w, doc, least
        self.first = np.searchsorted(doc, np.arange(n_docs + 1))
        self.sums = WordSums(w)
        none = np.zeros(0, np.int64)
        self.start, self.stop, self.period = none, none, none

    def bands(self) -> Iterator[tuple[int, int, int]]:
        """(words of a window, smallest lag, largest lag)."""
        half = int(np.diff(self.first).max(initial=0)) // 2
        small = min(8, self.least // 2 + 1)
        for q in range(1, min(small, half + 1)):
            yield self.least // 2, q, q
        k = small
        while k <= half:
            yield max(k, self.least - 2 * k + 1), k, min(2 * k - 1, half)
            k *= 2

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, stop, period) of all runs, by start and period."""
        places, length = None, 0
        for k, low, high in self.bands():
            if k != length:
                places, group = self.repeated(places, k)
                length = k
            if len(places):
                self.band(places, group, k, low, high)
        o = np.lexsort((self.period, self.start))
        return self.start[o], self.stop[o], self.period[o]

    def repeated(self, places: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of these places those whose window of k words is in their document again, sorted by window and place; and the window's number."""
        if places is None:
            places = np.arange(len(self.w))
        places = np.sort(places)
        places = places[places + k <= self.first[self.doc[places] + 1]]
        if k <= 16:
            h = grams(self.w, k)[places]
        else:
            h = mix(self.sums.raw(places, np.full(len(places), k)))
        key = mix(h ^ (self.doc[places].astype(U) + U(1)) * BASE)
        o = np.argsort(key, kind="stable")
        key, places = key[o], places[o]
        same = key[1:] == key[:-1]
        again = np.zeros(len(key), bool)
        again[1:] |= same
        again[:-1] |= same
        group = np.cumsum(np.concatenate([[True], ~same])[: len(key)])
        return places[again], group[again]

    def deep(self, k: int) -> np.ndarray:
        """Places whose window of k words lies deep inside a run of a period much below k."""
        d = np.zeros(len(self.w) + 2, np.int64)
        a, b = self.start + self.period, self.stop - k + 1
        of = (3 * self.period + 6 <= k) & (b > a)
        np.add.at(d, a[of], 1)
        np.add.at(d, b[of], -1)
        return np.cumsum(d)[: len(self.w)] > 0

    def band(self, places: np.ndarray, group: np.ndarray, k: int, low: int, high: int) -> None:
        n = len(self.w) + 1
        key = group * n + places
        shallow = ~self.deep(k)[places]
        j, own = places[shallow], group[shallow] * n
        a = np.searchsorted(key, own + np.maximum(j - high, 0))
        b = np.searchsorted(key, own + np.maximum(j - low, -1), side="right")
        count = np.maximum(b - a, 0)
        if not count.any():
            return
        j, lag = np.repeat(j, count), np.repeat(j, count) - places[ranges(a, count)]
        # steps of one diagonal add up as long as they follow one another
        o = np.lexsort((j, lag))
        j, lag = j[o], lag[o]
        begins = np.concatenate([[True], (lag[1:] != lag[:-1]) | (j[1:] != j[:-1] + 1)])
        at = np.flatnonzero(begins)
        steps = np.diff(np.append(at, len(j)))
        j, lag = j[at], lag[at]
        stop = j + steps - 1 + k
        # the diagonal's ends, also beyond windows that were passed over
        start = j - self.sums.behind(j - lag, j, j - lag - self.first[self.doc[j]])
        stop = stop + self.sums.ahead(stop - lag, stop, self.first[self.doc[j] + 1] - stop)
        enough = stop - start >= np.maximum(self.least - lag, lag)
        run = np.unique(np.stack([start - lag, stop, lag], 1)[enough], axis=0)
        run = run[~self.within(run[:, 0], run[:, 1])]
        for name, x in zip(("start", "stop", "period"), run.T, strict=True):
            setattr(self, name, np.concatenate([getattr(self, name), x]))

    def within(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which stretches lie in a run found so far (bands ascend: of a smaller period)."""
        if not len(self.start):
            return np.zeros(len(start), bool)
        o = np.argsort(self.start)
        furthest = np.maximum.accumulate(self.stop[o])
        at = np.searchsorted(self.start[o], start, side="right") - 1
        return (at >= 0) & (furthest[np.maximum(at, 0)] >= stop)


def of_document(data: list[bytes], runs: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], bytes]:
    """Runs whose words are in truth equal one period apart, and the words left once later periods go."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(x, len(number)) for x in data), np.int64, len(data))
    for s, n, q in runs:
        if not np.array_equal(ids[s : s + n - q], ids[s + q : s + n]):
            raise ValueError("two different windows of words share a hash")
    gone = np.zeros(len(data) + 1, np.int64)
    for s, n, q in runs:
        gone[s + q] += 1
        gone[s + n] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    return runs, b" ".join([data[k] for k in kept.tolist()])


def periodic_runs(documents: DataFrame, least: int = 12) -> DataFrame:
    """(doc_id, runs, collapsed): all runs of at least ``least`` words and two periods by start and period, and the text without
    each run's later periods (its words joined by blanks). ``least`` is even and 4 or more."""
    if least < 4 or least % 2:
        raise ValueError("least must be even and 4 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in chunks(batch.column("text")):
                start, end, doc = words(buf, offs)
                d = Diagonals(Sums(buf).spans(start, end), doc, hi - lo, least)
                s, e, q = d.found()
                own = np.searchsorted(s, d.first)
                whole, runs, texts = buf.tobytes(), [], []
                for k in range(hi - lo):
                    data = whole[offs[k] : offs[k + 1]].split()
                    a, b = own[k], own[k + 1]
                    if a == b:
                        runs.append([])
                        texts.append(b" ".join(data))
                        continue
                    rows, text = of_document(data, list(zip((s[a:b] - d.first[k]).tolist(), (e[a:b] - s[a:b]).tolist(), q[a:b].tolist(), strict=True)))
                    runs.append([{"start": x, "length": y, "period": z} for x, y, z in rows])
                    texts.append(text)
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, runs array<{RUN}>, collapsed string")


def with_planted_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, text): for one document in ten (by the checksum of its doc_id) the words from a place on repeat the first few there.

    With h the unsigned crc32 of the decimal doc_id and g = h div 10: if h mod 10 = 0 and there are n > 0 words, each word i >= a
    becomes word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Null ids and texts stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    ws = F.expr(f"regexp_extract_all(text, '{WORD.replace(chr(92), chr(92) * 2)}', 0)")
    g, n = F.floor(h / 10), F.size(ws)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(ws, a + 1, p), F.ceil((n - a) / p).cast("int")))
    text: Column = F.array_join(F.concat(F.slice(ws, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("doc_id", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))
