"""Benchmark decontamination by spaced seeds.

A mask such as ``1101011`` hashes the tokens under its ones and ignores those under its
zeros. Hashes of all masks at all places of the benchmark items are equi-joined with those
of the documents; around each hit the item is laid over the document on the hit's diagonal,
and a document is contaminated by the item if some stretch of ``span`` tokens agrees in
all but ``max(substitutions)`` places (for an item shorter than ``span``: the whole
item, exactly). ``MASKS`` hit every pattern of up to two substitutions in
thirteen tokens, so none such is missed (a test enumerates them). Agreement is decided on
the tokens themselves.

Before the join, a bit field of the benchmark's hashes, of at most ``MOST_BITS`` bits
whatever the benchmark's size, sorts out the documents' hashes that no item has; a field
that is too full lets more of them pass to the join, which is exact. Documents without any
such hash end there.

Tokens are words (runs without ASCII white space) in ASCII lower case, without ASCII
punctuation at either end; a word of punctuation alone stays as it is. Items under
``min_tokens`` tokens say too little to tell and are left out: this is the rule, at every
size of the tables; items from there to ``span`` - 1 tokens count only as a whole.

Defined results: null or empty texts and items match nothing; repeated rows are reported
each; an item given twice is one; an empty benchmark or table gives no rows; of stretches
with equally many matched tokens the first in the document is reported; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.arrays import BASE, LOWER, U, Sums, chunks, mix, words
from lexigrain.llm.shared import written
from lexigrain.llm.vocab import only

SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, n_tokens long, n_matched long, n_hits long"
#: Weight 6; every pattern of up to two substitutions in thirteen tokens leaves one of them whole somewhere.
MASKS = ("11101011", "11001111")
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PUNCT = np.zeros(256, bool)
PUNCT[list(PUNCTUATION)] = True
#: Bits of the field per hash of the benchmark, and at most (8 MB, sent to every task).
BITS_EACH, MOST_BITS = 64, 1 << 26
PROBES = 3


def token_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every token."""
    start, end, doc = words(buf, offs)
    a, z = start.copy(), end.copy()
    left = np.arange(len(a))
    while len(left := left[PUNCT[buf[a[left]]]]):
        a[left] += 1
        left = left[a[left] < z[left]]
    left = np.flatnonzero(a < z)
    while len(left := left[PUNCT[buf[z[left] - 1]]]):
        z[left] -= 1
    alone = a >= z
    return np.where(alone, start, a), np.where(alone, end, z), doc


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask at every place (places that cross documents included)."""
    n = len(tokens) - len(mask) + 1
    h = np.full(max(n, 0), U(len(mask)), U)
    if n > 0:
        for j, m in enumerate(mask):
            h *= BASE
            if m == "1":
                h += tokens[j : j + n]
    return mix(h ^ U(int(mask, 2)))


def inside(doc: np.ndarray, length: int) -> np.ndarray:
    """Places from which ``length`` tokens stay in one document."""
    n = len(doc) - length + 1
    return doc[:n] == doc[length - 1 :] if n > 0 else np.zeros(0, bool)


def tokens_of(text: str) -> list[bytes]:
    data = (text or "").encode()
    start, end, _ = token_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    low = data.lower()
    return [low[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def chunk_seeds(buf: np.ndarray, offs: np.ndarray, masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, place in it) for all masks."""
    start, end, doc = token_spans(buf, offs)
    t = Sums(buf, LOWER).spans(start, end)
    n = np.bincount(doc, minlength=len(offs) - 1)
    first = np.cumsum(n) - n
    out = []
    for m in masks:
        ok = np.flatnonzero(inside(doc, len(m)))
        out.append((seeds(t, m)[ok], doc[ok], ok - first[doc[ok]]))
    h, d, p = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, d, p


def seed_rows(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(h, item, item_place) of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _hi, buf, offs in chunks(batch.column("item_text")):
                h, d, p = chunk_seeds(buf, offs, masks)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("item").take(pa.array(lo + d)), pa.array(p)], names=["h", "item", "item_place"])

    return items.select("item", "item_text").mapInArrow(run, "h long, item long, item_place long")


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([(mix(h + U(k)) % U(bits)).astype(np.int64) for k in range(PROBES)])


def bit_field(known: DataFrame, bits: int) -> np.ndarray:
    """A field of ``bits`` bits with those of every hash set: partial fields meet by bit-wise or."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.zeros(bits, bool)
        for b in batches:
            field[slots(b.column("h").to_numpy().view(U), bits).ravel()] = True
        words_ = np.packbits(field).view(np.int64)
        k = np.flatnonzero(words_)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(words_[k])], names=["k", "word"])

    # at most bits / 64 rows
    rows = known.select("h").mapInArrow(run, "k long, word long").groupBy("k").agg(F.bit_or("word").alias("word")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["k"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64)
    return out


def suspects(docs: DataFrame, field: np.ndarray, masks: tuple[str, ...]) -> DataFrame:
    """(doc_id, text, seeds) of the documents that have any hash whose bits are all set."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    bits = 64 * len(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        f = sent.value.view(np.uint8)
        for batch in batches:
            for lo, hi, buf, offs in chunks(batch.column("text")):
                h, d, p = chunk_seeds(buf, offs, masks)
                for at in (mix(h + U(k)) % U(bits) for k in range(PROBES)):
                    ok = (f[(at >> U(3)).astype(np.int64)] >> (U(7) - (at & U(7))).astype(np.uint8)) & 1 == 1
                    keep = np.flatnonzero(ok)
                    h, d, p = h[keep], d[keep], p[keep]  # later probes look at what is left
                if not len(h):
                    continue
                o = np.argsort(d, kind="stable")
                h, d, p = h[o], d[o], p[o]
                own = np.unique(d)
                ends = np.searchsorted(d, own, side="right").astype(np.int32)
                rows = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(p)], names=["h", "place"])
                at = pa.array(lo + own)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text").take(at), pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), ends)), rows)], names=["doc_id", "text", "seeds"])

    return docs.mapInArrow(run, "doc_id long, text string, seeds array<struct<h:bigint,place:bigint>>")


def best_stretch(doc: list[bytes], item: list[bytes], first: int, span: int, substitutions: int) -> tuple[int, int, int, int] | None:
    """Best stretch with the item's first token at document place ``first``: (document place, item place, tokens, matched)."""
    length = min(span, len(item))
    allowed = substitutions if len(item) >= span else 0
    a, z = max(first, 0), min(first + len(item), len(doc))
    if z - a < length:
        return None
    same = [x == y for x, y in zip(doc[a:z], item[a - first : z - first], strict=True)]
    c = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(c[length:] - c[:-length] >= length - allowed)
    if not len(good):
        return None
    s, e = int(good[0]), int(good[-1]) + length
    return a + s, a + s - first, e - s, int(c[e] - c[s])


def verified(candidates: DataFrame, span: int, substitutions: int) -> DataFrame:
    """``SCHEMA`` from (row, doc_id, text, item, item_id, item_text, diagonals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens, items = None, [], {}
        for batch in batches:
            out = []
            for row, doc_id, text, item, item_id, item_text, diagonals in zip(*(batch.column(c).to_pylist() for c in CANDIDATE), strict=True):
                if row != last:
                    last, tokens = row, tokens_of(text)
                if item not in items:
                    if len(items) > 1000:
                        items.clear()
                    items[item] = tokens_of(item_text)
                got, hits = [], 0
                for x in diagonals:
                    if found := best_stretch(tokens, items[item], x["first"], span, substitutions):
                        got.append(found)
                        hits += x["hits"]
                if got:
                    out.append((doc_id, item_id, *min(got, key=lambda g: (-g[3], g[0])), hits))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return candidates.select(*CANDIDATE).mapInArrow(run, SCHEMA)


CANDIDATE = ["row", "doc_id", "text", "item", "item_id", "item_text", "diagonals"]


def contaminated(documents: DataFrame, benchmark: DataFrame, span: int = 13, substitutions: int = 2, min_tokens: int = 8, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """A row per document and item that it contains, with the first best place: ``SCHEMA``."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("item_text")).filter("item_id is not null and item_text is not null").distinct()
    items = items.filter(F.regexp_count("item_text", F.lit(r"[^\x20\x09-\x0D]+")) >= min_tokens)
    items = written(items.withColumn("item", F.monotonically_increasing_id()), "benchmark-items")
    known = written(seed_rows(items, masks), "benchmark-seeds")
    bits = min(MOST_BITS, max(1 << 16, 1 << int(np.ceil(np.log2(known.count() * BITS_EACH + 1)))))
    # numbered, then written: the numbers stay
    found = written(suspects(docs, bit_field(known, bits), masks).withColumn("row", F.monotonically_increasing_id()), "suspects")
    hits = found.select("row", F.explode("seeds").alias("s")).select("row", "s.h", "s.place").join(known, "h")
    per = hits.groupBy("row", "item", (F.col("place") - F.col("item_place")).alias("first")).agg(F.count("*").alias("hits"))
    # at most as many diagonals as document and item have tokens
    per = per.groupBy("row", "item").agg(F.collect_list(F.struct("first", "hits")).alias("diagonals"))
    return verified(per.join(items, "item").join(found.select("row", "doc_id", "text"), "row").sortWithinPartitions("row"), span, substitutions)
