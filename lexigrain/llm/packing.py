"""Best-fit packing of token pieces into sequences, after dominance reduction.

Documents become token ids plus one closing id; longer ones than a sequence are cut
into full pieces and a rest. Pieces of one length are alike, so the instance is the
count of pieces per length: at most ``capacity`` numbers, however large the corpus.
The driver plans over those counts: dominance steps fix sets of one or two lengths that
provably lose nothing, then best fit decreasing packs the remainder, each step for all
alike pieces at once. Pieces then get their place by their rank among their length,
taken in hash buckets so that a length with a third of all rows is spread out.

Defined results: a null or empty text is one piece with the closing id alone; repeated
rows are pieces of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.arrays import chunks, words
from lexigrain.llm.shared import written
from lexigrain.llm.vocab import WordTokens, only, word_bpe_tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_rows(tokens: WordTokens, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``tokens`` for all words of a chunk, and how many each document has.

    The vocabulary is lower case and cuts a mark off the letters before it, so words
    are looked up in lower case (unless a special token's spelling may be there), and a
    closing comma or stop after a letter as a word of its own: the same ids from fewer
    different words.
    """
    start, end, doc = words(buf, offs)
    data = buf.tobytes()
    data = data if b"<|" in data else data.lower()
    last, before, lead = buf[end - 1], buf[np.maximum(end - 2, 0)], buf[np.maximum(end - 3, 0)]
    letter = ((before | 0x20) >= 97) & ((before | 0x20) <= 122)
    letter |= (end - start > 2) & (lead == 0xC3) & (before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7)  # À to ÿ
    mark = ((last == 44) | (last == 46)) & (end - start > 1) & letter
    n = len(data)
    rows = tokens.rows_of(data + b",.", np.append(start, [n, n + 1]), np.append(end - mark, [n + 1, n + 2]))
    comma, stop = rows[-2:]
    out = np.repeat(rows[:-2], 1 + mark)
    own = np.cumsum(1 + mark)[mark] - 1
    out[own] = np.where(last[mark] == 44, comma, stop)
    return out, np.bincount(doc, weights=1 + mark, minlength=len(offs) - 1).astype(np.int64)


def token_pieces(documents: DataFrame, path: str, capacity: int = 2048, closing_id: int = 0) -> DataFrame:
    """One row per piece, without the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(word_bpe_tokens)
        tokens = word_bpe_tokens(path)
        for batch in batches:
            doc = batch.column("doc_id")
            for lo, hi, buf, offs in chunks(batch.column("text")):
                rows, n_rows = token_rows(tokens, buf, offs)
                ids = tokens.tokens(rows).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(tokens.length[rows])])[np.cumsum(np.append(0, n_rows))]
                at, piece, start, length, crc = [], [], [], [], []
                for k in range(hi - lo):
                    own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(closing_id)).astype("<u4")
                    for i, s in enumerate(range(0, len(own), capacity)):
                        cut = own[s : s + capacity]
                        at.append(lo + k)
                        piece.append(i)
                        start.append(s)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix sets that dominate every alternative; what is left comes back as counts.

    For a length i, let k be the longest other piece that fits beside it. {i} dominates
    if nothing fits. {i, k} dominates every set with i if k fills it exactly (the rest of
    any such set fits in k's room), or if no two others fit beside i together (the rest
    is one piece, at most k).
    """
    left = {n: c for n, c in counts.items() if c}
    fixed: list[tuple[tuple[int, ...], int]] = []
    for i in sorted(left, reverse=True):
        while left.get(i):
            have = sorted(left)
            others = [n for n in have if n != i or left[n] > 1]
            fits = [n for n in others if i + n <= capacity]
            if not fits:
                fixed.append(((i,), left.pop(i)))
                break
            k = fits[-1]
            two = [n for n in have for _ in range(min(2, left[n] - (n == i)))][:2]
            if i + k != capacity and len(two) == 2 and i + sum(two) <= capacity:
                break
            # the shortest others only grow as pieces go, so this holds until i or k runs out
            n = left[i] // 2 if i == k else min(left[i], left[k])
            fixed.append(((i, k), n))
            for x in (i, k):
                left[x] -= n
            left = {a: c for a, c in left.items() if c}
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over alike pieces: (lengths in a sequence, number of such sequences)."""
    open_by: dict[int, list[list]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_by if r >= size), default=None)
            if room is None:
                each = capacity // size
                full, rest = divmod(left, each)
                for k, n in ((each, full), (rest, 1)):
                    if k and n:
                        open_by.setdefault(capacity - k * size, []).append([(size,) * k, n])
                break
            group = open_by[room].pop()
            if not open_by[room]:
                del open_by[room]
            # each sequence takes as many as fit before the next one is the fuller choice
            each = room // size
            full = min(left // each, group[1])
            if full:
                open_by.setdefault(room - each * size, []).append([group[0] + (size,) * each, full])
                left -= full * each
            else:
                open_by.setdefault(room - left * size, []).append([group[0] + (size,) * left, 1])
                full, left = 1, 0
            if group[1] > full:
                open_by.setdefault(room, []).append([group[0], group[1] - full])
    return [(tuple(p), n) for groups in open_by.values() for p, n in groups]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    fixed, left = dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted: where each rank of a length goes."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for size in lengths:
            out.append((size, used.get(size, 0), sequence, offset))
            used[size] = used.get(size, 0) + n
            offset += size
        sequence += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(documents: DataFrame, path: str, capacity: int = 2048, closing_id: int = 0) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``."""
    spark = documents.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = written(token_pieces(documents, path, capacity, closing_id), "pieces")
    # at most `capacity` rows
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    where = slots(plan(counts, capacity))

    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    first = (
        dealt.groupBy("length", "bucket").count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    )
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("n", F.row_number().over(order)).join(first, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("n") - 1)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = (where[:, 0] << 44) + where[:, 1]
        for f in frames:
            size, rank = f["length"].to_numpy(np.int64), f["rank"].to_numpy(np.int64)
            k = np.searchsorted(keys, (size << 44) + rank, side="right") - 1
            f["sequence_id"] = where[k, 2] + rank - where[k, 1]
            f["offset"] = where[k, 3]
            yield f[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, PIECES + ", sequence_id long, offset long")
