"""What the two substring operators share: row keys, first occurrences and covered runs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.arrays import U, Sums, mix

POS_BITS = 38


def own_place(places: np.ndarray, mark: int) -> np.ndarray:
    """Of the places gathered for a doc_id, those of the row with this mark."""
    return places[places >> POS_BITS == mark] & ((1 << POS_BITS) - 1)


def row_marks(buf: np.ndarray, offs: np.ndarray, sums: Sums | None = None) -> np.ndarray:
    """24 bits of each text's hash: rows of one doc_id with different texts stay apart. Places carry it above POS_BITS."""
    h = (sums or Sums(buf)).spans(offs[:-1], offs[1:])
    return (h >> U(40)).astype(np.int64)


def leftmost_least(h: np.ndarray, w: int) -> np.ndarray:
    """For each i: place of the leftmost least of h[i], ..., h[i + w - 1], by the upper 32 bits."""
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    key = (h & U(0xFFFFFFFF00000000)) | np.arange(n, dtype=U)
    width = 1
    while width < w:
        step = min(width, w - width)
        key = np.minimum(key[: len(key) - step], key[step:])
        width += step
    return (key & U(0xFFFFFFFF)).astype(np.int64)


def firsts(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by (hash, doc, place): (order, is the first of its hash, does its hash occur again)."""
    o = np.lexsort((place, doc, h))
    same = h[o][1:] == h[o][:-1]
    first = np.concatenate([[True], ~same])[: len(o)]
    again = np.zeros(len(o), bool)
    again[1:] |= same
    again[:-1] |= same
    return o, first, again


def gathered(rows: DataFrame) -> DataFrame:
    """(doc_id, places): at most the document's own length."""
    return rows.groupBy("doc_id").agg(F.collect_list("place").alias("places"))


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def lists(column: pa.Array) -> list[np.ndarray]:
    """The rows of a list<long> column as arrays; null gives an empty one."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.fromiter((len(x) if x.is_valid else 0 for x in column), np.int64, len(column))
    ends = np.cumsum(n)
    return [values[e - k : e] for e, k in zip(ends.tolist(), n.tolist(), strict=True)]


def second_hash(h: np.ndarray) -> np.ndarray:
    return mix(h ^ U(0x5851F42D4C957F2D))
