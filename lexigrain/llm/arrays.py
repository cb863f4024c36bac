"""Numpy kernels that work on the UTF-8 bytes of a chunk of documents at once.

A chunk is a byte array and the offsets of its documents. Words are maximal runs
without ASCII white space (0x20, 0x09-0x0D). Hashes are 64-bit polynomials over a
fixed random byte table, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 20
BASE = U(0x9E3779B97F4A7C15)
INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finisher."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_table(lower: bool = False, ignore: bytes = b"") -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U) * BASE)
    if lower:
        t[65:91] = t[97:123]
    for b in ignore:
        t[b] = 0
    return t


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
EXACT, LOWER = byte_table(), byte_table(lower=True)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n at least; kept at the usual chunk's size only."""
    if n > _powers["n"]:
        m = max(n, CHUNK_BYTES + 1)
        p = np.full(m, BASE, U)
        q = np.full(m, INVERSE, U)
        p[0] = q[0] = 1
        p, q = np.cumprod(p, dtype=U), np.cumprod(q, dtype=U)
        if n > 4 * CHUNK_BYTES:
            return p, q
        _powers.update(n=m, p=p, q=q)
    return _powers["p"], _powers["q"]


class Sums:
    """Prefix sums of a byte array from which the hash of any span follows."""

    def __init__(self, buf: np.ndarray, table: np.ndarray = EXACT):
        p, self.q = powers(len(buf) + 1)
        self.c = np.zeros(len(buf) + 1, U)
        np.cumsum(table[buf] * p[: len(buf)], out=self.c[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.c[end] - self.c[start]) * self.q[start]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(U))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    a = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    offs = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offs


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) with about ``limit`` bytes each; a longer document is a chunk of its own."""
    data, offs = bytes_of(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word. Documents bound words."""
    inside = ~SPACE[buf]
    full = offs[1:] > offs[:-1]
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    before[offs[:-1][full]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    after[offs[1:][full] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(start, offs)))


def grams(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes, document bounds ignored."""
    n = len(w) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = w[:n].copy()
    for j in range(1, k):
        h *= BASE
        h += w[j : n + j]
    return mix(h)


def per_doc(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive offsets (empty ranges give 0)."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def repeated(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: does its (group, key) occur again; is it a later occurrence."""
    n = len(key)
    again, later = np.zeros(n, bool), np.zeros(n, bool)
    if n > 1:
        o = np.lexsort((key, group))
        same = (key[o][1:] == key[o][:-1]) & (group[o][1:] == group[o][:-1])
        later[o[1:][same]] = True
        again[o[1:][same]] = again[o[:-1][same]] = True
    return again, later


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in [s, s + length) for some start s."""
    d = np.zeros(n + length + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, starts + length, -1)
    return np.cumsum(d)[:n] > 0


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + l)."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) + np.repeat(start - first, length)
