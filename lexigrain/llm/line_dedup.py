"""Fuzzy line removal: SimHash, shared keys, edit similarity, connected groups.

Lines are cut at ``\\n`` and normalised: ASCII lower case, digits alike, no ASCII
punctuation, blanks as one. Lines of at least ``min_words`` words are judged. Equal
normalised lines are one line from the first shuffle on. Two lines link if their edit
similarity (1 - Levenshtein distance / longer length, of the normalised lines) is at least
``percent`` / 100 and they meet in the search. Of each connected group one occurrence
stays, the first by doc_id and place; all others are cut out of their documents.

The search has two forms:

- With ``bits``, lines meet whose 64-bit SimHashes (over their different words) differ in at
  most ``bits`` bits, and none of these is missed: SimHashes are split into b blocks; two
  within ``bits`` bits agree in b - ``bits`` of them, so lines share the key of one choice of
  that many blocks. b follows from the number of lines so that a key holds few by chance; it
  changes the work, not what meets.
- Without, lines of ``LONG`` tokens or more meet if their SimHashes over tokens differ in at
  most ``REACH`` bits and they share a key: the least hash of ``GRAM`` consecutive tokens in
  one of ``BINS`` hash classes. (So many bits are beyond what blocks of 64 can serve: README has
  the figures.) Of these, pairs with too few characters in common tokens are passed over. Shorter lines share a key if they are equal but for one token, or, below
  ``TINY`` tokens, one character; of these a count of their characters sorts out pairs that
  cannot be similar. Tokens are words; of a word over ``LONG_WORD`` bytes (scripts without
  blanks) its overlapping pieces of ``PIECE`` bytes.

Lines that meet, directly or by way of others, form a cluster, and each cluster is searched
where its texts are: pairs that meet and are not yet joined are held against each other.
Clusters over ``BLOCK`` lines or ``BLOCK_CHARS`` characters are cut into blocks by length: first
each block is searched, then those pairs of blocks whose lengths allow links, where lines
that are joined by then, or by being linked with the cluster's pivot, need no search among themselves.

Defined results: null text stays null and has no lines; lines without a word stay; rows
equal in doc_id and text count as one document; rows with a null doc_id stay as they
are; ties go to the first place; an empty table gives no rows; extra columns stay under
any name, ``text`` is replaced, ``n_lines`` and ``n_removed_lines`` are added (replacing
columns of those names).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.arrays import BASE, U, Sums, byte_table, chunks, grams, mix, per_doc, ranges, words
from lexigrain.llm.components import connected_components, roots
from lexigrain.llm.ngram_join import only_marked
from lexigrain.llm.shared import noted, released, written
from lexigrain.llm.vocab import only
from lexigrain.llm.windows import POS_BITS

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DROP = bytes.maketrans(b"123456789", b"000000000")
#: ``DROP``, with blanks alike.
PLAIN = bytes.maketrans(b"123456789\t\v\f\r", b"000000000    ")
#: Lines that a key of SimHash blocks may hold by chance before one more block is used.
CROWD = 64
#: SimHash bits in which lines that meet may differ; tokens of a shingle; hash classes of shingles.
REACH, GRAM, BINS = 14, 5, 6
#: Tokens from which shingles are used, up to which one token may be left out, and below which one character.
LONG, SHORT, TINY = 8, 10, 4
LONG_WORD, PIECE = 16, 6
#: Lines of more tokens than ``SHORT`` are compared if the share of characters in common tokens is at most so much below ``percent``.
SLACK = 10
#: Classes of tokens whose characters bound those in common.
TOKEN_BINS = 128
#: Rows of a key in one batch from which those close to the middle one are joined to it at once, before the shuffle.
FEW = 8
ROWS_PER_TASK, LINES_PER_TASK = 1_000_000, 16_000
#: Edits from which pairs are compared one by one, characters of pairs that are compared at once, and pairs per word of a bit vector from which that pays.
WIDE, CELLS, SOME = 256, 1_000_000, 32
#: Lines and characters of a cluster that are one task's work; lines of clusters that are searched together with others, and of these at a time.
BLOCK, BLOCK_CHARS, SMALL, HELD = 4000, 4_000_000, 12, 20_000


def normal(line: bytes) -> bytes:
    """The normalised line."""
    return b" ".join(line.lower().translate(DROP, PUNCTUATION).split())


def table() -> np.ndarray:
    t = byte_table(lower=True)
    t[49:58] = t[48]
    return t


TABLE = table()
PUNCT = np.zeros(256, bool)
PUNCT[list(PUNCTUATION)] = True


def per_row(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of n values from begin on."""
    c = np.concatenate([[0], np.cumsum(values)])
    return c[begin + n] - c[begin]


def distinct(values: np.ndarray) -> np.ndarray:
    """A place of each value."""
    o = np.argsort(values)
    v = values[o]
    return o[np.concatenate([[True], v[1:] != v[:-1]])[: len(o)]]


def simhash(values: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHashes of sequences of hashes: majority of the bits of their different members, ties to 0.

    Eight byte counters share a 64-bit number, so sums run over at most 255 members and
    are then added up per sequence.
    """
    line = np.repeat(np.arange(len(n)), n)
    h = values[ranges(begin, n)]
    once = np.sort(distinct(mix(h ^ (line.astype(U) + U(1)) * BASE)))
    h, line = mix(h[once] ^ U(0x1B873593CC9E2D51)), line[once]
    n = np.bincount(line, minlength=len(n))
    if not len(h):
        return np.zeros(len(n), U)
    pieces = -(-n // 255)
    first = np.repeat(np.cumsum(n) - n, pieces) + 255 * ranges(np.zeros(len(n), np.int64), pieces)
    ones = np.zeros((len(n), 64), np.int64)
    new = np.cumsum(pieces) - pieces
    for j in range(8):
        part = np.add.reduceat((h >> U(j)) & U(0x0101010101010101), first).view(np.uint8).reshape(-1, 8)
        ones[:, j::8] = np.add.reduceat(part.astype(np.int64), new, axis=0)
    return ((2 * ones > n[:, None]).astype(U) << np.arange(64, dtype=U)).sum(axis=1, dtype=U)


class Lines:
    """The judged lines of a chunk: document, number in it and hash of the normalised line."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, min_words: int):
        cut = np.flatnonzero(buf == 10)
        start = np.sort(np.concatenate([offs[:-1], cut + 1]))
        self.start, self.end = start, np.sort(np.concatenate([cut, offs[1:]]))
        per = np.searchsorted(cut, offs[1:]) - np.searchsorted(cut, offs[:-1]) + 1
        self.doc = np.repeat(np.arange(len(per)), per)
        self.number = np.arange(len(start)) - np.repeat(np.cumsum(per) - per, per)
        # punctuation goes before words are told apart; \n bounds lines
        kept = np.flatnonzero(~PUNCT[buf])
        b = buf[kept]
        w_start, w_end, _ = words(b, np.searchsorted(kept, offs))
        self.bytes, self.sums, self.w_start, self.w_end = b, Sums(b, TABLE), w_start, w_end
        w = self.sums.spans(w_start, w_end)
        self.line_ends = np.searchsorted(kept, self.end)
        bounds = np.searchsorted(w_start, np.searchsorted(kept, self.start))
        n = np.searchsorted(w_start, self.line_ends) - bounds
        self.judged = np.flatnonzero(n >= max(1, min_words))
        self.n_words, self.first = n[self.judged], bounds[self.judged]
        power = np.cumprod(np.concatenate([[U(1)], np.full(max(int(n.max(initial=1)), 1), BASE, U)]), dtype=U)
        at = ranges(np.zeros(len(self.judged), np.int64), self.n_words)
        self.words = w[ranges(self.first, self.n_words)]
        self.begin = np.cumsum(self.n_words) - self.n_words
        self.hash = mix(np.add.reduceat(mix(self.words) * power[at], self.begin) + self.n_words.astype(U)) if len(self.judged) else w[:0]

    def word_simhash(self, rows: np.ndarray) -> np.ndarray:
        return simhash(self.words, self.begin[rows], self.n_words[rows])

    def texts(self, rows: np.ndarray) -> list[bytes]:
        """The lines as ``normal`` makes them."""
        data = self.bytes.tobytes().lower().translate(PLAIN)
        begin, end = self.w_start[self.first[rows]], self.w_end[self.first[rows] + self.n_words[rows] - 1]
        length = per_row(self.w_end - self.w_start, self.first[rows], self.n_words[rows])
        single = end - begin == length + self.n_words[rows] - 1  # one blank between words
        return [data[a:b] if one else b" ".join(data[a:b].split()) for a, b, one in zip(begin.tolist(), end.tolist(), single.tolist(), strict=True)]


class Tokens:
    """Tokens of normalised lines, each with one blank between words."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        n = len(texts)
        offs = np.cumsum([0, *map(len, texts)])
        buf = np.frombuffer(b"".join(texts), np.uint8)
        start, end, line = words(buf, offs)
        sums = Sums(buf, TABLE)
        long = end - start > LONG_WORD
        if long.any():
            at = ranges(start[long], (end - start)[long] - PIECE + 1)
            at = at[(buf[at] & 0xC0) != 0x80]
            s = np.concatenate([start[~long], at])
            e = np.concatenate([end[~long], at + PIECE])
            o = np.argsort(s, kind="stable")
            start, end = s[o], e[o]
            line = np.searchsorted(offs, start, side="right") - 1
        self.hash, self.line, self.weight = sums.spans(start, end), line, end - start
        self.n = np.bincount(line, minlength=n)
        self.begin = np.cumsum(self.n) - self.n
        first = (buf & 0xC0) != 0x80
        self.chars = per_doc(first, offs)
        # a character counts at its last byte
        few = np.flatnonzero(self.n <= SHORT)
        own, size = ranges(offs[few], offs[few + 1] - offs[few]), offs[few + 1] - offs[few]
        of = np.repeat(np.arange(len(few)), size)
        last = np.append(first, True)[own + 1]
        last[np.cumsum(size)[size > 0] - 1] = True
        counts = np.bincount(of[last] * 16 + (buf[own[last]] & 15), minlength=16 * len(few)).reshape(len(few), 16)
        #: How often characters of each of sixteen sorts occur, up to 15 (short lines only).
        self.bag = np.zeros(n, U)
        self.bag[few] = (np.minimum(counts, 15).astype(U) << (U(4) * np.arange(16, dtype=U))).sum(axis=1, dtype=U)
        self.sim = simhash(self.hash, self.begin, self.n)
        self.kinds: tuple | None = None

    def shared(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of lines have ``percent`` of their characters in tokens of both; short lines do in any case."""
        out = (self.n[i] <= SHORT) | (self.n[j] <= SHORT)
        if self.kinds is None:
            # each line's tokens once, with their characters; lines in order
            known, token = np.unique(self.hash, return_inverse=True)
            own, line = np.unique(self.line * len(known) + token, return_inverse=True)
            per = np.bincount(own // max(len(known), 1), minlength=len(self.n))
            bins = np.bincount(self.line * TOKEN_BINS + (self.hash % U(TOKEN_BINS)).astype(np.int64), self.weight, len(self.n) * TOKEN_BINS)
            total = np.bincount(self.line, self.weight, len(self.n)).astype(np.int64)
            self.kinds = own, len(known), np.bincount(line, self.weight, len(own)).astype(np.int64), np.cumsum(per) - per, per, total, bins.astype(np.int32).reshape(-1, TOKEN_BINS)
        own, known, weight, begin, per, total, bins = self.kinds
        todo = np.flatnonzero(~out)
        step = 20_000
        for k in range(0, len(todo), step):
            k = todo[k : k + step]
            # tokens in common are so in their bins as well
            k = k[100 * np.minimum(bins[i[k]], bins[j[k]]).sum(axis=1) >= percent * np.maximum(total[i[k]], total[j[k]])]
            x, y = np.where(per[i[k]] <= per[j[k]], (i[k], j[k]), (j[k], i[k]))
            of, of_pair = ranges(begin[x], per[x]), np.repeat(np.arange(len(k)), per[x])
            want = own[of] + ((y - x) * known)[of_pair]
            found = np.minimum(np.searchsorted(own, want), len(own) - 1)
            both = np.where(own[found] == want, np.minimum(weight[of], weight[found]), 0)
            out[k] = 100 * np.bincount(of_pair, both, len(k)).astype(np.int64) >= percent * np.maximum(total[x], total[y])
        return out

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, is it a key of short lines), each once."""
        out = []
        # shingles of long lines
        g = grams(self.hash, GRAM)
        at = np.flatnonzero((self.line[: len(g)] == self.line[GRAM - 1 :]) & (self.n[self.line[: len(g)]] >= LONG)) if len(g) else np.zeros(0, np.int64)
        least = np.full(len(self.n) * BINS, U(0xFFFFFFFFFFFFFFFF), U)
        np.minimum.at(least, self.line[at] * BINS + (g[at] % U(BINS)).astype(np.int64), mix(g[at]))
        full = np.flatnonzero(least != U(0xFFFFFFFFFFFFFFFF))
        out.append((full // BINS, least[full], np.zeros(len(full), bool)))
        # one token left out, or none
        rows = np.flatnonzero((self.n >= TINY) & (self.n <= SHORT))
        t = np.zeros((len(rows), SHORT), U)
        n = self.n[rows]
        t[np.repeat(np.arange(len(rows)), n), ranges(np.zeros(len(rows), np.int64), n)] = mix(self.hash[ranges(self.begin[rows], n)])
        for gone in range(SHORT + 1):
            use = np.flatnonzero(n > gone) if gone < SHORT else np.arange(len(rows))
            x = np.delete(t[use], gone, axis=1) if gone < SHORT else t
            h = x @ (BASE ** np.arange(1, x.shape[1] + 1, dtype=U)) + (n[use] - (gone < SHORT)).astype(U)
            out.append((rows[use], mix(h ^ U(0xA0761D6478BD642F)), np.ones(len(use), bool)))
        # one character left out, or none: at most TINY - 1 words of LONG_WORD bytes
        line, key = [], []
        for k in np.flatnonzero(self.n < TINY).tolist():
            s = self.texts[k].decode("utf-8", "replace")
            for x in {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}:
                line.append(k)
                key.append(int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=8).digest()))
        out.append((np.array(line, np.int64), np.array(key, U), np.ones(len(key), bool)))
        line, key, short = (np.concatenate(x) for x in zip(*out, strict=True))
        once = distinct(mix(key ^ (line.astype(U) + U(1)) * BASE))
        return line[once], key[once], short[once]


class Meets:
    """Can lines i and j be similar: by length and SimHash, or, for short lines, by length and characters."""

    def __init__(self, sim: np.ndarray, bag: np.ndarray, chars: np.ndarray, short: np.ndarray, reach: int, percent: int):
        self.sim, self.bag, self.chars, self.short, self.reach, self.percent = sim, bag, chars, short, reach, percent

    def most(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Edits that the longer of the lines allows."""
        return (100 - self.percent) * np.maximum(self.chars[i], self.chars[j]) // 100

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.sim[i] ^ self.sim[j])

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        i, j = np.broadcast_arrays(i, j)
        most = self.most(i, j)
        ok = np.abs(self.chars[i] - self.chars[j]) <= most
        both = self.short[i] & self.short[j]
        ok &= both | (self.apart(i, j) <= self.reach)
        k = np.nonzero(ok & both)
        if len(k[0]):
            more, less = np.zeros((2, len(k[0])), np.int64)
            a, b = self.bag[i[k]], self.bag[j[k]]
            for lane in range(16):
                d = ((a >> U(4 * lane)) & U(15)).astype(np.int64) - ((b >> U(4 * lane)) & U(15)).astype(np.int64)
                more += np.maximum(d, 0)
                less += np.maximum(-d, 0)
            ok[k] = np.maximum(more, less) <= most[k]
        return ok


def middle(sim: np.ndarray) -> int:
    """The SimHash nearest to the majority of all."""
    ones = ((sim[:, None] >> np.arange(64, dtype=U)) & U(1)).sum(axis=0)
    m = ((2 * ones > len(sim)).astype(U) << np.arange(64, dtype=U)).sum(dtype=U)
    return int(np.argmin(np.bitwise_count(sim ^ m)))


class Joined:
    """Components of rows, with few pairs kept at a time."""

    def __init__(self, n: int):
        self.parent, self.a, self.b, self.kept = np.arange(n), [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.kept += len(a)
        if self.kept > 500_000:
            self.done()

    def done(self) -> np.ndarray:
        if self.kept:
            a, b = self.parent[np.concatenate(self.a)], self.parent[np.concatenate(self.b)]
            p = roots(a, b)
            p = np.concatenate([p, np.arange(len(p), len(self.parent))])
            self.parent, self.a, self.b, self.kept = p[self.parent], [], [], 0
        return self.parent


def joined_under_keys(key: np.ndarray, sim: np.ndarray, meets: Meets) -> np.ndarray:
    """For rows sorted by key: the row that stands for those joined, under one key, by meeting each other."""
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(key)))
    out = Joined(len(key))
    small = size <= 256
    end = np.repeat(new + size, size)
    rows = np.flatnonzero(np.repeat(small, size))
    d = 1
    while len(rows := rows[rows + d < end[rows]]):  # row i with row i + d, all keys at once
        for k in range(0, len(rows), 1_000_000):
            i = rows[k : k + 1_000_000]
            ok = meets(i, i + d)
            out.add(i[ok], i[ok] + d)
        d += 1
    for a, n in zip(new[~small].tolist(), size[~small].tolist(), strict=True):
        own = np.arange(a, a + n)
        p = a + middle(sim[own])
        ok = meets(p, own)
        out.add(np.full(int(ok.sum()), p), own[ok])
        rest = own[~ok]
        step = max(1, 2_000_000 // n)
        for k in range(0, len(rest), step):
            i, j = np.nonzero(meets(rest[k : k + step][:, None], own[None, :]))
            out.add(rest[k + i], own[j])
    return out.done()


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or more than ``most`` if it is more.

    Bit vectors along the diagonals that ``most`` edits can reach: a column's window of the
    shorter text moves on by one row. Along a diagonal distances never fall, so that
    of the last cell's diagonal ends the search.
    """
    if len(a) > len(b):
        a, b = b, a
    lo = 0
    while lo < len(a) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    m, n = len(a), len(b)
    if not m or n - m > most:
        return n
    below = min((most - (n - m)) // 2, m)  # diagonals below the last cell's
    above = n - m + below
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << (above + i)
    full, last = (1 << (above + below + 1)) - 1, 1 << below
    up, down, score = full >> above << above, 0, 0  # where the column steps up or down
    for k, c in enumerate(b):
        eq = at.get(c, 0) >> k & full
        zero = (((eq & up) + up) ^ up | eq | down) & full
        if not zero & last:
            score += 1
            if score > most:
                return score
        right, left = down | (zero | up) ^ full, zero & up
        zero >>= 1
        up, down = left | (zero | right) ^ full, zero & right
    return score


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def alike(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many characters both texts begin with, and end with after these."""
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    lo = int(unlike[0]) if len(unlike) else n
    a, b, n = a[lo:], b[lo:], n - lo
    unlike = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    return lo, int(unlike[0]) if len(unlike) else n


def low_bits(n: np.ndarray, word: int) -> np.ndarray:
    """A word of 64 bits of numbers whose lowest n bits are set."""
    return np.where(n >= 64 * word + 64, ~U(0), (U(1) << np.clip(n - 64 * word, 0, 63).astype(U)) - U(1))


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Which pairs have at most ``most`` edits: ``edit_distance`` of all side by side, its bit vectors as words of 64 bits.

    A text of ``b`` is as long as its partner or longer, by at most ``most``; the longest come first.
    """
    m, n = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    below = np.minimum((most - (n - m)) // 2, m)
    above = n - m + below
    w = -(-int((above + below + 1).max()) // 64)
    # where each character stands in the different texts of a, behind w empty words
    number = {x: k for k, x in enumerate(dict.fromkeys(a))}
    size = np.array([len(x) for x in number], np.int64)
    own, flat = code_points("".join(number)), code_points("".join(b))
    known, sort = np.unique(own, return_inverse=True)
    per, span = len(known) + 1, 2 * w + int(m.max()) // 64 + 2
    at = 64 * w + ranges(np.zeros(len(size), np.int64), size)
    there = np.zeros(len(size) * per * span, U)
    np.add.at(there, (np.repeat(np.arange(len(size)), size) * per + sort) * span + (at >> 6), U(1) << (at & 63).astype(U))
    found = np.searchsorted(known, flat)
    kind = np.where(np.append(known, 0)[found] == flat, found, len(known)) * span
    kind[found == len(known)] = len(known) * span
    column = np.zeros((int(n.max()), len(b)), np.int64)
    column[ranges(np.zeros(len(n), np.int64), n), np.repeat(np.arange(len(n)), n)] = kind
    base = np.array([number[x] for x in a], np.int64) * (per * span)
    full = [low_bits(above + below + 1, x) for x in range(w)]
    last = [np.where(below >> 6 == x, U(1) << (below & 63).astype(U), U(0)) for x in range(w)]
    up, down = [f & ~low_bits(above, x) for x, f in enumerate(full)], [np.zeros(len(a), U) for _ in range(w)]
    out, pair, score = np.zeros(len(a), bool), np.arange(len(a)), np.zeros(len(a), np.int64)
    ends = -n
    for k in range(int(n.max())):
        c = int(np.searchsorted(ends, -k))  # texts that have not ended
        if k % 32 == 31:
            alive = np.flatnonzero(score[:c] <= most[:c])
            if 4 * len(alive) < 3 * c:
                out[pair[c:]] = score[c:] <= most[c:]
                n, column, base, above, most, pair, score = n[alive], column[:, alive], base[alive], above[alive], most[alive], pair[alive], score[alive]
                full, last, up, down = ([x[alive] for x in y] for y in (full, last, up, down))
                ends, c = -n, len(alive)
        if not c:
            break
        at = 64 * w + k - above[:c]
        first, shift = base[:c] + column[k, :c] + (at >> 6), (at & 63).astype(U)
        got, carry, zero = [there[first + x] for x in range(w + 1)], None, []
        for x in range(w):
            u, f = up[x][:c], full[x][:c]
            eq = (got[x] >> shift | got[x + 1] << U(1) << (U(63) - shift)) & f
            total = (eq & u) + u
            if w > 1:
                more = total < u
                if carry is not None:
                    total += carry
                    more |= total < carry
                carry = more.astype(U)
            zero.append((total ^ u | eq | down[x][:c]) & f)
        hit = zero[0] & last[0][:c]
        for x in range(1, w):
            hit |= zero[x] & last[x][:c]
        score[:c] += hit == 0
        for x in range(w):
            u, f, z = up[x][:c], full[x][:c], zero[x] >> U(1)
            right, left = down[x][:c] | (zero[x] | u) ^ f, zero[x] & u
            if x + 1 < w:
                z |= zero[x + 1] << U(63)
            up[x], down[x] = left | (z | right) ^ f, z & right
    out[pair] = score <= most
    return out


def similar(pairs: list[tuple[str, str]], percent: int) -> np.ndarray:
    """Which pairs of texts have enough edit similarity."""
    out = np.zeros(len(pairs), bool)
    together: dict[int, list[tuple[int, ...]]] = {}  # by words of a bit vector: length, place, characters alike at both ends
    for k, (a, b) in enumerate(pairs):
        longer = max(len(a), len(b))
        most = (100 - percent) * longer // 100
        lo, hi = alike(code_points(a), code_points(b))
        # what is left may be replaced as a whole
        if longer - lo - hi <= most:
            out[k] = True
        elif most < WIDE:
            together.setdefault(most // 64 + 1, []).append((longer, k, lo, hi))
        else:
            out[k] = edit_distance(a[lo : len(a) - hi], b[lo : len(b) - hi], most) <= most
    for w, some in together.items():
        some.sort(reverse=True)
        while some:
            step = max(1, CELLS // some[0][0])
            n, at, lo, hi = (np.array(x) for x in zip(*some[:step], strict=True))
            some, most = some[step:], (100 - percent) * n // 100
            if len(at) < SOME * w:
                for k, e, x, y in zip(*(z.tolist() for z in (at, most, lo, hi)), strict=True):
                    out[k] = edit_distance(*(t[x : len(t) - y] for t in pairs[k]), e) <= e
                continue
            short, long = zip(*(sorted(pairs[k], key=len) for k in at.tolist()), strict=True)
            ok = n - np.array([len(x) for x in short]) <= most
            short, long = ([x for x, use in zip(side, ok.tolist(), strict=True) if use] for side in (short, long))
            if short:
                out[at[ok]] = within(short, long, most[ok])
    return out


def line_rows(docs: DataFrame, min_words: int, bits: int | None, percent: int) -> DataFrame:
    """Every judged line: (h, doc_id, place); the first of a batch also has its text, ``sim``, ``bag``, ``chars``, ``n_tokens``, and without ``bits`` its ``keys``, ``short_keys`` and ``near`` lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "mark"))
            known: set[int] = set()
            for lo, _hi, buf, offs in chunks(batch.column("text")):
                x = Lines(buf, offs, min_words)
                once = np.unique(x.hash, return_index=True)[1]
                fresh = np.array([h not in known for h in x.hash[once].tolist()], bool)
                once = np.sort(once[fresh]) if len(once) else once
                known.update(x.hash[once].tolist())
                d = x.doc[x.judged]
                full = full_rows(x, once, bits, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.hash.view(np.int64)), pa.array(ids[lo + d]), pa.array((marks[lo + d] << POS_BITS) | x.number[x.judged]), *(c.take(at) for at in [inverse(once, len(x.hash))] for c in full)],
                    schema=LINES,
                )

    return docs.mapInArrow(run, LINE_ROWS)


LINE_ROWS = "h long, doc_id long, place long, line string, sim long, bag long, chars long, n_tokens long, keys array<long>, short_keys array<long>, near array<long>"
LINES = pa.schema([(c, pa.int64()) for c in ("h", "doc_id", "place")] + [("line", pa.string())] + [(c, pa.int64()) for c in ("sim", "bag", "chars", "n_tokens")] + [(c, pa.list_(pa.int64())) for c in ("keys", "short_keys", "near")])


def inverse(once: np.ndarray, n: int) -> pa.Array:
    """For each of n rows its place among ``once``, or null."""
    at = np.full(n, -1, np.int64)
    at[once] = np.arange(len(once))
    return pa.array(at, mask=at < 0)


def per_line(line: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    o = np.argsort(line, kind="stable")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(line, minlength=n))]).astype(np.int32)), pa.array(values[o].view(np.int64)))


def full_rows(x: Lines, once: np.ndarray, bits: int | None, percent: int) -> list[pa.Array]:
    """What ``line_rows`` gives for the first occurrences."""
    texts = x.texts(once)
    n = len(texts)
    line = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
    if bits is not None:
        zero, none = pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.list_(pa.int64()))
        chars = pa.array([len(t) for t in line.to_pylist()], pa.int64())
        return [line, pa.array(x.word_simhash(once).view(np.int64)), zero, chars, pa.array(x.n_words[once]), none, none, none]
    t = Tokens(texts)
    h = x.hash[once]
    owner, key, short = t.keys()
    # rows close to the middle one of their key are joined to it here: one row of a hot key leaves a chunk
    o = np.lexsort((key,))
    o = o[~short[o]]
    k = key[o]
    new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.append(new, len(k)))
    keep = np.ones(len(key), bool)
    near: list[np.ndarray] = []
    to: list[np.ndarray] = []
    for a, m in zip(new[size >= FEW].tolist(), size[size >= FEW].tolist(), strict=True):
        own = owner[o[a : a + m]]
        p = middle(t.sim[own])
        close = (np.bitwise_count(t.sim[own] ^ t.sim[own[p]]) <= REACH // 2) & (200 * np.abs(t.chars[own] - t.chars[own[p]]) <= (100 - percent) * t.chars[own[p]])
        close[p] = False
        keep[o[a : a + m][close]] = False
        near.append(own[close])
        to.append(np.full(int(close.sum()), h[own[p]], U))
    joined = (np.concatenate(near), np.concatenate(to)) if near else (np.zeros(0, np.int64), np.zeros(0, U))
    pick = lambda use: per_line(owner[use], key[use], n)
    return [line, *(pa.array(c.view(np.int64)) for c in (t.sim, t.bag, t.chars, t.n)), pick(keep & ~short), pick(short), per_line(*joined, n)]


def block_count(lines: int, bits: int) -> int:
    """Blocks so that a key of ``blocks - bits`` of them holds at most ``CROWD`` lines by chance."""
    b = bits + 1
    while lines / 2 ** (64 * (b - bits) / b) > CROWD and b < 2 * bits + 4:
        b += 1
    return b


def block_keys(blocks: int, bits: int):
    """The keys of a line by SimHash blocks: one per choice of blocks."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = []
    for choice in combinations(range(blocks), blocks - bits):
        m = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in choice)
        masks.append(m - (1 << 64) if m >= 1 << 63 else m)
    return F.array(*[F.xxhash64(F.col("sim").bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(masks)])


def met(lines: DataFrame, per_line: int, count: int, reach: int, percent: int) -> DataFrame:
    """(a, b): enough pairs of lines to join all that meet under a key."""
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), count * per_line // ROWS_PER_TASK + 1)
    # of what tells lines apart a key needs one: SimHashes, or, for short lines (characters as complement), bags
    keyed = lambda keys, apart, chars: lines.select("h", F.col(apart).alias("apart"), chars.alias("chars"), F.explode(keys).alias("key"))
    rows = keyed("keys", "sim", F.col("chars")).unionAll(keyed("short_keys", "bag", F.bitwise_not("chars")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        h, apart, chars, key = (t.column(c).to_numpy() for c in ("h", "apart", "chars", "key"))
        o = np.argsort(key)
        alone = np.concatenate([[True], key[o][1:] != key[o][:-1], [True]])
        o = o[~(alone[1:] & alone[:-1])]
        o = o[np.lexsort((h[o], key[o]))]
        o = o[np.concatenate([[True], (key[o][1:] != key[o][:-1]) | (h[o][1:] != h[o][:-1])])[: len(o)]]  # batches repeat lines
        key, h, apart, chars = (x[o] for x in (key, h, apart.view(U), chars))
        short = chars < 0
        to = joined_under_keys(key, apart, Meets(apart, apart, np.where(short, ~chars, chars), short, reach, percent))
        i = np.flatnonzero(to != np.arange(len(to)))
        yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(h[to[i]])], names=["a", "b"])

    return rows.repartition(parts, "key").mapInArrow(run, "a long, b long")


def spanning_links(texts: list[str], meets: Meets, label: np.ndarray, asked: np.ndarray, indexed: np.ndarray, percent: int, slack: int | None = SLACK) -> list[tuple[int, int]]:
    """Links between ``asked`` and ``indexed`` lines that join different labels.

    All are first held against the middle line, then each against more and more of those
    that it meets and is not joined with, the nearest by SimHash first, until none is left.
    """
    found: list[tuple[int, int]] = []

    tokens = Tokens([t.encode() for t in texts])

    def tried(a: np.ndarray, b: np.ndarray) -> None:
        if slack is not None:
            ok = tokens.shared(a, b, percent - slack)
            a, b = a[ok], b[ok]
        ok = similar([(texts[i], texts[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], percent) if len(a) else np.zeros(0, bool)
        for i, j in zip(a[ok].tolist(), b[ok].tolist(), strict=True):
            if label[i] != label[j]:
                found.append((i, j))
                label[label == label[j]] = label[i]

    both = np.zeros(len(texts), bool)
    both[indexed] = True
    is_asked = np.zeros(len(texts), bool)
    is_asked[asked] = True
    pivot = indexed[middle(meets.sim[indexed])]
    q = asked[(asked != pivot) & meets(pivot, asked)]
    q = q[label[q] != label[pivot]]
    tried(q, np.full(len(q), pivot))

    def rounds(part: list[tuple[int, np.ndarray]]) -> None:
        n = 1
        while part:
            left, a, b = [], [], []
            for i, j in part:
                j = j[label[j] != label[i]]
                if len(j):
                    a.append(np.full(min(n, len(j)), i))
                    b.append(j[:n])
                    left.append((i, j[n:]))
            tried(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)))
            part, n = left, 2 * n

    part, size = [], 0
    for i in asked.tolist():
        j = indexed[(label[indexed] != label[i]) & (indexed != pivot)]
        j = j[~(is_asked[j] & both[i] & (j <= i))]  # each pair once
        j = j[meets(i, j)]
        if len(j):
            part.append((i, j[np.argsort(meets.apart(i, j), kind="stable")].astype(np.int32)))
            size += len(j)
        if size > 2_000_000:
            rounds(part)
            part, size = [], 0
    rounds(part)
    return found


def links_in_small(group: np.ndarray, texts: list[str], meets: Meets, percent: int, slack: int | None) -> list[tuple[int, int]]:
    """``spanning_links`` of many small groups (rows sorted by group), all of whose lines are asked and indexed."""
    label, found = np.arange(len(texts)), []
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    start = np.repeat(new, np.diff(np.append(new, len(group))))
    pairs, d = [], 1
    while len(i := np.flatnonzero(group[d:] == group[:-d])):
        pairs.append((i, i + d))
        d += 1
    if not pairs:
        return found
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    ok = meets(a, b)
    a, b = a[ok], b[ok]
    first = (a == start[a]) | (b == start[b])  # with the first line of the group, then the others
    for turn in (first, ~first):
        x, y = a[turn], b[turn]
        x, y = (z[label[x] != label[y]] for z in (x, y))
        if not len(x):
            continue
        if slack is not None and turn is not first:
            ok = Tokens([t.encode() for t in texts]).shared(x, y, percent - slack)
            x, y = x[ok], y[ok]
        ok = similar([(texts[i], texts[j]) for i, j in zip(x.tolist(), y.tolist(), strict=True)], percent) if len(x) else np.zeros(0, bool)
        found += zip(x[ok].tolist(), y[ok].tolist(), strict=True)
        if found:
            i, j = (np.array(z) for z in zip(*found, strict=True))
            p = roots(i, j)
            label = np.concatenate([p, np.arange(len(p), len(texts))])
    return found


GROUP = ["cluster", "block", "chunk"]
LINE = ["h", "line", "sim", "bag", "chars", "n_tokens"]


def searched(rows: DataFrame, parts: int, reach: int, percent: int) -> DataFrame:
    """Links (a, b) within each group (cluster, block, chunk) between lines not ``joined`` alike, in so many tasks: the more lines a task has, the more pairs it compares at a time."""
    columns = [*GROUP, *LINE, "joined", "indexed", "asked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)

        slack = SLACK if reach == REACH else None

        def lines(one: list[list]) -> tuple[list[str], Meets]:
            text, sim, bag, chars, n_tokens = (list(x) for x in zip(*(x[:5] for x in one), strict=True))
            short = np.array(n_tokens) <= SHORT if slack is not None else np.zeros(len(one), bool)
            return text, Meets(np.array(sim, np.int64).view(U), np.array(bag, np.int64).view(U), np.array(chars, np.int64), short, reach, percent)

        def batch_of(h: list[int], got: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for k in x], pa.int64()) for x in zip(*got, strict=True)], names=["a", "b"])

        held: list[tuple[int, int, list]] = []  # lines of small groups: number of the group, h, rest
        for number, (_, group) in enumerate(groupby(stream(), key=lambda r: r[:3])):  # at most a block and a chunk
            one: dict[int, list] = {}
            for r in group:
                own = one.setdefault(r[3], [*r[4:10], False, False])
                own[6], own[7] = own[6] or r[10], own[7] or r[11]
            h = sorted(one)
            if len(h) < 2:
                continue
            indexed, asked = (np.array([one[k][c] for k in h], bool) for c in (6, 7))
            label = np.unique([one[k][5] for k in h], return_inverse=True)[1]
            if len(h) <= SMALL and indexed.all() and asked.all() and label.max() == len(h) - 1:
                held += [(number, k, one[k]) for k in h]
                if len(held) > HELD:
                    yield from batch_of([x[1] for x in held], links_in_small(np.array([x[0] for x in held]), *lines([x[2] for x in held]), percent, slack))
                    held = []
                continue
            text, meets = lines([one[k] for k in h])
            yield from batch_of(h, spanning_links(text, meets, label, np.flatnonzero(asked), np.flatnonzero(indexed), percent, slack))
        if held:
            yield from batch_of([x[1] for x in held], links_in_small(np.array([x[0] for x in held]), *lines([x[2] for x in held]), percent, slack))

    return rows.select(*columns).repartition(parts, *GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, "a long, b long")


def near_pivot(large: DataFrame, percent: int) -> DataFrame:
    """Adds ``near``: is the line similar to its cluster's pivot."""
    names = large.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flag = similar(list(zip(b.column("line").to_pylist(), b.column("pivot_line").to_pylist(), strict=True)), percent)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(flag, pa.bool_())], names=[*names, "near"])

    pivots = large.filter("h = pivot").select("cluster", F.col("line").alias("pivot_line"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in large.schema)
    return large.join(pivots, "cluster").mapInArrow(run, f"{schema}, near boolean")


def blocks_by_length(large: DataFrame) -> DataFrame:
    """Adds ``block``: the lines of a cluster in order of length, cut after about ``BLOCK`` of them or ``BLOCK_CHARS`` characters."""
    own = F.greatest(F.lit(1 / BLOCK), F.col("chars") / BLOCK_CHARS)
    per = large.groupBy("cluster", "chars").agg(F.count("*").alias("alike"), F.sum(own).alias("size"))
    shorter = Window.partitionBy("cluster").orderBy("chars").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("before", F.coalesce(F.sum("size").over(shorter), F.lit(0.0)))
    at = F.col("before") + F.pmod(F.xxhash64("h"), F.col("alike")) / F.col("alike") * F.col("size")
    return large.join(per, ["cluster", "chars"]).withColumn("block", F.floor(at).cast("long")).drop("alike", "size", "before")


def block_pairs(large: DataFrame, percent: int) -> DataFrame:
    """(cluster, block, chunk): pairs of different blocks, the one of shorter lines first, whose lengths allow links."""
    range_ = large.groupBy("cluster", "block").agg(F.min("chars").alias("least"), F.max("chars").alias("most"))
    range_ = written(range_, "blocks")
    other = range_.select("cluster", F.col("block").alias("chunk"), F.col("least").alias("from"))
    near = F.col("from") - F.col("most") <= F.floor((100 - percent) * F.col("from") / 100)
    return range_.join(other, "cluster").filter((F.col("block") < F.col("chunk")) & near).select(*GROUP)


def cluster_links(members: DataFrame, count: int, reach: int, percent: int) -> DataFrame:
    """Links among ``count`` rows of ``members``: (h, cluster, n, total, pivot, ``LINE``)."""
    yes = F.lit(True)
    big = (F.col("n") > BLOCK) | (F.col("total") > BLOCK_CHARS)
    zero = F.lit(0).cast("long")
    small = members.filter(~big).withColumns({"block": zero, "chunk": zero, "joined": F.col("h"), "indexed": yes, "asked": yes})
    columns = [*GROUP, *LINE, "joined", "indexed", "asked"]
    found = searched(small.select(*columns), count // LINES_PER_TASK + 1, reach, percent)
    large = members.filter(big)
    if large.isEmpty():
        return found
    large = written(near_pivot(large, percent), "large-clusters")
    large = written(blocks_by_length(large).withColumn("joined", F.when(F.col("near"), F.col("pivot")).otherwise(F.col("h"))), "blocks-of-lines")
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * count // BLOCK)
    within_ = searched(large.withColumns({"chunk": F.col("block"), "indexed": yes, "asked": yes}).select(*columns), parts, reach, percent)
    within_ = written(within_.unionAll(large.filter("near and h <> pivot").select(F.col("h").alias("a"), F.col("pivot").alias("b"))), "links-in-blocks")
    pairs = written(block_pairs(large, percent), "block-pairs")
    parts = max(parts, pairs.count())
    component = connected_components(within_).select(F.col("node").alias("h"), F.col("component"))
    lines = large.drop("chunk").join(component, "h", "left").withColumn("joined", F.coalesce("component", "h"))
    asked = lines.join(pairs, ["cluster", "block"]).withColumns({"indexed": ~yes, "asked": yes})
    indexed = lines.withColumnRenamed("block", "chunk").join(pairs, ["cluster", "chunk"]).withColumns({"indexed": yes, "asked": ~yes})
    across = searched(asked.select(*columns).unionAll(indexed.select(*columns)), parts, reach, percent)
    return found.unionAll(within_).unionAll(across)


def group_firsts(docs: DataFrame, min_words: int, bits: int | None, percent: int) -> tuple[DataFrame, DataFrame]:
    """(all judged occurrences, (h, first) for every line that stands more than once in its group)."""
    seen = written(line_rows(docs, min_words, bits, percent), "lines")
    lines = seen.filter("chars is not null")
    n = lines.count()
    reach = REACH if bits is None else bits
    if bits is None:
        pairs = met(lines, BINS, n, reach, percent).unionAll(lines.select(F.col("h").alias("a"), F.explode("near").alias("b")))
    else:
        b = block_count(n, bits)
        keyed = lines.withColumns({"keys": block_keys(b, bits), "short_keys": F.array().cast("array<long>")})
        pairs = met(keyed, len(list(combinations(range(b), bits))), n, reach, percent)
    pairs = written(pairs.filter("a <> b").distinct(), "meetings")
    clusters = connected_components(pairs).withColumnRenamed("node", "h").withColumnRenamed("component", "cluster")
    shared = pairs.groupBy(F.col("b").alias("h")).agg(F.count("*").alias("shared"))
    clusters = clusters.join(shared, "h", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    ends = pairs.select(F.col("a").alias("h")).unionAll(pairs.select(F.col("b").alias("h")))
    texts = only_marked(lines.select(*LINE), ends, "h")
    members = written(clusters.join(texts, "h").dropDuplicates(["h"]), "members")
    size = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("chars").alias("total"), F.max_by("h", F.struct("shared", "h")).alias("pivot"))
    links = written(cluster_links(members.drop("shared").join(size, "cluster"), members.count(), reach, percent), "links")
    labels = connected_components(links).withColumnRenamed("node", "h").withColumnRenamed("component", "label")
    once = seen.groupBy("h").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n"))
    # lines that stand once and link with none need nothing more
    own = once.join(labels, "h", "left").filter("n > 1 or label is not null").select("h", F.coalesce("label", "h").alias("label"), "first", "n")
    own = written(own, "groups")
    group = own.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1")
    return seen, own.select("h", "label").join(group, "label").select("h", "first")


def remove_lines(documents: DataFrame, min_words: int = 5, bits: int | None = None, percent: int = 80) -> DataFrame:
    """``documents`` with ``text`` less its removed lines, ``n_lines`` and ``n_removed_lines``.

    ``bits`` limits links to lines within so many SimHash bits.
    """
    documents = documents.drop("n_lines", "n_removed_lines").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    mark = F.shiftrightunsigned(F.xxhash64("text"), 40)  # rows of one doc_id with different texts stay apart
    docs = documents.filter("doc_id is not null and text is not null").select("doc_id", "text", mark.alias("mark"))
    with released(documents.sparkSession):  # of all that is written on the way this alone is needed later
        seen, firsts = group_firsts(docs, min_words, bits, percent)
        gone = seen.select("h", "doc_id", "place").join(firsts, "h").filter((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.place") != F.col("place")))
        mask = F.lit((1 << POS_BITS) - 1)
        gone = gone.groupBy("doc_id", F.shiftright("place", POS_BITS).alias("own_mark")).agg(F.collect_list(F.col("place").bitwiseAND(mask)).alias("own"))
        gone = written(gone, "removed", keep=True)
    noted(gone)

    # columns by number, so that no name of the input is in the way
    names = documents.columns
    plain = documents.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)])
    key, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    joined = plain.withColumns({"own_id": key, "own_mark": F.when(text.isNotNull(), F.shiftrightunsigned(F.xxhash64(text), 40))})
    joined = joined.join(gone.withColumnRenamed("doc_id", "own_id").hint("merge"), ["own_id", "own_mark"], "left")
    cut = F.col("own").isNotNull()
    # a column that is used twice is made once a row; inside the functions below it would be made once a line
    joined = joined.withColumn("lines", F.when(cut, F.split(text, "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("lines").cast("long") - 1), F.col("own"))
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i.cast("int"))), "\n")
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    joined = joined.withColumns({
        "new": F.when(cut, kept).otherwise(text),
        "n_lines": F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(breaks + 1).cast("long"),
        "n_removed_lines": F.when(cut, F.size("own")).otherwise(0).cast("long"),
    })
    return joined.select(*[F.col("new" if c == "text" else f"c{k}").alias(c) for k, c in enumerate(names)], "n_lines", "n_removed_lines")
