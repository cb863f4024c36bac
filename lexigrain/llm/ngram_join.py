"""N-gram Jaccard self-join by T-occurrence search.

Documents become sets of hashed word shingles; equal sets are one node. Two sets with
Jaccard similarity of at least ``percent`` differ in few shingles, so, with the shingles
dealt into a few more parts than that by hash, some part is equal in both: each set
files the fingerprints of one more part than may differ (by size band, so both use the same
parts), and sets that share a fingerprint meet in a cluster. Parts with most shingles that
are not in many documents come first, so that a common line brings few together. Short sets could
have all that they share in differing parts, so they are dealt several times, until that is
less likely than two equal hashes.

In a cluster the sets are indexed by shingle and each is searched by DivideSkip: the
short inverted lists are merged and counted, sets that reach the overlap less the number
of long lists are probed in the long ones by binary search, and pairs that reach the
overlap are linked. A pair already connected is not searched again. Clusters over
``block`` sets are cut: sets linked to the cluster's pivot need no search among
themselves; the rest are searched, in chunks, against every block.

Fingerprints and nodes are 64-bit hashes of shingle sets; overlaps are counted over
64-bit shingle hashes.

Defined results: null or empty texts, and texts of white space, have no shingles and
link with nothing; with fewer words than a shingle has, the whole sequence is the one
shingle; a null doc_id counts for nothing in ``component_id``; repeated rows are linked
like any copies; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.arrays import BASE, LOWER, U, Sums, chunks, grams, mix, ranges, words
from lexigrain.llm.components import connected_components
from lexigrain.llm.shared import written
from lexigrain.llm.vocab import only

#: Sets whose search is one task's work, and 64-bit shingle hashes in them (32 MB, some six times that while they are indexed).
BLOCK, BLOCK_TOKENS = 2000, 4_000_000
#: Rows, and bytes of pivots' sets, that are broadcast.
FEW_ROWS, FEW_BYTES = 100_000, 32 << 20
#: Bits, at most, that tell which documents' texts are shuffled (4 MB).
MOST_BITS = 1 << 25
RATIO = 1.5
#: Chance of a link to be missed by its fingerprints, and a size from which one dealing is far below it.
MISSED, SHORT = 1e-15, 1000
#: Shingles are counted in so many buckets (as a power of two) to tell those that many documents share.
BUCKET_BITS = 20
#: A set meets those of its own band and of three bands above it: sizes up to 1.5 ** 3 = 3.375 times its own.
LEAST_PERCENT = 30


class Sets:
    """Shingle sets of a chunk of documents: ``tokens`` sorted within each document, ``size`` per document."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, n: int):
        docs = len(offs) - 1
        start, end, doc = words(buf, offs)
        w = Sums(buf, LOWER).spans(start, end)
        count = np.bincount(doc, minlength=docs)
        first = np.cumsum(count) - count
        g = grams(w, n)
        at = np.flatnonzero(doc[: len(g)] == doc[n - 1 :]) if len(g) else np.zeros(0, np.int64)
        h, d = g[at], doc[at]
        for k in range(1, n):  # too short for a shingle: the sequence itself
            own = np.flatnonzero(count == k)
            if len(own):
                x = np.full(len(own), U(k), U)
                for j in range(k):
                    x = x * BASE + w[first[own] + j]
                h, d = np.concatenate([h, mix(x ^ BASE)]), np.concatenate([d, own])
        o = np.lexsort((h, d))
        h, d = h[o], d[o]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])[: len(h)]
        self.tokens, self.doc = h[new], d[new]
        self.size = np.bincount(self.doc, minlength=docs)
        self.begin = np.cumsum(self.size) - self.size

    def identity(self) -> np.ndarray:
        """A hash of each set; 0 for the empty one."""
        x = sums_by(self.doc, mix(self.tokens ^ U(0xA0761D6478BD642F)), len(self.size))
        return np.where(self.size > 0, mix(x + self.size.astype(U)), 0).astype(U)


def sums_by(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """64-bit sums by group, through halves that floats hold exactly."""
    low = np.bincount(group, weights=(values & U(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(group, weights=(values >> U(32)).astype(np.float64), minlength=n)
    return low.astype(U) + high.astype(U) * BASE


def band_starts(most: int) -> np.ndarray:
    b = [1]
    while b[-1] <= most:
        b.append(max(b[-1] + 1, int(np.ceil(b[-1] * RATIO))))
    return np.array(b, np.int64)


def dealings(b: np.ndarray, parts: np.ndarray, percent: int) -> np.ndarray:
    """How often each band's shingles are dealt into parts, so that a link is missed with a chance under ``MISSED``.

    A link of d differences is missed by one dealing if all its o common shingles fall into the
    d differing parts: (d / parts) ** o, where o >= t s and o >= t d / (1 - t).
    """
    out = np.ones(len(parts), np.int64)
    for i, m in enumerate(parts.tolist()):
        if b[i] > SHORT:
            break
        for s in range(int(b[i]), int(b[i + 1])):
            for d in range(1, s * (100 - percent) // percent + 1):
                o = max(-(-percent * s // 100), -(-percent * d // (100 - percent)))
                out[i] = max(out[i], math.ceil(math.log(MISSED) / (o * math.log(d / m))))
    return out


def bucket(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens ^ U(0x9E3779B97F4A7C15)) >> U(64 - BUCKET_BITS)).astype(np.int64)


def common_shingles(documents: DataFrame, n: int) -> np.ndarray:
    """Marks the ``2 ** BUCKET_BITS`` buckets of shingles that hold more than twice the mean and 16: those of shingles of many documents.

    The marks only order fingerprints, so a rare shingle in a marked bucket costs no link. Their size is fixed.
    """
    pieces = 64

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(1 << BUCKET_BITS, np.int64)
        only()
        for batch in batches:
            for _lo, _hi, buf, offs in chunks(batch.column("text")):
                c += np.bincount(bucket(Sets(buf, offs, n).tokens), minlength=len(c))
        if c.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([x.tobytes() for x in np.minimum(c, 2**31 - 1).astype(np.int32).reshape(pieces, -1)], pa.binary())], names=["piece", "counts"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("piece").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.int32).astype(np.int64)
        for k, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(c > 2 * c.mean() + 16).tobytes()], pa.binary())], names=["piece", "marks"])

    rows = documents.select("text").mapInArrow(counted, "piece int, counts binary").repartition("piece").mapInArrow(marked, "piece int, marks binary").collect()
    out = np.zeros((pieces, (1 << BUCKET_BITS) // pieces), bool)
    for r in rows:
        out[r.piece] = np.unpackbits(np.frombuffer(r.marks, np.uint8)).astype(bool)
    return out.ravel()


def fingerprints(s: Sets, use: np.ndarray, percent: int, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, fingerprint) of the documents marked in ``use``.

    Sets of s and l >= s shingles that link have l <= s / t and differ in at most
    s (1 - t) / t shingles, t = percent / 100. Band i holds such pairs with s in
    [b(i), b(i + 1)); its number of parts exceeds the differences by a quarter and 8. An
    equal part that is not empty is there unless all common shingles fall into differing
    parts: for long sets as unlikely as two equal hashes, short ones are dealt several times.

    Of the parts that are not empty at most d differ, so in one order of all fingerprints the
    first that both have is among the first d + 1 of each: only these are filed, those with
    most shingles outside the marked buckets ``common`` first, then the fullest. So parts with
    nothing but a line or phrase that many documents share are mostly left out.
    """
    rare = np.ones(len(s.tokens), bool) if common is None else ~common[bucket(s.tokens)]
    b = band_starts(int(s.size.max(initial=1)))
    parts = -(-5 * b[1:] * (100 - percent) // (4 * percent)) + 8
    deals = dealings(b, parts, percent)
    band = np.searchsorted(b, s.size, side="right") - 1
    out_d, out_h = [], []
    for back in (0, 1, 2, 3):  # as the smaller of a pair, and as the larger of pairs whose smaller is in a lower band
        i = band - back
        met = use & (i >= 0) & (s.size * (100 - percent) >= percent)
        if back:
            met &= percent * s.size <= 100 * (b[np.maximum(i, 0) + 1] - 1)
        i = np.maximum(i, 0)
        differ = np.minimum(b[i + 1] - 1, s.size) * (100 - percent) // percent
        for deal in range(int(deals[i[met]].max(initial=0))):
            ok = met & (deals[i] > deal)
            k = np.flatnonzero(ok[s.doc])
            token, d = s.tokens[k], s.doc[k]
            m = parts[i]
            base = np.cumsum(np.where(ok, m, 0)) - np.where(ok, m, 0)
            spread = mix(token ^ (i[d] + 1 + (deal << 16)).astype(U) * U(0xD6E8FEB86659FD93))
            part = ((spread >> U(32)) * m[d].astype(U) >> U(32)).astype(np.int64)
            slot = base[d] + part
            n = int(np.where(ok, m, 0).sum())
            count = np.bincount(slot, minlength=n)
            x = sums_by(slot, mix(token), n)
            full = np.flatnonzero(count)
            owner = np.repeat(np.arange(len(m)), np.where(ok, m, 0))[full]
            h = mix(x[full] + mix((deal << 48 | i[owner] << 32 | (full - base[owner])).astype(U) * BASE + count[full].astype(U)))
            own = np.bincount(slot, weights=rare[k], minlength=n)[full]
            o = np.lexsort((h, -count[full], -own, owner))
            per = np.bincount(owner, minlength=len(m))
            o = o[np.arange(len(o)) - (np.cumsum(per) - per)[owner[o]] <= differ[owner[o]]]
            out_d.append(owner[o])
            out_h.append(h[o])
    if not out_d:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(out_d), np.concatenate(out_h)


def links(sets: list[np.ndarray], percent: int, index: np.ndarray, queries: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links between ``queries`` and ``index`` sets (rows of ``sets``) that connect different labels.

    Returns a spanning set of links: one that joins what is already joined is left out.
    ``label`` numbers what is joined already and is updated.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    begin = np.cumsum(size) - size
    is_index = np.zeros(n, bool)
    is_index[index] = True
    _, token = np.unique(flat, return_inverse=True)
    use = np.flatnonzero(is_index[owner])
    keys = np.sort(token[use] * n + owner[use])  # inverted lists, one after the other
    count = np.bincount(token[use], minlength=int(token.max(initial=0)) + 1)
    at = np.cumsum(count) - count
    entries = keys % n

    parent = label.copy()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    found = []
    both = is_index.copy()
    done = np.zeros(n, bool)
    for q in queries.tolist():
        own = token[begin[q] : begin[q] + size[q]]
        s = int(size[q])
        t = max(1, -(-percent * s // 100))  # least overlap with any partner
        lists = own[np.argsort(count[own], kind="stable")]
        longest = max(2, int(count[lists[-1]]))
        n_long = min(t - 1, int(t / (0.01 * np.log2(longest) + 1)))
        short, long = lists[: s - n_long], lists[s - n_long :]
        seen = np.bincount(entries[ranges(at[short], count[short])], minlength=n)
        cand = np.flatnonzero(seen >= t - n_long)
        cand = cand[(cand != q) & ~(done[cand] & both[q])]
        cand = cand[(percent * size[cand] <= 100 * s) & (percent * s <= 100 * size[cand])]
        mine = root(q)
        cand = np.array([c for c in cand.tolist() if root(c) != mine], np.int64)
        if len(cand):
            overlap = seen[cand]
            if n_long:
                want = (long[:, None] * n + cand[None, :]).ravel()
                p = np.searchsorted(keys, want)
                hit = keys[np.minimum(p, len(keys) - 1)] == want
                overlap = overlap + hit.reshape(n_long, len(cand)).sum(axis=0)
            for c in cand[100 * overlap >= percent * (s + size[cand] - overlap)].tolist():
                a, b = root(q), root(c)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((q, c))
        done[q] = True
    for i in range(n):
        label[i] = root(i)
    return found


def set_rows(documents: DataFrame, n: int, carry: list[str]) -> DataFrame:
    """(doc_id, n_shingles, node) per document, and the long columns ``carry``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in batches:
            for lo, hi, buf, offs in chunks(batch.column("text")):
                s = Sets(buf, offs, n)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s.size), pa.array(s.identity().view(np.int64)), *(part.column(c) for c in carry)], names=["doc_id", "n_shingles", "node", *carry])

    return documents.mapInArrow(run, ", ".join(["doc_id long, n_shingles long, node long", *(f"{c} long" for c in carry)]))


def fingerprint_rows(documents: DataFrame, n: int, percent: int) -> DataFrame:
    """(h, node), each set once in a batch."""
    packed = np.packbits(common_shingles(documents, n)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            known: set[int] = set()
            for _lo, hi, buf, offs in chunks(batch.column("text")):
                s = Sets(buf, offs, n)
                node = s.identity()
                use = np.zeros(len(node), bool)
                use[np.unique(node, return_index=True)[1]] = True
                use &= ~np.isin(node, np.fromiter(known, U, len(known))) if known else True
                known.update(node[use].tolist())
                d, h = fingerprints(s, use, percent, common)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node[d].view(np.int64))], names=["h", "node"])

    return documents.select("text").mapInArrow(run, "h long, node long")


def only_marked(documents: DataFrame, members: DataFrame, by: str = "doc_id") -> DataFrame:
    """``documents`` less most of those that are not ``members``, so that few texts are shuffled for a join of both."""
    return parted(documents, members, by)[0]


def parted(documents: DataFrame, members: DataFrame, by: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``documents`` in two parts: all ``members`` with a few others, and the rest.

    A bit field of eight bits per member, at most ``MOST_BITS``, tells them by the hash of their ids (column ``by``, not null); it lets all members pass.
    """
    bits = max(1 << 16, min(MOST_BITS, 1 << (8 * members.count()).bit_length()))
    piece = 1 << 16
    at = lambda: F.pmod(F.xxhash64(by), F.lit(bits))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            b = batch.column("at").to_numpy()
            for k in np.unique(b // piece).tolist():
                seen.setdefault(k, np.zeros(piece, bool))[b[b // piece == k] % piece] = True
        for k, x in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(x, bitorder="little").view(np.int64)], pa.list_(pa.int64()))], names=["piece", "marks"])

    rows = members.select(at().alias("at")).repartition(F.floor(F.col("at") / piece)).mapInArrow(marked, "piece long, marks array<long>")
    # looked up by Spark: a second Python worker beside each that makes sets would take an executor's memory
    place = F.pmod(at(), F.lit(piece))
    here = F.getbit(F.get("marks", F.shiftright(place, 6).cast("int")), F.pmod(place, F.lit(64)).cast("int")) == 1
    pieces = documents.withColumn("piece", F.floor(at() / piece))
    marked_ = pieces.join(F.broadcast(rows), "piece").filter(here)
    rest = pieces.join(F.broadcast(rows), "piece", "left").filter(~F.coalesce(here, F.lit(False)))
    return marked_.select(documents.columns), rest.select(documents.columns)


def with_sets(members: DataFrame, documents: DataFrame, n: int, few: bool = False) -> DataFrame:
    """``members`` (doc_id, node, cluster, ...) with ``tokens``: the set as packed 64-bit hashes. ``few``: they can be broadcast."""
    extra = [c for c in members.columns if c != "doc_id"]  # rows of one doc_id with another set are left out
    schema = members.drop("doc_id").schema
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", tokens binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in chunks(batch.column("text")):
                s = Sets(buf, offs, n)
                own = np.flatnonzero(s.identity().view(np.int64) == batch.column("node").slice(lo, hi - lo).to_numpy())
                t = [s.tokens[a : a + k].tobytes() for a, k in zip(s.begin[own].tolist(), s.size[own].tolist(), strict=True)]
                at = pa.array(lo + own)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in extra), pa.array(t, pa.binary())], names=[*extra, "tokens"])

    if not few:
        documents = only_marked(documents, members)
    return documents.select("doc_id", "text").join(F.broadcast(members) if few else members, "doc_id").select(*extra, "text").mapInArrow(run, out)


def unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(x, U)


def searched(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each group (cluster, block, chunk) of ``rows``: node, tokens, near, indexed, asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("cluster", "block", "chunk", "node", "tokens", "near", "indexed", "asked")), strict=True)

        for _, group in groupby(stream(), key=lambda r: r[:3]):  # at most a block and a chunk
            one: dict[int, list] = {}
            for r in group:
                own = one.setdefault(r[3], [r[4], r[5], False, False])
                own[2], own[3] = own[2] or r[6], own[3] or r[7]
            nodes = sorted(one)
            if len(nodes) < 2:
                continue
            near = [k for k, x in enumerate(nodes) if one[x][1]]
            label = np.arange(len(nodes))
            label[near] = near[0] if near else 0
            q = np.array([k for k, x in enumerate(nodes) if one[x][3]], np.int64)
            i = np.array([k for k, x in enumerate(nodes) if one[x][2]], np.int64)
            got = links([unpack(one[x][0]) for x in nodes], percent, i, q, label)
            if got:
                a, b = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in x], pa.int64()) for x in (a, b)], names=["a", "b"])

    return rows.repartition("cluster", "block", "chunk").sortWithinPartitions("cluster", "block", "chunk").mapInArrow(run, "a long, b long")


def jaccard_components(documents: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, node, links, component): components of the link graph.

    ``node`` is the class of equal sets, ``component`` the least of them in a component (null
    for empty sets) and ``links`` counts the links of a spanning set that touch the node.
    ``carry`` names more columns of longs that go along.
    """
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"percent: from {LEAST_PERCENT} to 100")
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carry)
    sets = written(set_rows(docs, n, list(carry)), "sets")
    least = F.min("node").over(Window.partitionBy("h"))
    edges = fingerprint_rows(docs, n, percent).withColumn("to", least).filter("node <> to").groupBy("node", "to").count()
    edges = written(edges, "meetings")
    clusters = connected_components(edges.select(F.col("node").alias("a"), F.col("to").alias("b"))).withColumnRenamed("component", "cluster")
    shared = edges.groupBy("node").agg(F.sum("count").alias("shared"))
    first = sets.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"))
    members = first.join(clusters, "node").join(shared, "node", "left").select("doc_id", "node", "n_shingles", "cluster", F.coalesce("shared", F.lit(0)).alias("shared"))
    size = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"), F.max_by("node", F.struct("shared", "node")).alias("pivot"))
    thin = written(members.join(size, "cluster").select("doc_id", "node", "cluster", "n", "total", "pivot"), "members")
    members = written(with_sets(thin, docs, n), "member-sets")

    # small clusters: one group each
    zero, yes = F.lit(0).cast("long"), F.lit(True)
    columns = ["cluster", "block", "chunk", "node", "tokens", "near", "indexed", "asked"]
    big = (F.col("n") > block) | (F.col("total") > BLOCK_TOKENS)
    small = members.filter(~big).select("cluster", zero.alias("block"), zero.alias("chunk"), "node", "tokens", F.lit(False).alias("near"), yes.alias("indexed"), yes.alias("asked"))
    found = searched(small, percent)

    heads = thin.filter(big & (F.col("node") == F.col("pivot")))
    n_heads = heads.count()
    if n_heads:
        pivots = written(with_sets(heads, docs, n, n_heads <= FEW_ROWS).select("cluster", F.col("tokens").alias("pivot_tokens")), "pivots")
        # sets stay where they are and are held against their pivot on the fly, or are stored once more where the pivots are many
        few = (pivots.agg(F.sum(F.octet_length("pivot_tokens"))).first()[0] or 0) <= FEW_BYTES
        large = near_pivot(members.filter(big), pivots, percent, few)
        large = large if few else written(large, "large")
        found = found.unionAll(large.filter("near and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        pieces = lambda c, t: F.greatest(F.lit(1), F.ceil(F.col(c) / block), F.ceil(F.col(t) / BLOCK_TOKENS)).cast("long")
        asked = large.groupBy("cluster").agg(F.count_if(~F.col("near")).alias("asked_n"), F.coalesce(F.sum(F.when(~F.col("near"), F.octet_length("tokens") / 8)), F.lit(0)).alias("asked_total"), F.first("n").alias("n_"), F.first("total").alias("total_"))
        asked = written(asked.filter("asked_n > 0").withColumns({"blocks": pieces("n_", "total_"), "chunks": pieces("asked_n", "asked_total")}).drop("n_"), "asked")
        cut = large.join(F.broadcast(asked) if n_heads <= FEW_ROWS else asked, "cluster")
        numbers = lambda c: F.explode(F.sequence(zero, F.col(c) - 1))
        indexed = cut.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("chunk", numbers("chunks")).withColumns({"indexed": yes, "asked": F.lit(False)})
        queries = cut.filter(~F.col("near")).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks"))).withColumn("block", numbers("blocks")).withColumns({"indexed": F.lit(False), "asked": yes})
        # every block meets every chunk; in rounds, each of which moves about as much as the sets themselves
        moved, own = asked.agg(F.sum(F.col("total_") * F.col("chunks") + F.col("asked_total") * F.col("blocks")), F.sum("total_")).first()
        rounds = max(1, math.ceil(moved / own)) if own else 0
        for r in range(rounds):
            mine = F.pmod(F.xxhash64("cluster", "block", "chunk"), F.lit(rounds)) == r
            rows = indexed.filter(mine).select(*columns).unionAll(queries.filter(mine).select(*columns))
            found = found.unionAll(written(searched(rows, percent), "links-of-round"))

    found = written(found, "links")
    joined = connected_components(found).withColumnRenamed("component", "label")
    degree = found.select(F.col("a").alias("node")).unionAll(found.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    own = sets.join(joined, "node", "left").join(degree, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = own.filter("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    alone = F.col("n_shingles") == 0
    return (
        own.join(least, "label", "left")
        .select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "node", F.coalesce("links", F.lit(0)).alias("links"), F.when(~alone, F.col("label")).alias("component"), *carry)
    )


def near_pivot(large: DataFrame, pivots: DataFrame, percent: int, few: bool) -> DataFrame:
    """Adds ``near``: does the set link with its cluster's pivot (cluster, pivot_tokens). ``few``: these can be broadcast."""
    names = ["node", "cluster", "n", "total", "pivot", "tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flag = []
            for x, y in zip(b.column("tokens").to_pylist(), b.column("pivot_tokens").to_pylist(), strict=True):
                x, y = unpack(x), unpack(y)
                k = len(np.intersect1d(x, y, assume_unique=True))
                flag.append(100 * k >= percent * (len(x) + len(y) - k))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(flag, pa.bool_())], names=[*names, "near"])

    return large.join(F.broadcast(pivots) if few else pivots, "cluster").select(*names, "pivot_tokens").mapInArrow(run, "node long, cluster long, n long, total long, pivot long, tokens binary, near boolean")
