"""The trie of conversation prefixes, rolled up by centroid decomposition.

A node is a distinct sequence of first turns; it is named by the smallest conv_id that
starts with it and its depth. Prefixes are told apart by 128 bits: sums, along a
conversation, of hashes of each turn and its place, taken in blocks of turns so that one
long conversation is many rows of work.

``rollup`` adds up values over subtrees of the parent-edge forest. A node weighs as many
turns of conversations as stand at or below it, which one grouping gives. Of every
component the centroid is taken out: the deepest node with half of the weight or more.
The nodes of that much weight are just the centroid's path to the top, so the total below
the centroid, summed over the rows below it, is added along the path without walking it.
What is left falls into the components of the centroid's children, found by one look-up of
the node that a conversation has at the child's depth, and the rest around the top; each has
at most half of the weight, so the rounds follow the logarithm of the input, for long
chains too. Components of up to ``few`` nodes are split to their end in one
task, many of them side by side.

Defined results: rows without a conv_id are of no conversation and left out; rows of one
conversation with equal turns go by role, then text; nulls in role and text are empty; a
conversation without turns is a member of the root alone; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexigrain.llm.shared import written

#: Nodes of a component that one task splits to its end (16 MB).
FEW = 4096
#: Nodes that a task splits side by side.
SIDE_BY_SIDE = 1 << 16
#: Rows of a table of components that is broadcast (8 MB); more are joined by key.
BROADCAST_ROWS = 100_000
#: Turns whose sums are one window's work.
BLOCK = 1024


def turn_hashes() -> list[Column]:
    """120 bits of role and text."""
    sha = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return [F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("long").alias(f"t{k}") for k in range(2)]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn_no from 1, t0, t1, bytes). Rows are ordered by ranges; only counts pass from range to range."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]).filter("conv_id is not null")
    first = F.col("turn").asc_nulls_first()
    laid = rows.repartitionByRange("conv_id", first, F.substring("role", 1, 16), F.substring("text", 1, 48)).sortWithinPartitions("conv_id", first, "role", "text")
    laid = written(laid.select("conv_id", F.monotonically_increasing_id().alias("seq"), *turn_hashes(), F.octet_length("text").cast("long").alias("bytes")), "laid-turns")
    laid = laid.withColumn("range", F.shiftright("seq", 33))
    # a conversation has a row for each range that it reaches into
    spans = laid.groupBy("conv_id", "range").agg(F.min("seq").alias("from"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("conv_id", "range", "from", F.coalesce(before, F.lit(0)).alias("before"))
    rows = laid.join(spans, ["conv_id", "range"]).select("conv_id", (F.col("seq") - F.col("from") + F.col("before") + 1).alias("turn_no"), "t0", "t1", "bytes")
    return written(rows, "numbered-turns")


def rebuilt(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share first turns: with h = crc32(conv_id) % ``heads``, conversation c has the first h turns of
    c - c % ``group`` and then its own after its first h. Gives (conv_id, pos, t0, t1, bytes) and (conv_id, len)."""
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h")
    convs = counts.select("conv_id", "own", h, (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    convs = convs.join(counts.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    convs = written(convs.select("conv_id", "base", "h", "own", F.least("h", F.coalesce("there", F.lit(0))).alias("head")), "rebuilt-heads")
    own = turns.join(convs.select("conv_id", "h", "head"), "conv_id").filter("turn_no > h").withColumn("pos", F.expr("turn_no - h + head"))
    heading = turns.filter(F.col("turn_no") < heads).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "head"), "base").filter("turn_no <= head")
    rows = own.select("conv_id", "pos", "t0", "t1", "bytes").union(heading.select("conv_id", "turn_no", "t0", "t1", "bytes"))
    return rows, convs.select("conv_id", F.expr("head + greatest(own - h, 0)").alias("len"))


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, pos, k0, k1, p0, p1, bytes, len): the hash of each prefix and of the one before it."""
    lanes = [f"s{k}" for k in range(4)]
    x = [F.xxhash64("pos", "t0", "t1"), F.xxhash64("t1", "pos", "t0")]
    low, high = lambda c: c.bitwiseAND(F.lit(0xFFFFFFFF)), lambda c: F.shiftrightunsigned(c, 32)
    rows = turns.select("conv_id", "pos", "bytes", F.floor((F.col("pos") - 1) / BLOCK).alias("block"), *[f(c).alias(n) for n, (f, c) in zip(lanes, [(f, c) for c in x for f in (low, high)], strict=True)])
    running = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(c).over(running).alias(f"to_{c}") for c in lanes])
    blocks = rows.groupBy("conv_id", "block").agg(*[F.sum(c).alias(f"in_{c}") for c in lanes])
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *[F.sum(f"in_{c}").over(earlier).alias(f"in_{c}") for c in lanes]).filter("block > 0")
    rows = rows.join(blocks, ["conv_id", "block"], "left").join(lengths, "conv_id")
    to = [F.col(f"to_{c}") + F.coalesce(f"in_{c}", F.lit(0)) for c in lanes]
    back = [t - F.col(c) for t, c in zip(to, lanes, strict=True)]
    at, up = F.col("pos"), F.col("pos") - 1
    keys = [F.xxhash64(at, *to).alias("k0"), F.xxhash64(*to[::-1], at).alias("k1"), F.xxhash64(up, *back).alias("p0"), F.xxhash64(*back[::-1], up).alias("p1")]
    return rows.select("conv_id", "pos", *keys, "bytes", "len")


def trie_nodes(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """(k0, k1, conv_id, depth, parent_id, n_convs, bytes, n_ends, weight): one row per node; the root has null keys and parent."""
    total = F.sum("len") - F.count("*") * (F.max("pos") - 1)
    found = paths.groupBy("k0", "k1").agg(
        F.min("conv_id").alias("conv_id"), F.max("pos").alias("depth"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"),
        F.count(F.when(F.col("pos") == F.col("len"), 1)).alias("n_ends"), total.alias("weight"), F.max("p0").alias("p0"), F.max("p1").alias("p1"),
    )
    found = written(found, "trie-nodes")
    root = lengths.agg(
        F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_id"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("bytes"),
        F.count(F.when(F.col("len") == 0, 1)).alias("n_ends"), (F.count("*") + F.coalesce(F.sum("len"), F.lit(0))).alias("weight"),
    ).filter("n_convs > 0")
    root = written(root, "trie-root")
    up = found.select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_id"))
    deep = found.filter("depth > 1").join(up, ["p0", "p1"])
    columns = ["k0", "k1", "conv_id", "depth", "parent_id", "n_convs", "bytes", "n_ends", "weight"]
    top = found.filter("depth = 1").crossJoin(F.broadcast(root.select(F.col("conv_id").alias("parent_id"))))  # one row
    none = [F.lit(None).cast("long").alias(k) for k in ("k0", "k1")]
    return deep.select(columns).union(top.select(columns)).union(root.select(*none, *columns[2:]))


# Rolling up


def by_component(big: DataFrame, table: DataFrame, n: int, how: str = "inner") -> DataFrame:
    """Joined on the component's top; ``table`` has ``n`` rows, one for each component."""
    return big.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, ["top_id", "top_depth"], how)


def component_totals(parent: np.ndarray, weight: np.ndarray, values: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Subtree totals of small components side by side: ``parent`` is -1 at tops, ``values`` has a row per node, ``more`` is
    what ancestors' components have added to each already."""
    n = len(parent)
    parent, weight, more, out = parent.copy(), weight.copy(), more.copy(), np.zeros_like(values)
    label, live = tops_of(parent), np.arange(n)
    while len(live):
        own = label[live]
        path = live[2 * weight[live] >= weight[own]]
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, label[path], weight[path])
        centre = path[weight[path] == least[label[path]]]
        centre_of = np.full(n, -1)
        centre_of[label[centre]] = centre
        # components around the centroids, and their totals
        live = live[centre_of[own] != live]
        is_centre = np.zeros(n, bool)
        is_centre[centre] = True
        child = live[(parent[live] >= 0) & is_centre[parent[live]]]
        below = parent[child]
        parent[child] = -1
        held = label.copy()
        label = tops_of(parent)
        total = np.zeros_like(values)
        np.add.at(total, label[live], values[live])
        mass = values.copy()
        np.add.at(mass, below, total[child])
        out[centre] = more[centre] + mass[centre]
        # along the path from the centroid to the top
        path = path[~is_centre[path]]
        to = centre_of[held[path]]
        more[path] += mass[to]
        weight[path] -= weight[to]
    return out


def tops_of(parent: np.ndarray) -> np.ndarray:
    """Each node's furthest ancestor, by doubling."""
    to = np.where(parent < 0, np.arange(len(parent)), parent)
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def parents_at(ids: np.ndarray, depth: np.ndarray, parent_id: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Place of each node's parent; -1 for tops."""
    names, at = np.unique(np.concatenate([ids, parent_id]), return_inverse=True)
    key, want = depth * len(names) + at[: len(ids)], (depth - 1) * len(names) + at[len(ids) :]
    o = np.argsort(key)
    found = o[np.minimum(np.searchsorted(key[o], want), len(o) - 1)]
    return np.where(top, -1, found)


def finished(names: list[str]):
    """Splits whole components, of rows sorted by component."""

    def totals(t: pa.Table) -> pa.RecordBatch:
        c = {n: t.column(n).to_numpy() for n in ("conv_id", "depth", "top_id", "top_depth", "weight", *names, *(f"more_{n}" for n in names))}
        up = t.column("parent_id").fill_null(0).to_numpy()
        parent = parents_at(c["conv_id"], c["depth"], up, (c["conv_id"] == c["top_id"]) & (c["depth"] == c["top_depth"]))
        out = component_totals(parent, c["weight"], *(np.stack([c[f"{x}{n}"] for n in names], 1) for x in ("", "more_")))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (c["conv_id"], c["depth"], *out.T)], names=["conv_id", "depth", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows >= SIDE_BY_SIDE:
                t = pa.Table.from_batches(held)
                top = np.stack([t.column(x).to_numpy() for x in ("top_id", "top_depth")], 1)
                whole = np.flatnonzero((top[1:] != top[:-1]).any(1))
                if len(whole):
                    cut = int(whole[-1]) + 1  # the last component may go on in the next batch
                    yield totals(t.slice(0, cut))
                    held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows:
            yield totals(pa.Table.from_batches(held))

    return run


def rollup(nodes: DataFrame, paths: DataFrame, names: list[str], few: int = FEW) -> DataFrame:
    """(conv_id, depth, *names): sums over subtrees of the columns ``names`` (long).

    ``nodes``: conv_id, depth, parent_id, weight (subtree sums of weights of 1 or more), ``names``. ``paths``: for each place of a
    conversation the node there and its parent, as (conv_id, pos, node_id, parent_id); a node is named by one of its own conversations.
    """
    schema = "conv_id long, depth long, " + ", ".join(f"{n} long" for n in names)
    more = [f"more_{n}" for n in names]
    root = nodes.filter("parent_id is null").select(F.col("conv_id").alias("top_id"), F.col("depth").alias("top_depth"))
    live = nodes.crossJoin(F.broadcast(root)).select("conv_id", "depth", "parent_id", "weight", *names, "top_id", "top_depth", *[F.lit(0).cast("long").alias(m) for m in more])
    columns, small, done = live.columns, [], []
    while True:
        sizes = live.groupBy("top_id", "top_depth").agg(F.count("*").alias("n"), F.max("weight").alias("whole"))
        large = written(sizes.filter(F.col("n") > few).drop("n"), "large-components")
        n = large.count()
        if not n:
            small.append(live)
            break
        small.append(by_component(live, large, n, "left_anti"))
        big = by_component(live, large, n).withColumn("heavy", F.expr("2 * weight >= whole")).drop("whole")
        # on the path to a top weights fall with depth, so the deepest heavy node is the centroid
        centre = big.filter("heavy").groupBy("top_id", "top_depth").agg(F.max(F.struct("depth", "conv_id", "weight")).alias("c"))
        centre = written(centre.select("top_id", "top_depth", F.col("c.conv_id").alias("c_id"), F.col("c.depth").alias("c_depth"), F.col("c.weight").alias("c_weight")), "centroids")
        step = by_component(big, centre, n)
        there = paths.select("conv_id", (F.col("pos") - 1).alias("c_depth"), F.col("node_id").alias("child_id"), F.col("parent_id").alias("over_id"))
        deeper = step.filter("depth > c_depth").join(there, ["conv_id", "c_depth"], "left")
        others = step.filter("depth <= c_depth").select("*", F.lit(None).cast("long").alias("child_id"), F.lit(None).cast("long").alias("over_id"))
        step = deeper.unionByName(others).withColumn("under", F.coalesce(F.col("over_id") == F.col("c_id"), F.lit(False)))
        step = step.withColumn("is_centre", F.expr("conv_id = c_id and depth = c_depth"))
        step = written(step.select(*columns, "heavy", "c_depth", "c_weight", "child_id", "under", "is_centre"), "around-centroids")
        # component totals: all that stands below each centroid, and itself
        mass = written(step.filter("under or is_centre").groupBy("top_id", "top_depth").agg(*[F.sum(x).alias(f"mass_{x}") for x in names]), "component-totals")
        step = by_component(step, mass, n)
        added = [(F.col(f"more_{x}") + F.col(f"mass_{x}")).alias(f"more_{x}") for x in names]
        done.append(step.filter("is_centre").select("conv_id", "depth", *[a.alias(x) for a, x in zip(added, names, strict=True)]))
        along = F.expr("heavy and not under")
        live = step.filter("not is_centre").select(
            "conv_id", "depth", "parent_id", F.when(along, F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")).alias("weight"), *names,
            F.when(F.col("under"), F.col("child_id")).otherwise(F.col("top_id")).alias("top_id"), F.when(F.col("under"), F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
            *[F.when(along, a).otherwise(F.col(m)).alias(m) for a, m in zip(added, more, strict=True)],
        )
    rest = small[0]
    for x in small[1:]:
        rest = rest.unionByName(x)
    out = rest.repartition("top_id", "top_depth").sortWithinPartitions("top_id", "top_depth").mapInArrow(finished(names), schema)
    for x in done:
        out = out.unionByName(x)
    return out


# Digests of the members that end at a node


def id_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of sorted (node_id, depth, conv_id) rows as text; none longer than a batch."""
    for batch in batches:
        node, depth, conv = (c.to_numpy() for c in batch.columns)
        if not len(node):
            continue
        at = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])]))
        ids = list(map(str, conv.tolist()))
        texts = [",".join(ids[a:b]) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(ids)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(depth[at]), pa.array(conv[at]), pa.array(texts, pa.string())], names=["node_id", "depth", "from", "ids"])


def list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's stretches in order; only the hash is held."""
    last, sha = None, None
    for batch in batches:
        out: list[tuple[int, int, str]] = []
        for node, depth, text in zip(*(batch.column(c).to_pylist() for c in ("node_id", "depth", "ids")), strict=True):
            if last == (node, depth):
                sha.update(b",")
            else:
                if last:
                    out.append((*last, sha.hexdigest()))
                last, sha = (node, depth), hashlib.sha256()
            sha.update(text.encode())
        if out:
            yield digest_rows(out)
    if last:
        yield digest_rows([(*last, sha.hexdigest())])


def digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["node_id", "depth", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node_id, depth, ends_sha256) of (node_id, depth, conv_id): the ids of a node ascend. A node with many is laid over several tasks and joined from stretches."""
    rows = ends.select("node_id", "depth", "conv_id").repartitionByRange("node_id", "depth", "conv_id").sortWithinPartitions("node_id", "depth", "conv_id")
    lists = rows.mapInArrow(id_lists, "node_id long, depth long, `from` long, ids string")
    return lists.repartition("node_id", "depth").sortWithinPartitions("node_id", "depth", "from").mapInArrow(list_digests, "node_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, few: int = FEW) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, pos (from 1, gapless), t0, t1, bytes; ``lengths``: conv_id, len for every conversation.
    """
    lengths = written(lengths, "conversation-lengths")
    paths = written(prefixes(turns, lengths), "prefixes")
    nodes = trie_nodes(paths, lengths)
    children = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    nodes = written(nodes, "nodes")
    at = written(paths.join(nodes.select("k0", "k1", F.col("conv_id").alias("node_id"), "parent_id"), ["k0", "k1"]).select("conv_id", "pos", "len", "node_id", "parent_id"), "node-paths")
    names = ["n_leaves", "saved_tokens"]
    totals = rollup(nodes.select("conv_id", "depth", "parent_id", "weight", *names), at, names, few)
    ends = at.filter("pos = len").select("node_id", F.col("pos").alias("depth"), "conv_id")
    none = lengths.filter("len = 0").crossJoin(F.broadcast(nodes.filter("depth = 0").select(F.col("conv_id").alias("node_id"))))
    shas = end_digests(ends.union(none.select("node_id", F.lit(0).cast("long"), "conv_id"))).withColumnRenamed("node_id", "conv_id")
    kept = nodes.select("conv_id", "depth", F.col("parent_id").alias("parent_conv_id"), "n_convs", "n_children")
    out = kept.join(totals, ["conv_id", "depth"]).join(shas, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *names, F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
