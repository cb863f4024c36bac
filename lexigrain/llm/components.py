"""Connected components by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.llm.shared import written

#: Edges that one task finishes (16 MB); more are first contracted.
FEW_EDGES = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for edges between nodes 0, 1, ...."""
    parent = np.arange(int(max(a.max(initial=-1), b.max(initial=-1))) + 1)
    while True:
        x, y = parent[a], parent[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        differ = low != high
        if not differ.any():
            return parent
        np.minimum.at(parent, high[differ], low[differ])
        while (parent[parent] != parent).any():
            parent = parent[parent]


def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, to) of a bounded number of edges, in one task."""
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if got:
        a, b = map(np.concatenate, zip(*got, strict=True))
        nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
        to = roots(index[: len(a)], index[len(a) :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[to])], names=["a", "to"])


def connected_components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """``edges`` (a long, b long) to (node, component): the smallest node of the component.

    While there are more than ``few`` edges, a round maps every node to the neighbour (or
    itself) that comes first in a random order of the round, and keeps the edges between
    different images; the number of nodes falls by a constant factor on average, so
    rounds follow the logarithm of the input. Minima are combined before each shuffle and
    each round is written to the shared folder. The bounded rest is one task's work.
    Self-loops give components of one node; null ends are dropped; an empty
    table gives no rows.
    """
    first = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).dropna()
    left = written(first.distinct(), "edges")
    nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("at", F.col("node"))
    left = left.filter("a <> b")
    maps: list[DataFrame] = []
    while (count := left.count()) > few:
        k = F.lit(len(maps))
        both = left.union(left.select("b", "a"))
        ranked = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", k).alias("h"), F.col("b").alias("to"))).alias("m"))
        to = F.least("m", F.struct(F.xxhash64("a", k).alias("h"), F.col("a").alias("to")))
        image = written(ranked.select("a", to["to"].alias("to")), "image")
        maps.append(image)
        left = (
            left.join(image, "a").select(F.col("to").alias("x"), "b")
            .join(image.withColumnRenamed("a", "b"), "b").select("x", "to").filter("x <> to")
        )
        left = written(left.select(F.least("x", "to").alias("a"), F.greatest("x", "to").alias("b")).distinct(), "edges")
    if count:
        maps.append(written(left.coalesce(1).mapInArrow(finished, "a long, to long"), "image"))
    for image in maps:
        nodes = nodes.join(image.select(F.col("a").alias("at"), "to"), "at", "left").select("node", F.coalesce("to", "at").alias("at"))
    nodes = written(nodes, "nodes")
    least = nodes.groupBy("at").agg(F.min("node").alias("component"))
    return nodes.join(least, "at").select("node", "component")
