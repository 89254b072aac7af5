"""Connected components of an edge table.

Up to ``ONE_TASK`` distinct edges are joined by union-find in a single task, whose memory that bound
fixes. Beyond it, alternating large-star and small-star steps shrink the paths, each step a shuffle of
edges with partial minima; both ways give the same rows. Nodes of very many edges (hubs) are joined
with their minimum by a broadcast of the hubs alone, so the edges of a hub stay spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.llm import kernels as K
from facetmill.llm.common import bound_batches, discard, join_hot, materialize

#: Edges (16 bytes each) up to which one task finds all components; some ten times that in its memory.
ONE_TASK = 1_000_000
#: Edges that make a node a hub: there are at most twice the edges, divided by this, of them.
HUB = 100_000
#: Rounds after which something must be wrong: each at least halves long paths.
MAX_ROUNDS = 60


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, ascending, and the least node each is linked to."""
    node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = place[: len(a)], place[len(a) :]
    parent = np.arange(len(node))
    while True:
        x, y = parent[left], parent[right]
        apart = x != y
        if not apart.any():
            return node, node[parent]
        left, right, x, y = left[apart], right[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def _united(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if held:
            node, root = roots(*(np.concatenate(c) for c in zip(*held)))
            node, root = node[node != root], root[node != root]
            for i in range(0, len(node), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[i : i + 100_000]), pa.array(root[i : i + 100_000])], ["node", "root"])
        K.release()

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star_round(e: DataFrame) -> DataFrame:
    # Large star: every greater neighbour of a node is linked to the node's least neighbour.
    ways = _both_ways(e)
    least = materialize(ways.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "least")
    large = join_hot(ways.where("b > a"), least, ["a"], F.col("n") > HUB).select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = materialize(large.distinct(), "edges")
    # Small star: a node and its lesser neighbours are linked to the least of them.
    lesser = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    small = join_hot(large, lesser, ["a"], F.col("n") > HUB).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    out = materialize(small.unionByName(lesser.select("a", F.col("m").alias("b"))).distinct(), "edges")
    discard(least, large, lesser)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns a and b; gives ``node`` and ``root``, the least node it is linked to.

    Only nodes linked to a lesser one appear; a null end links nothing.
    """
    bound_batches(edges.sparkSession)
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if e.count() <= ONE_TASK:
        out = materialize(_united(e), "components")
        discard(e)
        return out
    before = None
    for _ in range(MAX_ROUNDS):
        last, e = e, _star_round(e)
        discard(last)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if before == now:
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        before = now
    raise RuntimeError(f"components aren't done after {MAX_ROUNDS} rounds")
