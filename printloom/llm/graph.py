"""Connected components: spanning forests of parts of the edges, then alternating stars, as DataFrame operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from printloom.llm.common import written

#: Edges of one part, held in memory at once.
PART_EDGES = 1 << 20


def least_of_parts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and the least node that each reaches."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        x, y = label[u], label[v]
        apart = x != y
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))  # each root is tied to its least neighbour
        while not np.array_equal(further := label[label], label):
            label = further
    return nodes, nodes[label]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect what the edges (a, b) of a part connect: each node and the least one that it reaches."""

    def stars() -> tuple[np.ndarray, np.ndarray]:
        nodes, least = least_of_parts(*(np.concatenate(x) for x in zip(*held)))
        return nodes[nodes != least], least[nodes != least]

    held, size = [], 0
    for batch in batches:
        held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
        size += batch.num_rows
        if size >= 2 * PART_EDGES:
            held = [stars()]
            size = len(held[0][0])
            if size >= PART_EDGES:
                yield pa.record_batch({"a": held[0][0], "b": held[0][1]})
                held, size = [], 0
    if size:
        a, b = stars()
        yield pa.record_batch({"a": a, "b": b})


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step: every node's neighbours are tied to its least neighbour (or itself).

    The small step looks at lesser neighbours only, the large one ties greater ones only.
    """
    if small:
        arcs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = arcs.join(least, "u")
    if small:
        out = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node (a long) of an edge list; a component is named by its least node.

    First each part of some PART_EDGES edges leaves one edge a node at most. Then rounds alternate until the edges are
    stars around least nodes; each round's edges are written to the shared folder, so no lineage grows. Loops are
    dropped; no edges give an empty result.
    """
    given = written(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b"))
    parts = max(1, -(-given.count() // PART_EDGES))
    now = written(given.coalesce(parts).mapInArrow(_thinned, "a long, b long").distinct())
    # stars around least nodes: no node is tied to two others, no centre is tied itself
    while not now.groupBy("a").count().where("count > 1").isEmpty() or not now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
        now = written(_stars(_stars(now, small=False), small=True))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
