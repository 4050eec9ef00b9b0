"""Connected components by alternating large-star and small-star steps on an edge table.

Edges of a checked number that one task surely holds are joined there instead,
which saves the rounds; the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Rounds of contraction, of which a component of n nodes takes about log n; 16 bytes an edge that one task may hold.
ROUNDS, TASK_EDGES = 40, 1 << 20


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them; the minimum combines before its shuffle."""
    if small:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if small:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    else:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter(F.col("u") != F.col("v")).distinct()


def _least(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a list of edges, and the least node of the component of each."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        # Of two roots the greater hangs under the lesser; then all nodes go to the top.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        held = [(np.asarray(b.column("u")), np.asarray(b.column("v"))) for b in batches]
        if held:
            node, root = _least(*(np.concatenate(c) for c in zip(*held)))
            below = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[below]), pa.array(root[below])], ["u", "v"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``u`` (every node but the least of its component) and ``v``, the least node of its component.

    Raises if contraction has not settled after ``ROUNDS`` rounds, far beyond
    what any number of nodes a cluster can hold takes.
    """
    edges = checkpointed(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.count() <= TASK_EDGES:
        return checkpointed(_in_one_task(edges))
    before = None
    for _ in range(ROUNDS):
        edges = checkpointed(_stars(_stars(edges, False), True))
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return edges
        before = now
    raise RuntimeError("components did not settle")
