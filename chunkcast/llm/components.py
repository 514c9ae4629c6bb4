"""Connected components of an edge table, by alternating star steps over written tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chunkcast.session import staged


#: 16 bytes each.
EDGES_PER_TASK = 1_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of edges as stars around each tree's least vertex; without the loops."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while True:  # least neighbour, then pointer jumping, for all vertices at once
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        if np.array_equal(root, before):
            break
    far = np.flatnonzero(root != np.arange(len(names)))
    return names[far], names[root[far]]


def _forest(batches):
    """The forest of one partition's edges."""
    parts = list(batches)
    if parts:
        table = pa.Table.from_batches(parts)
        a, b = forest(table.column(0).to_numpy(), table.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def connected_components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``id, component_id`` for every vertex of an edge; the component is its least id.

    ``edges`` has two columns of non-null longs; loops and repeated edges are allowed. Each partition
    first keeps only a spanning forest of its edges. Until only stars are left, every vertex links itself
    and its neighbours to the least of them. A vertex with many edges is pre-aggregated before the
    shuffle of its least neighbour, and every round is written to the shared folder.
    """
    first, second = edges.columns
    kept = edges.select(F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b")).where("a <> b")
    now = staged(kept.mapInArrow(_forest, "a long, b long"), "forest")
    for _ in range(most_rounds):
        # a task takes EDGES_PER_TASK edges; settled when every vertex has one, to a vertex that is nobody's child
        tasks = max(1, -(-now.count() // EDGES_PER_TASK))
        now = staged(now.coalesce(tasks).mapInArrow(_forest, "a long, b long"), "star")
        if tasks == 1:  # one forest of all edges
            break
        edges_left, children = now.agg(F.count("*"), F.countDistinct("a")).first()
        if edges_left == children and now.join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        around = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = least.select("a", F.col("m").alias("b"))
        now = staged(around.unionByName(own).where("a <> b").distinct(), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    ids = now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return ids.unionByName(roots)
