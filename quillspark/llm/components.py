"""Connected components of an edge table by alternating large and small stars, few edges by one task.

Every round is an aggregation and a join over edges, checkpointed in the shared folder; only two numbers
of each round reach the driver, and joins are merged at every size, never broadcast through it. Null ends are dropped, repeated edges and loops do no harm; without edges
the result is empty.

Spark keeps the plans and tasks of past rounds on the driver. As soon as no more than ``LOCAL_EDGES`` edges are left, one task
joins them all in bounded memory, which is one plan instead of two a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed

#: So many edges, 16 bytes each, are joined by one task.
LOCAL_EDGES = 500_000


def lowest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges that isn't the smallest of its component, and that smallest one."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    below = root < np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _by_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(c.to_numpy() for c in batch.columns) for batch in batches if batch.num_rows]
        if held:
            found = lowest(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, component long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    onward = edges.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return onward.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node of its component, for every node that isn't that smallest one. ``edges``: u, v."""
    edges = checkpointed(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    last = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        if now[0] <= LOCAL_EDGES and {kind for _, kind in edges.dtypes} == {"bigint"}:
            return checkpointed(_by_one_task(edges))
        last = now
        edges = checkpointed(_small_star(_large_star(edges)))
