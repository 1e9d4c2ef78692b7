"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import release, stage, unstage

#: Edges that one task takes at once (8 MB); more are taken in distributed rounds.
AT_ONCE = 1 << 19
BATCH = 1 << 16


def labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), in order, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        # edges between roots that are still apart
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for batch in batches:
        for k in range(2):
            ends[k].append(batch.column(k).to_numpy())
    nodes, least = labels(*map(np.concatenate, ends))
    for k in range(0, len(nodes), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k: k + BATCH]), pa.array(least[k: k + BATCH])], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) of every node that
    has an edge; ``edges`` has columns a and b.

    Up to ``AT_ONCE`` edges are one task's work: what the driver keeps for a plan
    outlasts it by a minute, and rounds of small plans add up there.  More alternate
    large-star and small-star steps: a few rounds whatever a component's width.
    Each round is written to the shared folder.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")), "edges")
    if now.count() <= AT_ONCE:
        found = stage(now.coalesce(1).mapInArrow(_at_once, "node long, label long"), "components")
        unstage(now)
        return found
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = now
        now = stage(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        unstage(before)
        release(now.sparkSession)
        if tuple(total) == mark:
            break
        mark = tuple(total)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
