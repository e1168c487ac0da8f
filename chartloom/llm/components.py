"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, tidy

ONE_TASK = 500_000
"""Edges (8 MB) that one task may finish by union-find; more are first contracted by all tasks."""


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for edges a - b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for i in range(len(parent)):
        parent[i] = parent[parent[i]]
    return nodes, nodes[parent] if len(nodes) else nodes


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    if held:
        node, root = union_find(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])


def connected(edges: DataFrame, scratch: Scratch, tag: str, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (a, b longs) reaches.

    Up to ``one_task`` edges, a proven bound, are finished by one task.  More are
    contracted by alternating large-star and small-star steps: each hangs the
    neighbours of a node on the least of them, so that the edge count never
    grows, no task holds a component, and the rounds grow with the logarithm of
    the longest path; they end when a round changes no edge.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"{tag}0")
    if now.count() <= one_task:
        return scratch.keep(now.coalesce(1).mapInArrow(tidy(_finish), "node long, root long"), f"{tag}roots")
    mark, step = None, 0
    while True:
        step += 1
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.union(least.select("a", F.col("m").alias("b"))).distinct()
        old, now = f"{tag}{step - 1}", scratch.keep(small, f"{tag}{step}")
        scratch.drop(old)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen
