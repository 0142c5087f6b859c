"""Connected components by local forests and alternating large and small stars, on edges alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: Edges that a task joins at a time.
CHUNK = 1 << 19


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hooks each node's neighbours to the least of them: those above it, or those below it and itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if large else both.where("v < u")
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    hooked = seen.where("v > u") if large else seen
    out = hooked.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node but the least of its component among these edges, with that least one."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    above = list(range(len(nodes)))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        while above[a] != a:
            above[a] = a = above[above[a]]
        while above[b] != b:
            above[b] = b = above[above[b]]
        if a < b:
            above[b] = a
        else:
            above[a] = b
    root = np.array(above, dtype=np.int64)
    while True:
        further = root[root]
        if np.array_equal(further, root):
            break
        root = further
    own = np.flatnonzero(root != np.arange(len(root)))
    return nodes[own], nodes[root[own]]


def _forests(edges: DataFrame, n: int, chunk: int) -> DataFrame:
    """The n edges as the stars of their components within each task's chunks."""

    def run(batches):
        held, have = [], 0
        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            have += batch.num_rows
            if have >= chunk:
                yield given(held)
                held, have = [], 0
        if have:
            yield given(held)

    def given(held):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in joined(*(np.concatenate(c) for c in zip(*held)))], ["u", "v"])

    return edges.coalesce(max(1, -(-n // chunk))).mapInArrow(run, "u long, v long")


def components(pairs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """node and component (the least node) of every node in pairs (a, b).

    A round turns the edges of each chunk into stars and hooks them to each other in two passes over the
    edges; a graph of n nodes takes O(log(n)**2) rounds, and once all edges are one chunk its stars are
    the components. The edges are kept in the shared folder after each round.
    """
    edges = common.cut(pairs.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u != v"))
    before = None
    while True:
        n = edges.count()
        edges = _forests(edges, n, chunk)
        if n <= chunk:
            edges = common.cut(edges)
            break
        edges = common.cut(_star(_star(edges, True), False))
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if mark == before:
            break
        before = mark
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
