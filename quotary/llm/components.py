"""Connected components of an edge table, without bringing edges or components to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quotary.llm.common import record_batch, settled

_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of each node that these edges tie to a lesser one; the root is the least node that they reach.

    Roots are hooked to lesser ones over all edges at once and paths halved, until nothing changes.
    """
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[:u.size], at[u.size:]
    root = np.arange(nodes.size)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    tied = root != np.arange(nodes.size)
    return nodes[tied], nodes[root[tied]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of each partition as a forest of stars: at most one edge a node, and the same components.

    A partition is folded in as it is read, so a task holds one edge for each of its nodes.
    """
    def fold(batches):
        u = v = np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            size += batch.num_rows
            if size > max(1 << 18, u.size):
                u, v = forest(*(np.concatenate([x, *h]) for x, h in zip((u, v), zip(*held), strict=True)))
                held, size = [], 0
        if held:
            u, v = forest(*(np.concatenate([x, *h]) for x, h in zip((u, v), zip(*held), strict=True)))
        yield record_batch(_EDGE, [u, v])

    return edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).mapInArrow(fold, "u bigint, v bigint")


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step: each node's neighbours are tied to the least of them instead.

    ``larger``: the larger neighbours of every node; else the smaller ones and
    the node itself. The least neighbour is an aggregate joined back, so that
    no neighbour list is gathered and a hot node can be split in the join.
    """
    if larger:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that ``edges`` (u, v) touch; the root is the least node of its component.

    Each partition's edges are first contracted to stars. Rounds of alternating
    star steps follow, contracted again where they land; each is one written
    table, whose rows are counted and hashed as they are written. A round that
    changes nothing is the last. An edge from a node to itself does not count.
    """
    def written(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = settled(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")))
        return out, (seen.get["n"], seen.get["h"])

    now, seen = written(_contracted(edges.where("u <> v")))
    before = (0, None)
    while seen != before and seen[0]:
        before = seen
        now, seen = written(_contracted(_star(_star(now, larger=True), larger=False).distinct()))
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
