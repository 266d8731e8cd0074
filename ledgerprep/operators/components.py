"""Connected components of an undirected graph, in rounds of two joins.

Every round hangs the larger neighbours of a node, and then its smaller ones, below the smallest
of them (Kiveris and others 2014). The edges end as stars around the smallest node of each component,
in a number of rounds that grows with the logarithm of the graph, not with its edges. Before the first
round and after each, every task hangs all nodes that its own edges connect below the smallest of them,
so edges that one task holds need no round at all.

The driver sees one number a round, and a round's table and shuffles are deleted when the next is
written. Both sides of the joins are of one size, so a small graph is merged like a large one: a side
sent to all tasks would pass through the driver, once a join and round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerprep.session import Scratch

#: Edges that a task connects at once.
EDGES = 1 << 19


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node and root (the smallest node reachable) of all nodes of ``edges`` (a, b) but the roots."""
    now = scratch.keep(_tied(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()))
    while _left(now):
        last = now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest.hint("merge"), "a")
        hung = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select("a", F.col("m").alias("b")))
        now = scratch.keep(_tied(hung.filter("a <> b").distinct()))
        scratch.forget(last)
        scratch.sweep()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _left(edges: DataFrame) -> int:
    """Nodes at which ``edges`` are no stars: those below several nodes, or below one and above another."""
    below = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    above = edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
    ends = below.unionByName(above).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return ends.filter("below + above > 1 AND below > 0").agg(F.count(F.lit(1))).first()[0]


def _tied(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) as stars around the smallest of the nodes that those of one task connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= EDGES:
                yield _stars(held)
                held, rows = [], 0
        if rows:
            yield _stars(held)

    return edges.mapInArrow(run, edges.schema)


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    ends = [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in ("a", "b")]
    node, at = np.unique(np.concatenate(ends), return_inverse=True)
    one, two = at[: len(ends[0])], at[len(ends[0]) :]
    root = np.arange(len(node))
    while True:
        x, y = root[one], root[two]
        open_ = x != y
        if not open_.any():
            break
        one, two, x, y = one[open_], two[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    hung = np.flatnonzero(root != np.arange(len(node)))
    return pa.RecordBatch.from_arrays([pa.array(node[hung]), pa.array(node[root[hung]])], names=["a", "b"])
