"""Connected components of an edge table by hooking to a neighbour and contraction.

Tasks contract the edges they hold; then, while many are left, each round replaces every node by
the first, in that round's order, of itself and its neighbours and keeps the edges between
different replacements; rounds are cut from their lineage by reliable checkpoints.  No node's
edges are gathered anywhere: minima are pre-aggregated, and joins on a node of many edges can be
split.  ``local_roots`` is the same for arrays in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactlake.llm._batches import cut


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), rising, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)  # hook the roots
        np.minimum.at(new, root[y], low)
        while (jump := new[new]).tolist() != new.tolist() if len(new) < 64 else not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


#: Rounds that hook to the smallest neighbour, before rounds in random orders.
PLAIN_ROUNDS = 2
#: Edges that one task solves in the end: 16 MB.  Edges that a task contracts together before a round.
LAST, FLUSH = 1 << 20, 1 << 20


def _forest(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes and roots of each run of ``flush`` edges or more."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= flush:
            yield local_roots(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield local_roots(*map(np.concatenate, zip(*held, strict=True)))


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges a > b of spanning forests of what a task holds."""
    for nodes, roots in _forest(batches, FLUSH):
        far = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(roots[far])], names=["a", "b"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for nodes, roots in _forest(batches, 1 << 62):
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "component"])


def connected(edges: DataFrame, a: str = "a", b: str = "b", last: int = LAST) -> DataFrame:
    """(node, component) for every node of an edge; nodes are longs, the component is its smallest.

    Tasks first contract their own edges.  While more than ``last`` edges are left, a round hooks
    every node to a neighbour: the first rounds by the nodes' own order, which ends stars around
    small nodes; later ones by an order drawn anew each time, so that long chains shrink by a
    constant factor.  The rest, of a counted and bounded size, is solved by one task.
    Null ends and loops are ignored; repeated edges do no harm; no edge gives no row.
    """
    ends = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null and a != b")
    e = cut(ends.mapInArrow(_contracted, "a long, b long"))
    levels: list[DataFrame] = []
    while e.count() > last:
        turn = len(levels)
        key = lambda n, turn=turn: F.col(n) if turn < PLAIN_ROUNDS else F.xxhash64(F.col(n), F.lit(turn))
        both = e.select("a", "b").union(e.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct(key("b").alias("k"), F.col("b").alias("n"))).alias("m"))
        low = cut(near.select("node", F.when(F.col("m.k") < key("node"), F.col("m.n")).otherwise(F.col("node")).alias("parent")))
        levels.append(low)
        of = lambda end, low=low: low.select(F.col("node").alias(end), F.col("parent").alias(f"p{end}"))
        moved = e.join(of("a"), "a").join(of("b"), "b").where("pa != pb")
        e = cut(moved.select(F.col("pa").alias("a"), F.col("pb").alias("b")).mapInArrow(_contracted, "a long, b long"))
    result = e.coalesce(1).mapInArrow(_solved, "node long, component long")
    for low in reversed(levels):
        above = result.select(F.col("node").alias("parent"), "component")
        result = low.join(above, "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
    if len(levels) <= PLAIN_ROUNDS:
        return result  # hooked to smaller nodes only
    result = cut(result)
    smallest = cut(result.groupBy("component").agg(F.min("node").alias("smallest")))
    return result.join(smallest, "component").select("node", F.col("smallest").alias("component"))
