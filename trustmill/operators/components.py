"""Connected components of an undirected edge table, by alternating large-star and small-star passes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustmill.functions.storage import saved

#: The number of passes grows with the logarithm of the graph; more than this many means a defect.
MAX_PASSES = 60
#: Edges that a task merges at a time.
PORTION = 200_000


def contracted(edges: DataFrame) -> DataFrame:
    """edges (u, v) as fewer that join the same nodes: every task merges the edges that it reads (PORTION at a time) by
    union-find and gives an edge from each node to the smallest of its set. A tree of a task's edges becomes a star, and
    repeated edges and cycles go, before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PORTION):
                part = batch.slice(i, PORTION)
                parent: dict = {}

                def root(x, parent=parent):
                    top = x
                    while parent.setdefault(top, top) != top:
                        top = parent[top]
                    while parent[x] != top:
                        parent[x], x = top, parent[x]
                    return top

                for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    a, b = root(a), root(b)
                    parent[max(a, b)] = min(a, b)
                pairs = [(x, root(x)) for x in list(parent)]
                pairs = [(x, y) for x, y in pairs if x != y]
                kinds = [batch.schema.field(k).type for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], kinds[k]) for k in (0, 1)], ["u", "v"])

    return edges.mapInArrow(run, edges.schema)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", hubs: bool = False) -> DataFrame:
    """(node, component): for every node that has an edge, the smallest node that it reaches.

    Nodes are of any ordered type. Self-loops, repeated and reversed edges are allowed; edges with a null end are
    ignored; an empty table gives an empty result. With hubs, edges are contracted by each task first, and the smallest
    neighbours are saved before they are joined, so that adaptive execution can split a node with very many edges (the
    nodes must be numbers or strings); without, passes write less.
    """
    keep = saved if hubs else lambda df: df
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = pairs.select("u").union(pairs.select("v")).distinct()
    inner = pairs.where("u <> v")
    stars = saved((contracted(inner) if hubs else inner).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(stars)
    for _ in range(MAX_PASSES):
        stars = saved(_small_star(_large_star(stars, keep), keep))
        now = _state(stars)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_PASSES} passes")
    return nodes.join(stars.groupBy("u").agg(F.min("v").alias("v")), "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


def _state(stars: DataFrame) -> tuple:
    h: Column = F.xxhash64("u", "v")
    return tuple(stars.agg(F.count("*"), F.bit_xor(h), F.sum((h % 1_000_003).cast("long"))).first())


def _large_star(stars: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood."""
    both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(stars: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = keep(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
