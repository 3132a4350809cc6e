"""Connected components: bounded pieces are contracted within tasks, then star rounds join the pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm._store import Scratch

#: Most edges that one task contracts: 16 bytes each, and a table of their nodes.
PIECE_EDGES = 1 << 18


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of this task's edges, each node with the smallest of its component: ``a > b``."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, root(x)) for x in list(parent)]
    stars = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
    yield pa.RecordBatch.from_arrays([pa.array(stars[:, 0]), pa.array(stars[:, 1])], ["a", "b"])


def connected_components(edges: DataFrame, scratch: Scratch, piece: int = PIECE_EDGES, most_rounds: int = 60) -> DataFrame:
    """Map each node of ``edges(u long, v long)`` to the smallest node that it reaches: columns ``node, root``.

    Edges are dealt into pieces of at most ``piece``; a task replaces its piece by the piece's forest. With
    more than one piece, alternating large-star and small-star rounds over written tables join the
    forests: two grouped minima, combined before the shuffle, and two equi-joins, whose hot nodes the
    adaptive planner can split. Rounds grow with the logarithm of the longest path. Null nodes and loops
    are left out. Rounds that run out raise an error; no link is lost in silence.
    """
    e = scratch.table(edges.where("u is not null and v is not null and u <> v").select("u", "v"), "edges")
    pieces = -(-e.count() // piece)
    dealt = e.coalesce(1) if pieces <= 1 else e.repartition(pieces)
    stars = scratch.table(dealt.mapInArrow(_contract, "a long, b long"), "forest")
    scratch.drop(e)
    if pieces > 1:
        stars = _join_stars(stars.distinct(), scratch, most_rounds)
    out = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.unionByName(out.select(F.col("root").alias("node"), "root").distinct())


def _join_stars(e: DataFrame, scratch: Scratch, most_rounds: int) -> DataFrame:
    """Alternate the star rounds over ``a > b`` until every node points at its component's least."""
    e, seen = scratch.table(e, "stars"), None
    for _ in range(most_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = scratch.table(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "stars")
        mark = step.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        scratch.drop(e)
        e = step
        if mark == seen:
            return e
        seen = mark
    raise RuntimeError(f"components have not converged in {most_rounds} rounds")
