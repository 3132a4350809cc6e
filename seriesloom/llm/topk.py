"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into cells of like vectors, by the nearest of a bounded number of pivots, and cells into
blocks of bounded size. A block sorts each dimension once; a query walks the lists from their best ends
for its own signs, in strides that double, scores every vector that it meets by random access, and stops
when the bound from the list heads cannot beat the kth result, or when it has met every vector. Each
query first meets one block of its own cell; the kth score found there is a floor for all other blocks, so
that a block of unlike vectors is left at the first look at its list heads. Queries go in batches of bounded
size, and meet again only as ``k`` rows a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm._store import Scratch

SCALE = 1024
#: About how many vectors a block has, and how many queries a batch.
BLOCK_ROWS = 4096
BATCH_ROWS = 4096
#: Most pivots, by hash order of the vectors.
PIVOTS = 256
FIRST_STRIDE = 8


class SortedLists:
    """One block: integer vectors and, for each dimension, the vectors in ascending order of the component.

    Scores are exact: in floats while sums stay below 2**53, in 64 bits below 2**63, else in Python's integers.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: int | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        bound = max(float(np.abs(self.vectors.astype(np.float64)).max(initial=0)), float(largest or 0))
        most = bound**2 * max(1, vectors.shape[1])
        self.scored = self.vectors.astype(np.float64 if most < 2**53 else np.int64 if most < 2**62 else object)
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.heads = np.take_along_axis(self.scored, self.lists, axis=0)
        #: How many vectors the last query met.
        self.met = 0

    def top(self, query_id: int, query: np.ndarray, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """The k highest (score, vec_id) without the query's own rows, ties to smaller ids.

        With ``floor``, a kth score known from elsewhere, only those that reach it.
        """
        n = len(self.ids)
        q = query.astype(self.scored.dtype)
        used = np.flatnonzero(q)
        up = q[used] > 0
        other = self.ids != query_id
        seen = np.zeros(n, bool)
        scores = np.zeros(n, self.scored.dtype)
        depth, stride, self.met = 0, FIRST_STRIDE, 0
        while self.met < n:
            limit = floor
            if self.met:
                valid = seen & other
                if np.count_nonzero(valid) >= k:
                    kth = np.sort(scores[valid])[-k] if self.scored.dtype == object else np.partition(scores[valid], -k)[-k]
                    limit = kth if floor is None else max(kth, floor)
            if limit is not None:
                at = max(depth - 1, 0)
                bound = (q[used] * np.where(up, self.heads[n - 1 - at, used], self.heads[at, used])).sum() if len(used) else 0
                if bound < limit:
                    break
            to = min(n, depth + stride)
            met = np.zeros(n, bool)
            if len(used):
                met[np.where(up[None, :], self.lists[n - to : n - depth, used][::-1], self.lists[depth:to, used])] = True
            else:
                met[:] = True  # every score is 0: the lists say nothing
            fresh = np.flatnonzero(met & ~seen)
            if 2 * len(fresh) > n:  # reading all in sequence is cheaper than most of them at random
                scores[fresh] = (self.scored @ q)[fresh]
            else:
                scores[fresh] = self.scored[fresh] @ q
            seen[fresh] = True
            self.met += len(fresh)
            depth, stride = to, stride * 2
        at = np.flatnonzero(seen & other if floor is None else seen & other & (scores >= floor))
        order = np.lexsort((self.ids[at], -scores[at]))[:k] if self.scored.dtype != object else sorted(range(len(at)), key=lambda i: (-scores[at[i]], self.ids[at[i]]))[:k]
        return [(int(scores[i]), int(self.ids[i])) for i in at[order]]


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims).astype(np.int64)


def _answer(k: int):
    """Per block and batch: every query of the batch against the block's lists."""

    def run(table: pa.Table) -> pa.Table:
        is_query = table.column("is_query").to_numpy()
        own = table.filter(pa.array(~is_query)).combine_chunks()
        asked = table.filter(pa.array(is_query)).combine_chunks()
        rows: list[tuple[int, int, int]] = []
        if own.num_rows and asked.num_rows:
            dims = table.column("dims")[0].as_py()
            queries = _vectors(asked.column("q").combine_chunks(), dims)
            lists = SortedLists(own.column("vec_id").to_numpy(), _vectors(own.column("q").combine_chunks(), dims), int(np.abs(queries.astype(np.float64)).max(initial=0)))
            for query_id, query, floor in zip(asked.column("vec_id").to_pylist(), queries, asked.column("floor").to_pylist(), strict=True):
                rows += [(query_id, vec_id, score) for score, vec_id in lists.top(query_id, query, k, floor)]
        cols = list(zip(*rows, strict=True)) if rows else ([], [], [])
        return pa.table({name: pa.array(col, pa.int64()) for name, col in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    return run


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, q, dims``, each component x as floor(scale * x).

    Vectors that are null or hold a null or non-finite component are left out; a component beyond 64
    bits is an error.
    """
    scaled = lambda x: x.cast("double") * scale
    whole = lambda x: F.when(F.abs(scaled(x)) < 2.0**63, F.floor(scaled(x)).cast("long")).otherwise(F.raise_error(F.lit("a vector component is beyond 64 bits")).cast("long"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("q")).withColumn("dims", F.size("q"))


def _with_cell(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vec_id, q, dims, cell``: the cell is the nearest pivot of the same length, 0 if there is none."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cell = np.zeros(len(dims), np.int32)
            for d in np.unique(dims):
                near = shared.value.get(int(d))
                if near is not None and d:
                    mine = np.flatnonzero(dims == d)
                    v = _vectors(batch.column(1).take(pa.array(mine)), int(d)).astype(np.float64)
                    cell[mine] = (v @ near.T - (near**2).sum(1) / 2).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "q", "dims", "cell"])

    return vectors.select("vec_id", "q", "dims").mapInArrow(run, "vec_id long, q array<long>, dims int, cell int")


def _deal(of: Column, parts: Column) -> Column:
    return F.pmod(of, parts).cast("int")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` highest integer inner products of each query: ``query_id, rank, vec_id, score``.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``. Every row but those with the query's
    id is a candidate; ties go to the smaller id; with fewer candidates all are given. A vector that is
    null or holds a null or non-finite component takes no part; vectors of unequal length are not
    compared, and empty ones have the score 0 with each other. A component or score beyond 64 bits is
    an error. A query id that repeats is asked once, with its first vector in order; candidate ids that
    repeat are candidates of their own. Empty tables give an empty result. Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "top-k")
    plain = scratch.table(quantised(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n = plain.count()
    first = plain.orderBy(F.xxhash64("row"), "row").limit(min(PIVOTS, -(-n // BLOCK_ROWS))).select("q").collect() if n else []
    pivots = {d: np.array([r["q"] for r in first if len(r["q"]) == d], np.float64) for d in {len(r["q"]) for r in first}}
    rows = scratch.table(_with_cell(plain, pivots), "cells").withColumn("row", F.monotonically_increasing_id())
    asked = quantised(queries).groupBy("vec_id").agg(F.min("q").alias("q")).withColumn("dims", F.size("q"))
    asked = scratch.table(_with_cell(asked, pivots), "queries")

    # at most PIVOTS rows for each length of vectors, and one row for each length of queries
    cells = scratch.table(rows.groupBy("dims", "cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks")), "blocks")
    batches = scratch.table(asked.groupBy("dims").agg(F.ceil(F.count("*") / BATCH_ROWS).alias("batches")), "batches")
    own = rows.join(cells, ["dims", "cell"]).join(batches, "dims").withColumn("block", _deal(F.xxhash64("row"), F.col("blocks")))
    own = own.withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches").cast("int") - 1)))
    sent = asked.join(batches, "dims").withColumn("batch", _deal(F.xxhash64("vec_id"), F.col("batches")))
    key = ["dims", "cell", "block", "batch"]

    def answered(own: DataFrame, sent: DataFrame) -> DataFrame:
        theirs = own.select(*key, F.lit(False).alias("is_query"), "vec_id", "q", F.lit(None).cast("long").alias("floor"))
        return theirs.unionByName(sent.select(*key, F.lit(True).alias("is_query"), "vec_id", "q", "floor")).groupBy(*key).applyInArrow(_answer(k), "query_id long, vec_id long, score long")

    home = sent.withColumn("block", F.lit(0)).withColumn("floor", F.lit(None).cast("long"))
    at_home = scratch.table(answered(own.where("block = 0"), home), "at-home")
    floors = at_home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    away = sent.join(floors, sent["vec_id"] == floors["query_id"], "left").withColumnRenamed("cell", "home")
    away = away.join(cells, "dims").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    found = at_home.unionByName(answered(own, away.where((F.col("cell") != F.col("home")) | (F.col("block") > 0))))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
