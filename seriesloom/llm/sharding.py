"""Sharding by extendible hashing: a directory over hash-prefix bits, split only where a bucket is too large.

Bytes are summed, combined before the shuffle, into cells of a common prefix length; a cell above the
limit is summed again over more bits of its own rows. Every cell then looks up its shortest prefix
within the limit, which is its shard. All of it is built-in expressions over (key, bytes) rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm._rows import as_row
from seriesloom.llm._store import Scratch

BITS = 60
SPARE_BITS = 4
STEP_BITS = 8


def hash_bits(doc_id: Column, text: Column) -> Column:
    """60 hash bits of id and text, so that rows repeating an id can part."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, bytes of the text, and the hash bits."""
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), hash_bits(F.col("doc_id"), F.col("text")).alias("h"))


def _place(keyed: DataFrame, directory: DataFrame, depths: list[int]) -> DataFrame:
    """Each row of ``keyed``, which has the hash bits ``h``, with its shard; every row has one cell of one depth."""
    parts = [keyed.withColumn("cell", F.shiftright("h", BITS - d)).join(directory.where(F.col("cell_depth") == d), "cell") for d in depths]
    return reduce(DataFrame.unionByName, parts)


def _shard_name() -> Column:
    """The hash prefix as a string of bits."""
    return F.when(F.col("shard_depth") == 0, "").otherwise(F.expr("lpad(conv(cast(shard as string), 10, 2), shard_depth, '0')"))


def _sums(rows: DataFrame, depth: int) -> DataFrame:
    return rows.groupBy(F.lit(depth).alias("depth"), F.shiftright("h", BITS - depth).alias("prefix")).agg(
        F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("low"), F.max("h").alias("high")
    )


def build_directory(keyed: DataFrame, limit_bytes: int, scratch: Scratch) -> tuple[DataFrame, list[int]]:
    """Cells with their shards, and the cell depths in use.

    Columns ``cell_depth, cell, shard_depth, shard, shard_bytes, shard_docs``. A bucket of one key
    cannot be split and stays, though it may exceed the limit.
    """
    total = keyed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + SPARE_BITS)
    cells, depths, rows = None, [], keyed
    while True:
        level = scratch.table(_sums(rows, depth), "cells")
        depths.append(depth)
        large = (F.col("bytes") > limit_bytes) & (F.col("low") < F.col("high"))
        done = level if depth == BITS else level.where(~large)
        cells = done if cells is None else cells.unionByName(done)
        if depth == BITS or not level.where(large).limit(1).count():
            break
        over = level.where(large).select(F.col("prefix").alias("over"))
        rows = rows.join(over, F.shiftright("h", BITS - depth) == F.col("over"), "left_semi")
        depth = min(BITS, depth + STEP_BITS)
    cells = scratch.table(cells, "leaves")
    above = cells.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("depth")))).withColumn("p", F.expr(f"shiftright(low, {BITS} - d)"))
    sums = above.groupBy("d", "p").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("low").alias("lo"), F.max("high").alias("hi"))
    fits = sums.where((F.col("shard_bytes") <= limit_bytes) | (F.col("lo") == F.col("hi")) | (F.col("d") == BITS))
    found = above.select("depth", "prefix", "d", "p").join(fits, ["d", "p"])
    best = found.groupBy("depth", "prefix").agg(F.min_by(F.struct("d", "p", "shard_bytes", "shard_docs"), "d").alias("best"))
    out = best.select(
        F.col("depth").alias("cell_depth"), F.col("prefix").alias("cell"), F.col("best.d").alias("shard_depth"), F.col("best.p").alias("shard"), F.col("best.shard_bytes"), F.col("best.shard_docs")
    )
    return scratch.table(out, "directory"), depths


def shard_documents(docs: DataFrame, limit_bytes: int = 64 << 20) -> DataFrame:
    """One row for each input row: ``doc_id, n_bytes, depth, shard, shard_bytes, shard_docs, oversize``.

    ``shard`` is the bucket's hash prefix as a string of ``depth`` bits, empty if all rows fit in one.
    Every shard is within ``limit_bytes`` unless it holds a single document or repeats of one row;
    these are ``oversize``. Null and empty texts have 0 bytes; null ids share an id. An empty table
    gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    keyed = scratch.table(_keyed(docs), "keyed")
    directory, depths = build_directory(keyed, limit_bytes, scratch)
    return _place(keyed, directory, depths).select(
        "doc_id", "n_bytes", F.col("shard_depth").cast("long").alias("depth"), _shard_name().alias("shard"), F.col("shard_bytes").cast("long").alias("shard_bytes"), F.col("shard_docs").cast("long").alias("shard_docs"),
        (F.col("shard_bytes") > limit_bytes).alias("oversize"),
    )


def write_shards(docs: DataFrame, path: str, limit_bytes: int = 64 << 20) -> None:
    """Write whole rows under ``path``, a folder ``shard=bits`` for each shard of the directory of ``docs``.

    A row finds its shard by its own hash bits, so every row is written once, repeated ones too. The
    one shard of a table that fits is ``all``. A column named ``shard`` is an error; other names are free.
    """
    if "shard" in docs.columns:
        raise ValueError("a column named shard would be hidden by the folders")
    scratch = Scratch(docs.sparkSession, "sharding")
    directory, depths = build_directory(scratch.table(_keyed(docs), "keyed"), limit_bytes, scratch)
    whole = as_row(docs).withColumn("h", hash_bits(F.col("row.doc_id"), F.col("row.text")))
    out = _place(whole, directory, depths).withColumn("name", F.when(F.col("shard_depth") == 0, "all").otherwise(_shard_name()))
    # ranges rather than hashes: a large shard may go to several tasks, a task writes few shards
    out.repartitionByRange("name", "h").select("row.*", F.col("name").alias("shard")).write.partitionBy("shard").parquet(path)
