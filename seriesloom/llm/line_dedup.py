"""Cross-site line removal by distinct-site spread.

A HyperLogLog sketch of the sites of each line hash is merged by aggregation, before and after the
shuffle. Lines clearly above the threshold are boilerplate, lines clearly below are not, and lines
within the sketch's error band get exact distinct counts. Removal joins line hashes, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm._store import Scratch

LG_K = 12
#: Six standard errors of a merged sketch, 1.04 / sqrt(2 ** LG_K) each.
BAND = 6 * 1.04 / 2 ** (LG_K / 2)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """A 64-bit hash of the trimmed line."""
    return F.xxhash64(F.trim(line))


def spread_lines(docs: DataFrame, min_sites: int, min_chars: int, scratch: Scratch) -> DataFrame:
    """Hashes ``line`` of the lines of ``docs(site, text)`` that stand on ``min_sites`` distinct sites or more."""
    rows = docs.select("site", F.explode(_lines(F.col("text"))).alias("raw")).where((F.length(F.trim("raw")) >= min_chars) & F.col("site").isNotNull())
    rows = rows.select("site", line_key(F.col("raw")).alias("line"))
    counted = rows.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    low, high = int(min_sites * (1 - BAND)) - 1, int(min_sites * (1 + BAND)) + 1
    counted = scratch.table(counted.where(F.col("sites") >= low), "spread")
    sure = counted.where(F.col("sites") > high).select("line")
    near = counted.where(F.col("sites") <= high).select("line")
    exact = rows.join(near, "line").distinct().groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("line")
    return scratch.table(sure.unionByName(exact), "boilerplate")


def remove_spread_lines(docs: DataFrame, min_sites: int = 5, min_chars: int = 20) -> DataFrame:
    """Each row of ``docs(doc_id, source, text)`` without boilerplate lines: ``doc_id, text, n_lines, n_removed``.

    A line is what stands between line feeds, compared without outer spaces; lines under ``min_chars``
    characters stay. ``source`` is the site; rows without one have their lines cleaned but count for
    no site. A null text stays null, with no lines; a text of nothing but boilerplate becomes empty.
    Rows that repeat are kept. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("site"), F.col("text").cast("string").alias("text"))
    spread = spread_lines(docs, min_sites, min_chars, scratch)
    lines = docs.where("text is not null").select(F.md5("text").alias("text_key"), F.explode(_lines(F.col("text"))).alias("raw")).where(F.length(F.trim("raw")) >= min_chars)
    hits = lines.select("text_key", line_key(F.col("raw")).alias("line")).join(spread, "line", "left_semi")
    # written, so that the join below is a stage of its own and a large group of copies can be split
    cut = scratch.table(hits.groupBy("text_key").agg(F.collect_set("line").alias("cut")), "cut")
    out = docs.withColumn("text_key", F.md5("text")).join(cut, "text_key", "left")
    gone = lambda raw: (F.length(F.trim(raw)) >= min_chars) & F.array_contains(F.col("cut"), line_key(raw))
    kept = F.when(F.col("cut").isNull(), _lines(F.col("text"))).otherwise(F.filter(_lines(F.col("text")), lambda raw: ~gone(raw)))
    out = out.withColumn("kept", kept)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text"))))
    n_kept = F.when(F.col("text").isNull(), 0).otherwise(F.size("kept"))
    return out.select("doc_id", F.array_join("kept", "\n").alias("text"), n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_removed"))
