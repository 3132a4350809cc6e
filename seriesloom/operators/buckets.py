"""Grids, windows and filling over series too long for one task.

A series is cut into buckets of positions. Rows near a bucket's end go to the next ones too, as far as windows
reach back, so that each bucket is windowed alone; what lies further back is carried over by one row a bucket.
No task holds more than a bucket and its halo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.frequency import Freq, seconds_between, seconds_on
from seriesloom.operators.features import add_features, window_size

#: Positions of a bucket.
BUCKET_ROWS = 1 << 18


def bucketed_asfreq(df: DataFrame, freq: Freq | str, rows: int = BUCKET_ROWS) -> DataFrame:
    """As ``asfreq`` with a fixed step: ``series_id, ts, pos`` and the columns of ``df``, nulls where rows are missing.

    Buckets of the grid unfold in tasks of their own and meet the rows by series and position. Rows beside
    the grid go, repeated timestamps stay.
    """
    freq = Freq.parse(freq) if isinstance(freq, str) else freq
    if not freq.seconds:
        raise ValueError("buckets need a fixed step")
    df = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    spans = df.groupBy("series_id").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    last = F.floor(seconds_between(F.col("_first"), F.col("_last")) / freq.seconds).cast("long")
    buckets = spans.select("series_id", "_first", last.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / rows))).alias("_b"))
    buckets = buckets.repartition("series_id", "_b")
    grid = buckets.select("series_id", "_first", F.explode(F.sequence(F.col("_b") * rows, F.least((F.col("_b") + 1) * rows - 1, F.col("_n")))).alias("pos"))
    grid = grid.select("series_id", seconds_on(F.col("_first"), F.col("pos") * freq.seconds).cast("timestamp_ntz").alias("ts"), "pos")
    return grid.join(df, ["series_id", "ts"], "left")


def _spread(grid: DataFrame, reach: int, rows: int) -> DataFrame:
    """Each row in its bucket and in those that look back at it; ``series_id`` names series and bucket together."""
    buckets = F.sequence(F.floor(F.col("pos") / rows), F.floor((F.col("pos") + reach) / rows))
    out = grid.withColumn("_b", F.explode(buckets))
    return out.withColumns({"_own": F.col("_b") == F.floor(F.col("pos") / rows), "series_id": F.struct(F.col("series_id").alias("id"), F.col("_b").alias("b"))}).drop("_b")


def _gathered(spread: DataFrame) -> DataFrame:
    return spread.where("_own").drop("_own").withColumn("series_id", F.col("series_id.id"))


def bucketed_features(grid: DataFrame, lags: int | list[int] | None = None, windows: list[tuple[str, int]] | None = None, column: str = "y", rows: int = BUCKET_ROWS) -> DataFrame:
    """As ``add_features`` over the grid, by buckets: lags and rolling statistics, the same values."""
    return _gathered(add_features(_spread(grid, window_size(lags, windows), rows), lags, windows, column))


def bucketed_difference(grid: DataFrame, order: int = 1, column: str = "y", out: str = "diff", rows: int = BUCKET_ROWS) -> DataFrame:
    """As ``difference``, by buckets."""
    from seriesloom.operators.features import difference

    return _gathered(difference(_spread(grid, order, rows), order, column, out))


def bucketed_fill(grid: DataFrame, method: str = "forward", column: str = "y", out: str = "filled", rows: int = BUCKET_ROWS) -> DataFrame:
    """As ``forward_fill`` or linear ``interpolate``, by buckets.

    The last value of each bucket, and for interpolation the first, are one row a bucket; running over these
    rows carries them to buckets that have none. Values within a bucket are found by its own window.
    """
    if method not in ("forward", "interpolate"):
        raise ValueError("fill is forward or interpolate")
    bucket = F.floor(F.col("pos") / rows)
    known = F.col(column).isNotNull()
    point = F.struct(F.col("pos").alias("p"), F.col(column).cast("double").alias("v"))
    cut = grid.withColumn("_b", bucket)
    ends = cut.groupBy("series_id", "_b").agg(F.max(F.when(known, point)).alias("_end"), F.min(F.when(known, point)).alias("_begin"))
    over = Window.partitionBy("series_id").orderBy("_b")
    before = F.last("_end", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_begin", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
    carried = ends.select("series_id", "_b", before.alias("_before"), after.alias("_after"))
    inside = Window.partitionBy("series_id", "_b").orderBy("pos")
    back = F.last(F.when(known, point), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(F.when(known, point), ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    met = cut.withColumns({"_l": back, "_r": ahead}).join(carried, ["series_id", "_b"])
    left, right = F.coalesce("_l", "_before"), F.coalesce("_r", "_after")
    if method == "forward":
        value: Column = left["v"]
    else:
        share = (F.col("pos") - left["p"]) / (right["p"] - left["p"])
        line = left["v"] + (right["v"] - left["v"]) * share
        value = F.when(known, F.col(column).cast("double")).when(right["p"] > left["p"], line)
    return met.withColumn(out, value).drop("_b", "_l", "_r", "_before", "_after")
