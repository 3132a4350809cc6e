"""Canonical long form: reshaping, deduplication, regular grids and gap filling.

All windows are partitioned by series, so work spreads over series; one series is one task's window.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.frequency import Freq, seconds_between, seconds_on


def canonical(df: DataFrame, ts: str, target: str | list[str], series_id: str | None = None, exog: list[str] | None = None) -> DataFrame:
    """``series_id, ts, y`` and the exogenous columns, from a single, wide or long table.

    A list of targets makes a wide table long. NaN becomes null; rows without a series id or a
    timestamp are left out.
    """
    exog = exog or []
    at = F.col(ts).cast("timestamp_ntz").alias("ts")
    if isinstance(target, list):
        df = wide_to_long(df.select(at, *target, *exog), "ts", target, exog)
    elif series_id:
        df = df.select(F.col(series_id).cast("string").alias("series_id"), at, F.col(target).alias("y"), *exog)
    else:
        df = df.select(F.lit(target).alias("series_id"), at, F.col(target).alias("y"), *exog)
    y = F.col("y").cast("double")
    return df.withColumn("y", F.when(~F.isnan(y), y)).where("series_id is not null and ts is not null")


def wide_to_long(df: DataFrame, ts: str, targets: list[str], exog: list[str] | None = None) -> DataFrame:
    """A row for each target column: no shuffle."""
    doubles = [F.col(t).cast("double").alias(t) for t in targets]
    return df.select(ts, *(exog or []), *doubles).unpivot([ts, *(exog or [])], targets, "series_id", "y").select("series_id", ts, "y", *(exog or []))


def long_to_wide(df: DataFrame, series: list[str], value: str = "y", ts: str = "ts") -> DataFrame:
    """A column for each named series, the mean where timestamps repeat. The list avoids a job to find them."""
    return df.groupBy(ts).pivot("series_id", series).agg(F.avg(value))


def dedupe_keep_first(df: DataFrame, order: Column, keys: tuple[str, ...] = ("series_id", "ts")) -> DataFrame:
    """The first row by ``order`` for each series and timestamp.

    A grouped minimum, combined before the shuffle, instead of a sorted window.
    """
    row = F.struct(*df.columns)
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(row, order).alias("_row")).select("_row.*")


def asfreq(df: DataFrame, freq: Freq | str, keys: list[str] | None = None, origin: datetime | None = None) -> DataFrame:
    """Each series on its regular grid from its first to its last timestamp, nulls where rows are missing, with 0-based ``pos``.

    Positions count from each series' own start or, with ``origin`` (the panel's first timestamp), from
    there: a position is then one moment in all series, as folds over a ragged panel need. A series beside
    the origin's grid is placed at the step that it has last passed.
    """
    freq = Freq.parse(freq) if isinstance(freq, str) else freq
    keys = keys or ["series_id"]
    if freq.seconds:
        return _fill_steps(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), freq.seconds, keys, origin)
    spans = df.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    grid = spans.select(*keys, F.posexplode(freq.grid(F.col("_a"), F.col("_b"))).alias("pos", "ts"), *([(F.size(freq.grid(F.lit(origin), F.col("_a"))) - 1).alias("_before")] if origin else []))
    grid = grid.withColumn("pos", (F.col("pos") + F.col("_before") if origin else F.col("pos")).cast("long")).select(*keys, "ts", "pos")
    return grid.join(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), [*keys, "ts"], "left")


def _fill_steps(df: DataFrame, seconds: int, keys: list[str], origin: datetime | None = None) -> DataFrame:
    """The grid of a fixed step: each row unfolds to itself and the steps missing until the next row.

    One window by series, whose partitioning later windows share; the table is neither scanned twice nor
    joined with its grid. Rows beside the grid go, repeated timestamps stay.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    first = F.min("ts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    step = F.floor(seconds_between(F.col("_first"), F.col("ts")) / seconds)
    rows = df.withColumn("_first", first).withColumn("pos", step.cast("long"))
    rows = rows.where(seconds_on(F.col("_first"), F.col("pos") * seconds) == F.col("ts"))
    rows = rows.withColumn("_missing", F.coalesce(F.lead("pos").over(w) - F.col("pos") - 1, F.lit(0).cast("long")))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_missing"), F.lit(0).cast("long")))))
    own = F.col("_k") == 0
    at = seconds_on(F.col("ts"), F.col("_k") * seconds)
    others = [c for c in df.columns if c not in (*keys, "ts")]
    before = F.floor(seconds_between(F.lit(origin), F.col("_first")) / seconds).cast("long") if origin else F.lit(0).cast("long")
    return rows.select(*keys, at.alias("ts"), (F.col("pos") + F.col("_k") + before).alias("pos"), *[F.when(own, F.col(c)).alias(c) for c in others])


def forward_fill(df: DataFrame, column: str = "y", out: str = "filled") -> DataFrame:
    w = Window.partitionBy("series_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(w))


def interpolate(df: DataFrame, column: str = "y", out: str = "filled") -> DataFrame:
    """Linear between the known neighbours by position; nulls before the first and after the last known stay."""
    back = Window.partitionBy("series_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("series_id").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(column).isNotNull(), F.col("pos"))
    df = (
        df.withColumn("_p0", F.last(known, ignorenulls=True).over(back))
        .withColumn("_y0", F.last(column, ignorenulls=True).over(back))
        .withColumn("_p1", F.first(known, ignorenulls=True).over(ahead))
        .withColumn("_y1", F.first(column, ignorenulls=True).over(ahead))
    )
    share = (F.col("pos") - F.col("_p0")) / (F.col("_p1") - F.col("_p0"))
    line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * share
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.col(column)).when(F.col("_p1") > F.col("_p0"), line)).drop("_p0", "_y0", "_p1", "_y1")

