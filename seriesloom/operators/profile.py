"""What a profile needs of each series, in as few passes as the aggregates permit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.frequency import WEEKDAYS, Freq, seconds_between
from seriesloom.sources.series import asfreq


def series_ranges(df: DataFrame) -> DataFrame:
    """First and last timestamp and the row count, rows without a value included."""
    return df.groupBy("series_id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("length"))


def target_stats(df: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and sample deviation of the values; one value has deviation 0, a series without values no row."""
    out = df.groupBy("series_id").agg(
        F.min("y").alias("min"), F.max("y").alias("max"), F.avg("y").alias("mean"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("std"), F.count("y").alias("n")
    )
    return out.where("n > 0").drop("n")


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values by series and column, where there are any."""
    missing = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    counts = df.groupBy("series_id").agg(*missing)
    return counts.unpivot(["series_id"], columns, "column", "missing").where("missing > 0")


def latest_start(df: DataFrame) -> DataFrame:
    """The latest of the series' first timestamps: one row."""
    return df.groupBy("series_id").agg(F.min("ts").alias("start")).agg(F.max("start").alias("latest_start"))


def span_length(df: DataFrame, freq: Freq | str) -> DataFrame:
    """Grid points from the earliest start to the latest end: one row."""
    freq = Freq.parse(freq) if isinstance(freq, str) else freq
    return df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.size(freq.grid(F.col("a"), F.col("b"))).cast("long").alias("span_length"))


def duplicate_timestamps(df: DataFrame) -> DataFrame:
    """Rows and distinct timestamps of each series, counted through (series, ts) groups so that no task holds a series' timestamps."""
    each = df.groupBy("series_id", "ts").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("series_id").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("timestamps"), (F.max("n") > 1).alias("has_duplicates"))


def gap_report(df: DataFrame, freq: Freq | str) -> DataFrame:
    """The grid points that each series lacks."""
    grid = asfreq(df.select("series_id", "ts").distinct(), freq).select("series_id", "ts")
    return grid.join(df.select("series_id", F.col("ts").cast("timestamp_ntz").alias("ts")).distinct(), ["series_id", "ts"], "left_anti")


def freq_deltas(df: DataFrame) -> DataFrame:
    """How often each distance in seconds between neighbours occurs."""
    w = Window.partitionBy("series_id").orderBy("ts")
    ts = F.col("ts").cast("timestamp_ntz")
    distinct = df.select("series_id", ts.alias("ts")).distinct()
    seconds = seconds_between(F.col("ts"), F.lead("ts").over(w))
    return distinct.withColumn("seconds", seconds).where("seconds is not null").groupBy("series_id", "seconds").agg(F.count(F.lit(1)).alias("n"))


def is_monotonic(df: DataFrame, order: str) -> DataFrame:
    """Whether timestamps never fall in the order of column ``order``, for each series."""
    w = Window.partitionBy("series_id").orderBy(order)
    return df.withColumn("_falls", F.col("ts") < F.lag("ts").over(w)).groupBy("series_id").agg((~F.max(F.coalesce("_falls", F.lit(False)))).alias("is_monotonic"))


# Clock steps with a name of their own.
_NAMED = {1: "s", 60: "min", 3600: "h", 86400: "D", 604800: "W"}


def frequency_evidence(df: DataFrame) -> DataFrame:
    """One row of what tells the frequency, over all distances between neighbours.

    ``total`` distances, the commonest ``step`` in seconds (ties to the shorter) and ``step_n`` of it, how many
    are as long as ``months``, ``quarters``, ``years`` and ``three_days``, the shares of timestamps that are
    ``first_days`` and ``last_days`` of a month, whether any is on a ``weekend``, and the commonest ``weekday``
    from Monday 0.
    """
    by = freq_deltas(df).groupBy("seconds").agg(F.sum("n").alias("n"))
    days = F.col("seconds") / 86400
    within = lambda lo, hi: F.coalesce(F.sum(F.when((days >= lo) & (days <= hi), F.col("n"))), F.lit(0)).cast("long")
    steps = by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.max_by("seconds", F.struct("n", -F.col("seconds"))).alias("step"), F.max("n").alias("step_n"),
        within(28, 31).alias("months"), within(90, 92).alias("quarters"), within(365, 366).alias("years"), within(3, 3).alias("three_days"),
    )
    weekdays = [F.count_if(F.weekday("ts") == i) for i in range(7)]
    stamps = df.agg(
        F.avg((F.dayofmonth("ts") == 1).cast("double")).alias("first_days"), F.avg((F.col("ts").cast("date") == F.last_day("ts")).cast("double")).alias("last_days"),
        F.max(F.weekday("ts") >= 5).alias("weekend"), (F.array_position(F.array(*weekdays), F.greatest(*weekdays)) - 1).cast("long").alias("weekday"),
    )
    return steps.crossJoin(F.broadcast(stamps))  # one row each


def alias_of(e: dict) -> str | None:
    """The alias that the evidence tells; None under two distances or without a regular step."""
    total, step = e["total"], e["step"]
    if total < 2:
        return None
    for base, n in (("M", e["months"]), ("Q", e["quarters"]), ("Y", e["years"])):
        if n > 0.8 * total:
            return f"{base}S" if e["first_days"] > 0.99 else f"{base}E" if e["last_days"] > 0.99 else None
    if step == 86400 and e["three_days"] > 0.1 * total and not e["weekend"]:
        return "B"
    if e["step_n"] < 0.5 * total or step <= 0:
        return None
    if step % 604800 == 0:
        return f"{step // 604800 if step > 604800 else ''}W-{list(WEEKDAYS)[e['weekday']]}"
    size = max(s for s in _NAMED if step % s == 0)
    return f"{step // size if step > size else ''}{_NAMED[size]}"


def infer_frequency(df: DataFrame) -> str | None:
    """The commonest distance as an alias; None under three timestamps or without a regular step.

    Months, quarters and years are told by the distances that they allow and by whether the
    timestamps are first or last days. Gaps do not hide the step: the commonest distance counts.
    """
    return alias_of(frequency_evidence(df).first().asDict())


def frame_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, minimum, maximum, mean and deviation of numeric columns, a row each, from one aggregate."""
    stats = {"count": F.count, "min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}
    row = df.agg(*[f(c).cast("double").alias(f"{c}|{s}") for c in columns for s, f in stats.items()])
    items = [F.struct(F.lit(c).alias("column"), *[F.col(f"`{c}|{s}`").alias(s) for s in stats]) for c in columns]
    return row.select(F.inline(F.array(*items)))
