"""Tumbling, sliding and session windows, keep-first deduplication, and last windows as keyed state.

Each function takes a batch or a streaming frame. With ``late`` a streaming frame gets a watermark, which
bounds the state to the open windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _marked(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    return df.withWatermark(ts, late) if late and df.isStreaming else df


def _aggregate(df: DataFrame, window: Column, keys: list[str], value: str) -> DataFrame:
    out = df.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def tumbling(df: DataFrame, keys: list[str], value: str, size: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    return _aggregate(_marked(df, ts, late), F.window(ts, size), keys, value)


def sliding(df: DataFrame, keys: list[str], value: str, size: str, slide: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    return _aggregate(_marked(df, ts, late), F.window(ts, size, slide), keys, value)


def sessions(df: DataFrame, keys: list[str], value: str, gap: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    return _aggregate(_marked(df, ts, late), F.session_window(ts, gap), keys, value)


def dedupe(df: DataFrame, keys: list[str], ts: str = "ts", late: str | None = None) -> DataFrame:
    """One row for each key and timestamp; a stream forgets keys behind its watermark."""
    if df.isStreaming and late:
        return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([*keys, ts])
    return df.dropDuplicates([*keys, ts])


def last_windows(df: DataFrame, size: int) -> DataFrame:
    """The latest ``size`` values of each series of a stream ``series_id, ts, y``, kept as state and given out at each batch."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for frame in frames:
            held += list(zip(frame["ts"].astype("int64") // 1000, frame["y"], strict=True))
        held = sorted(held)[-size:]
        state.update(([int(t) for t, _ in held], [float(v) for _, v in held]))
        yield pd.DataFrame({"series_id": [key[0]], "n": [len(held)], "last_y": [float(held[-1][1])], "mean_y": [sum(v for _, v in held) / len(held)]})

    grouped = df.select("series_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("y").cast("double").alias("y")).groupBy("series_id")
    return grouped.applyInPandasWithState(update, "series_id string, n long, last_y double, mean_y double", "ts array<long>, y array<double>", "update", GroupStateTimeout.NoTimeout)
