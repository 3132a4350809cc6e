"""Sources and sinks: parquet, CSV with a detected date column, pandas frames and series."""

from __future__ import annotations

import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, parse_dates: bool = True) -> DataFrame:
    """CSV with a header. Without a schema types are inferred and the first text column whose values all parse becomes a timestamp.

    An http(s) address is fetched on the driver, so it should name a small file; large ones belong on
    a file system that executors read.
    """
    if path.startswith(("http://", "https://")):
        with urllib.request.urlopen(path) as r:
            lines = r.read().decode().splitlines()
        rows = spark.sparkContext.parallelize(lines, 1) if hasattr(spark, "sparkContext") else lines
        df = spark.read.csv(rows, header=True, schema=schema, inferSchema=schema is None)
    else:
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return detect_date(df) if parse_dates and schema is None else df


def detect_date(df: DataFrame) -> DataFrame:
    """Turn the first text column whose non-null values all parse into a timestamp; one aggregate over all text columns."""
    if any(isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) for f in df.schema):
        return df
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    parsed = lambda c: F.try_to_timestamp(F.col(f"`{c}`"))
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(texts)], *[F.count(parsed(c)).alias(f"p{i}") for i, c in enumerate(texts)]).first()
    for i, c in enumerate(texts):
        if counts[f"n{i}"] and counts[f"n{i}"] == counts[f"p{i}"]:
            return df.withColumn(c, parsed(c).cast("timestamp_ntz"))
    return df


def from_pandas(spark: SparkSession, data, name: str = "y") -> DataFrame:
    """A pandas frame or series; a datetime index becomes the column ``ts`` (or its name)."""
    import pandas as pd

    if isinstance(data, pd.Series):
        data = data.to_frame(data.name or name)
    if isinstance(data.index, pd.DatetimeIndex):
        data = data.rename_axis(data.index.name or "ts").reset_index()
    elif isinstance(data.index, pd.MultiIndex):
        names = [n or d for n, d in zip(data.index.names, ["series_id", "ts", *map(str, range(9))], strict=False)]
        data = data.rename_axis(names).reset_index()
    return spark.createDataFrame(data)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    """Write predictions or metrics as parquet, CSV (with a header) or JSON lines."""
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown kind {kind!r}: parquet, csv or json")


def local_json(path: str) -> dict:
    """A record bundle (a profile or plan) from a small local file, or from standard input for ``-``."""
    import json
    import sys

    return json.loads(sys.stdin.read() if path == "-" else Path(path).read_text())
