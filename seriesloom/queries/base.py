"""Logical series of the test tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.sources.series import asfreq


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder for files of a query: of the session's checkpoint folder, or on a local session a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return f"{folder.rstrip('/')}/queries-{uuid.uuid4().hex[:12]}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="seriesloom-queries-")


def rounded(c: Column | str, digits: int = 4) -> Column:
    """Rounded for comparison across engines, without negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)).cast("double")


def stamp(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue, a single series: exact decimal sums."""
    line = table(spark, sf_dir, "lineitem")
    money = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    out = line.groupBy(F.col("l_shipdate").cast("date").cast("timestamp_ntz").alias("ts")).agg(F.sum(money).cast("double").alias("y"))
    return out.select(F.lit("revenue").alias("series_id"), "ts", "y")


def revenue_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asfreq(revenue(spark, sf_dir), "D")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly event counts by type, a ragged long panel."""
    events = table(spark, sf_dir, "events")
    out = events.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return out


def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asfreq(hourly(spark, sf_dir), "h")


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("y"))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily events by user, a panel whose series start and end on different days."""
    events = table(spark, sf_dir, "events").where("user_id is not null")
    return events.groupBy(F.col("user_id").cast("string").alias("series_id"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("y"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly orders by priority, a long panel."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("y"))


REVENUE = """
revenue AS (
  SELECT 'revenue' AS series_id, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
    sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS y
  FROM lineitem GROUP BY ALL),
revenue_axis AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY))::TIMESTAMP AS ts FROM revenue),
revenue_grid AS (
  SELECT 'revenue' AS series_id, a.ts, row_number() OVER (ORDER BY a.ts) - 1 AS pos, r.y
  FROM revenue_axis a LEFT JOIN revenue r ON a.ts = r.ts)"""

HOURLY = """
hourly AS (
  SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, count(*)::DOUBLE AS y FROM events GROUP BY ALL),
hourly_axis AS (
  SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 HOUR))::TIMESTAMP AS ts
  FROM (SELECT series_id, min(ts) AS a, max(ts) AS b FROM hourly GROUP BY ALL)),
hourly_grid AS (
  SELECT x.series_id, x.ts, row_number() OVER (PARTITION BY x.series_id ORDER BY x.ts) - 1 AS pos, h.y
  FROM hourly_axis x LEFT JOIN hourly h ON x.series_id = h.series_id AND x.ts = h.ts)"""

DAILY = """
daily AS (SELECT event_type AS series_id, date_trunc('day', ts)::TIMESTAMP AS ts, count(*)::DOUBLE AS y FROM events GROUP BY ALL)"""

USER_DAYS = """
user_days AS (
  SELECT user_id::VARCHAR AS series_id, date_trunc('day', ts)::TIMESTAMP AS ts, count(*)::DOUBLE AS y FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
user_axis AS (
  SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::TIMESTAMP AS ts, min(a) OVER () AS origin
  FROM (SELECT series_id, min(ts) AS a, max(ts) AS b FROM user_days GROUP BY ALL)),
user_grid AS (
  SELECT x.series_id, x.ts, date_diff('day', origin, x.ts) AS pos, coalesce(u.y, 0) AS y
  FROM user_axis x LEFT JOIN user_days u ON x.series_id = u.series_id AND x.ts = u.ts)"""

MONTHLY = """
monthly AS (
  SELECT o_orderpriority AS series_id, date_trunc('month', o_orderdate)::TIMESTAMP AS ts, count(*)::DOUBLE AS y FROM orders GROUP BY ALL)"""


def rsql(expression: str, digits: int = 4) -> str:
    return f"(round({expression}, {digits}) + 0.0)::DOUBLE"
