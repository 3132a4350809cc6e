"""One query for each operator, and the DuckDB statement that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriesloom.functions import calendar, scaling
from seriesloom.functions.frequency import Freq
from seriesloom.operators import autocorrelation, drift, evaluation, features, profile
from seriesloom.plans import models
from seriesloom.plans.assistant import Assistant
from seriesloom.queries.base import DAILY, HOURLY, MONTHLY, REVENUE, USER_DAYS, daily_events, hourly, hourly_grid, monthly, revenue, revenue_grid, rounded, rsql, scratch, stamp, table, user_days
from seriesloom.sources import series, tables
from seriesloom.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Event types, the series of the wide tables; naming them saves the job that would find them.
TYPES = ["click", "error", "purchase", "signup", "view"]


def register(sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


# Profile aggregates


@register(f"WITH {HOURLY} SELECT series_id, min(ts) AS start, max(ts) AS \"end\", count(*)::BIGINT AS length FROM hourly GROUP BY ALL")
def series_ranges(spark, d):
    return profile.series_ranges(hourly(spark, d))


@register(f"""WITH {HOURLY} SELECT series_id, min(y) AS min, max(y) AS max, {rsql("avg(y)", 6)} AS mean, {rsql("coalesce(stddev_samp(y), 0)", 6)} AS std
FROM hourly_grid GROUP BY ALL HAVING count(y) > 0""")
def target_stats(spark, d):
    out = profile.target_stats(hourly_grid(spark, d))
    return out.select("series_id", "min", "max", rounded("mean", 6).alias("mean"), rounded("std", 6).alias("std"))


@register(f"""WITH {HOURLY} SELECT series_id, 'y' AS "column", count_if(y IS NULL)::BIGINT AS missing FROM hourly_grid GROUP BY ALL HAVING count_if(y IS NULL) > 0""")
def missing_counts(spark, d):
    return profile.missing_counts(hourly_grid(spark, d), ["y"])


@register(f"WITH {HOURLY} SELECT max(a) AS latest_start FROM (SELECT min(ts) AS a FROM hourly GROUP BY series_id)")
def latest_start(spark, d):
    return profile.latest_start(hourly(spark, d))


@register(f"WITH {HOURLY} SELECT len(generate_series(min(ts), max(ts), INTERVAL 1 HOUR))::BIGINT AS span_length FROM hourly")
def span_length(spark, d):
    return profile.span_length(hourly(spark, d), "h")


@register("""SELECT event_type AS series_id, count(*)::BIGINT AS rows, count(DISTINCT date_trunc('hour', ts))::BIGINT AS timestamps,
count(*) > count(DISTINCT date_trunc('hour', ts)) AS has_duplicates FROM events GROUP BY 1""")
def duplicate_timestamps(spark, d):
    events = table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("ts"))
    return profile.duplicate_timestamps(events)


@register(f"WITH {HOURLY} SELECT series_id, ts FROM hourly_grid WHERE y IS NULL")
def gap_report(spark, d):
    return profile.gap_report(hourly(spark, d), "h")


@register(f"""WITH {HOURLY}, deltas AS (
SELECT series_id, (epoch(lead(ts) OVER (PARTITION BY series_id ORDER BY ts)) - epoch(ts))::BIGINT AS seconds FROM hourly)
SELECT series_id, seconds, count(*)::BIGINT AS n FROM deltas WHERE seconds IS NOT NULL GROUP BY ALL""")
def freq_deltas(spark, d):
    return profile.freq_deltas(hourly(spark, d))


@register(f"""SELECT unnest(['l_quantity', 'l_discount']) AS "column", unnest([count(l_quantity), count(l_discount)])::DOUBLE AS count,
unnest([min(l_quantity), min(l_discount)]) AS min, unnest([max(l_quantity), max(l_discount)]) AS max,
unnest([{rsql("avg(l_quantity)", 6)}, {rsql("avg(l_discount)", 6)}]) AS mean,
unnest([{rsql("stddev_samp(l_quantity)", 6)}, {rsql("stddev_samp(l_discount)", 6)}]) AS std FROM lineitem""")
def frame_summary(spark, d):
    out = profile.frame_summary(table(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    return out.select("column", "count", "min", "max", rounded("mean", 6).alias("mean"), rounded("std", 6).alias("std"))


@register(f"""WITH {HOURLY}, d AS (SELECT series_id, (epoch(lead(ts) OVER (PARTITION BY series_id ORDER BY ts)) - epoch(ts))::BIGINT AS s FROM hourly),
n AS (SELECT s, count(*) AS n FROM d WHERE s IS NOT NULL GROUP BY 1)
SELECT sum(n)::BIGINT AS total, arg_max(s, (n, -s)) AS step, max(n)::BIGINT AS step_n, coalesce(sum(n) FILTER (s BETWEEN 28 * 86400 AND 31 * 86400), 0)::BIGINT AS months,
coalesce(sum(n) FILTER (s = 3 * 86400), 0)::BIGINT AS three_days,
{rsql("(SELECT avg((day(ts) = 1)::INT) FROM hourly)", 6)} AS first_days, (SELECT bool_or(isodow(ts) >= 6) FROM hourly) AS weekend FROM n""")
def frequency_evidence(spark, d):
    out = profile.frequency_evidence(hourly(spark, d))
    return out.select("total", "step", "step_n", "months", "three_days", rounded("first_days", 6).alias("first_days"), "weekend")


@register("""WITH m AS (SELECT event_type AS series_id, ts < lag(ts) OVER (PARTITION BY event_type ORDER BY event_id) AS falls FROM events)
SELECT series_id, NOT bool_or(coalesce(falls, false)) AS is_monotonic FROM m GROUP BY 1""")
def is_monotonic(spark, d):
    return profile.is_monotonic(table(spark, d, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id"), "event_id")


@register(f"""WITH {HOURLY}, p AS (SELECT h.series_id, count(*) AS length, min(ts) AS a, max(ts) AS b, min(y) AS lo, max(y) AS hi, avg(y) AS m, stddev_samp(y) AS s FROM hourly h GROUP BY 1)
SELECT series_id, a AS start, b AS "end", length::BIGINT AS length, lo AS min, hi AS max, {rsql("m", 6)} AS mean, {rsql("s", 5)} AS std, len(generate_series(a, b, INTERVAL 1 HOUR))::BIGINT AS grid_length FROM p""")
def series_profile(spark, d):
    out = Assistant(hourly(spark, d), "ts", "y", "series_id", freq="h").series_profile("h")
    return out.select("series_id", "start", "end", F.col("length").cast("long").alias("length"), "min", "max", rounded("mean", 6).alias("mean"), rounded("std", 5).alias("std"), "grid_length")


@register(f"""WITH {HOURLY} SELECT count(DISTINCT series_id)::BIGINT AS n_series, count(*)::BIGINT AS n_observations, len(generate_series(min(ts), max(ts), INTERVAL 1 HOUR))::BIGINT AS span,
(SELECT bool_or(y IS NULL) FROM hourly_grid) AS has_gaps, false AS has_duplicates, (SELECT min(c) FROM (SELECT count(*) AS c FROM hourly GROUP BY series_id))::BIGINT AS shortest FROM hourly""")
def data_profile(spark, d):
    p = Assistant(hourly(spark, d), "ts", "y", "series_id", freq="h").profile()
    return spark.createDataFrame([(p.n_series, p.n_observations, p.span, p.has_gaps, p.has_duplicates, p.shortest)], "n_series long, n_observations long, span long, has_gaps boolean, has_duplicates boolean, shortest long")


@register("""SELECT o_orderdate::TIMESTAMP AS day, o_orderkey, o_totalprice FROM orders""")
def csv_scan(spark, d):
    """Orders written as CSV with dates as text, and read with the date column detected."""
    path = f"{scratch(spark)}/orders-csv"
    tables.write(table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey", "o_totalprice"), path, "csv", "overwrite")
    return tables.read_csv(spark, path, "day string, o_orderkey long, o_totalprice double").transform(tables.detect_date)


@register(f"WITH {MONTHLY} SELECT series_id, ts, y FROM monthly")
def json_sink(spark, d):
    """A result written as JSON lines and read back."""
    path = f"{scratch(spark)}/monthly-json"
    tables.write(monthly(spark, d), path, "json", "overwrite")
    return spark.read.schema("series_id string, ts timestamp_ntz, y double").json(path)


@register("SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def pandas_input(spark, d):
    frame = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name").toPandas()  # five rows
    return tables.from_pandas(spark, frame)


# Features


@register(f"""WITH {HOURLY} SELECT series_id, ts, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, lag(y, 24) OVER w AS lag_24
FROM hourly_grid WINDOW w AS (PARTITION BY series_id ORDER BY pos)""")
def lag_features(spark, d):
    return features.add_features(hourly_grid(spark, d), [1, 2, 24]).select("series_id", "ts", "lag_1", "lag_2", "lag_24")


_W7 = "WINDOW w AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"


def _rolling(spark, d, stats, digits):
    out = features.add_features(revenue_grid(spark, d), windows=[(s, 7) for s in stats])
    return out.select("ts", *[rounded(features.rolling_name(s, 7), n).alias(features.rolling_name(s, 7)) for s, n in zip(stats, digits, strict=True)])


def _full(expression: str, digits: int = 4) -> str:
    return f"CASE WHEN count(y) OVER w = 7 THEN {rsql(expression, digits)} END"


@register(f"""WITH {REVENUE} SELECT ts, {_full("avg(y) OVER w", 3)} AS roll_mean_7, {_full("stddev_samp(y) OVER w", 3)} AS roll_std_7 FROM revenue_grid {_W7}""")
def rolling_mean_std(spark, d):
    return _rolling(spark, d, ["mean", "std"], [3, 3])


@register(f"""WITH {REVENUE} SELECT ts, {_full("min(y) OVER w")} AS roll_min_7, {_full("max(y) OVER w")} AS roll_max_7, {_full("sum(y) OVER w", 4)} AS roll_sum_7 FROM revenue_grid {_W7}""")
def rolling_min_max_sum(spark, d):
    return _rolling(spark, d, ["min", "max", "sum"], [4, 4, 4])


@register(f"""WITH {REVENUE} SELECT ts, {_full("median(y) OVER w")} AS roll_median_7 FROM revenue_grid {_W7}""")
def rolling_median(spark, d):
    return _rolling(spark, d, ["median"], [4])


@register(f"""WITH {REVENUE} SELECT ts, {_full("min(y) OVER w / max(y) OVER w", 8)} AS roll_ratio_min_max_7,
{_full("stddev_samp(y) OVER w / avg(y) OVER w", 8)} AS roll_coef_variation_7 FROM revenue_grid {_W7}""")
def rolling_ratio_cv(spark, d):
    return _rolling(spark, d, ["ratio_min_max", "coef_variation"], [8, 8])


@register(f"""WITH {REVENUE} SELECT ts, {rsql("CASE WHEN count(y) OVER w >= 2 THEN avg(y) OVER w END", 3)} AS mean_of_two_or_more FROM revenue_grid {_W7}""")
def rolling_min_periods(spark, d):
    grid = revenue_grid(spark, d)
    return grid.withColumn("m", features.rolling_column("mean", 7, min_periods=2)).select("ts", rounded("m", 3).alias("mean_of_two_or_more"))


@register(f"""WITH {REVENUE} SELECT ts, {rsql("CASE WHEN count(y) OVER w = 7 THEN max(y) OVER w - min(y) OVER w END", 4)} AS roll_range_7 FROM revenue_grid {_W7}""")
def custom_window(spark, d):
    """A statistic of the caller's own among the rolling windows."""
    features.register_statistic("range", lambda y, w: F.max(y).over(w) - F.min(y).over(w), lambda v, axis: v.max(axis) - v.min(axis))
    grid = features.add_features(revenue_grid(spark, d), windows=[("range", 7)])
    return grid.select("ts", rounded("roll_range_7", 4).alias("roll_range_7"))


@register(f"""WITH {HOURLY}, x AS (SELECT series_id, ts, pos, coalesce(y, 0) AS y FROM hourly_grid),
d AS (SELECT *, first_value(y) OVER w AS anchor, y - lag(y) OVER w AS diff FROM x WINDOW w AS (PARTITION BY series_id ORDER BY pos)) SELECT series_id, ts, y FROM x""")
def undifference(spark, d):
    """First differences, and the series that comes of them again."""
    grid = _filled(spark, d)
    first = F.first("y").over(Window.partitionBy("series_id").orderBy("pos"))
    return features.undifference(features.difference(grid).withColumn("anchor", first).drop("y"), "anchor").select("series_id", "ts", "y")


_EWM = " + ".join(f"lag(y, {i + 1}) OVER w * {0.7**i!r}" for i in range(7))


@register(f"""WITH {REVENUE} SELECT ts, {rsql(f"({_EWM}) / {sum(0.7**i for i in range(7))!r}", 3)} AS "roll_ewm_7_alpha_0.3"
FROM revenue_grid WINDOW w AS (PARTITION BY series_id ORDER BY pos)""")
def rolling_ewm(spark, d):
    out = features.add_features(revenue_grid(spark, d), windows=[("ewm", 7)])
    return out.select("ts", rounded("`roll_ewm_7_alpha_0.3`", 3).alias("roll_ewm_7_alpha_0.3"))


@register(f"""WITH {HOURLY} SELECT series_id, ts, y - 2 * lag(y, 1) OVER w + lag(y, 2) OVER w AS diff FROM hourly_grid
WINDOW w AS (PARTITION BY series_id ORDER BY pos)""")
def difference(spark, d):
    return features.difference(hourly_grid(spark, d), 2).select("series_id", "ts", "diff")


@register(f"""WITH {REVENUE}, f AS (
SELECT ts, pos, y, lag(y, 1) OVER o AS lag_1, lag(y, 2) OVER o AS lag_2, {_full("avg(y) OVER w", 3)} AS roll_mean_7 FROM revenue_grid
WINDOW o AS (ORDER BY pos), w AS (ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT ts, y, lag_1, lag_2, roll_mean_7 FROM f WHERE pos >= 7 AND y IS NOT NULL AND lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND roll_mean_7 IS NOT NULL""")
def train_matrix(spark, d):
    out = features.train_matrix(revenue_grid(spark, d), [1, 2], [("mean", 7)])
    return out.select("ts", "y", "lag_1", "lag_2", rounded("roll_mean_7", 3).alias("roll_mean_7"))


@register(f"""WITH {HOURLY}, f AS (
SELECT series_id, ts, pos, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, [y, lead(y, 1) OVER w, lead(y, 2) OVER w] AS leads
FROM hourly_grid WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
s AS (SELECT series_id, ts, pos, lag_1, lag_2, unnest([1, 2, 3])::BIGINT AS step, unnest(leads) AS target FROM f WHERE pos >= 2)
SELECT * FROM s WHERE target IS NOT NULL""")
def direct_targets(spark, d):
    return features.direct_targets(hourly_grid(spark, d), [1, 2], 3)


_PIVOT = ", ".join(f"max(CASE WHEN series_id = '{t}' THEN y END) AS {t}" for t in TYPES)
_LAGGED = ", ".join(f"lag({t}, {k}) OVER w AS {t}_lag_{k}" for t in TYPES for k in (1, 2))


@register(f"""WITH {DAILY}, wide AS (SELECT ts, {_PIVOT} FROM daily GROUP BY ts) SELECT ts, {", ".join(TYPES)}, {_LAGGED} FROM wide WINDOW w AS (ORDER BY ts)""")
def multivariate_lags(spark, d):
    return features.multivariate_lags(daily_events(spark, d), TYPES, [1, 2])


@register(f"WITH {MONTHLY} SELECT series_id, (dense_rank() OVER (ORDER BY series_id) - 1)::BIGINT AS series_code FROM (SELECT DISTINCT series_id FROM monthly)")
def series_encoding(spark, d):
    return features.series_encoding(monthly(spark, d))


@register(f"""WITH {REVENUE}, e AS (SELECT ts, pos, CASE WHEN day(ts) = 1 THEN pos END AS hit FROM revenue_grid)
SELECT ts, coalesce(pos - max(hit) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING), -1)::BIGINT AS since,
coalesce(min(hit) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - pos, -1)::BIGINT AS until FROM e""")
def event_distance(spark, d):
    return features.event_distance(revenue_grid(spark, d), F.dayofmonth("ts") == 1, -1).select("ts", "since", "until")


@register(f"""WITH {HOURLY} SELECT series_id, ts, last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS filled FROM hourly_grid""")
def ffill(spark, d):
    return series.forward_fill(hourly_grid(spark, d)).select("series_id", "ts", "filled")


@register(f"""WITH {HOURLY}, k AS (
SELECT *, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, last_value(y IGNORE NULLS) OVER b AS y0,
  first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS p1, first_value(y IGNORE NULLS) OVER a AS y1
FROM hourly_grid WINDOW b AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  a AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series_id, ts, {rsql("CASE WHEN y IS NOT NULL THEN y WHEN p1 > p0 THEN y0 + (y1 - y0) * ((pos - p0)::DOUBLE / (p1 - p0)) END", 6)} AS filled FROM k""")
def interpolate(spark, d):
    return series.interpolate(hourly_grid(spark, d)).select("series_id", "ts", rounded("filled", 6).alias("filled"))


# Reshaping


@register("""SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, min(event_id)::BIGINT AS event_id FROM events GROUP BY ALL""")
def dedupe_keep_first(spark, d):
    events = table(spark, d, "events").select(F.col("event_type").alias("series_id"), stamp(F.date_trunc("hour", "ts")).alias("ts"), "event_id", "value")
    return series.dedupe_keep_first(events, F.col("event_id")).select("series_id", "ts", "event_id")


@register(f"""WITH {DAILY}, wide AS (SELECT ts, {_PIVOT} FROM daily GROUP BY ts)
SELECT unnest([{", ".join(f"'{t}'" for t in TYPES)}]) AS series_id, ts, unnest([{", ".join(TYPES)}]) AS y FROM wide""")
def wide_to_long(spark, d):
    return series.wide_to_long(series.long_to_wide(daily_events(spark, d), TYPES), "ts", TYPES)


@register(f"WITH {DAILY} SELECT ts, {_PIVOT} FROM daily GROUP BY ts")
def long_to_wide(spark, d):
    return series.long_to_wide(daily_events(spark, d), TYPES)


@register(f"WITH {HOURLY} SELECT series_id, ts, pos::BIGINT AS pos, y FROM hourly_grid")
def long_asfreq(spark, d):
    return hourly_grid(spark, d).select("series_id", "ts", "pos", "y")


@register(f"WITH {MONTHLY} SELECT series_id, ts, y FROM monthly")
def monthly_long(spark, d):
    return monthly(spark, d)


# Calendar and scaling


@register("""SELECT DISTINCT date_trunc('day', l_shipdate)::TIMESTAMP AS ts, year(l_shipdate)::BIGINT AS year, quarter(l_shipdate)::BIGINT AS quarter,
month(l_shipdate)::BIGINT AS month, weekofyear(l_shipdate)::BIGINT AS week, (isodow(l_shipdate) - 1)::BIGINT AS day_of_week,
day(l_shipdate)::BIGINT AS day_of_month, dayofyear(l_shipdate)::BIGINT AS day_of_year, (isodow(l_shipdate) >= 6)::BIGINT AS weekend FROM lineitem""")
def calendar_raw(spark, d):
    names = ["year", "quarter", "month", "week", "day_of_week", "day_of_month", "day_of_year", "weekend"]
    return calendar.add_calendar(revenue(spark, d), names).drop("series_id", "y")


_TURN = 2 * 3.141592653589793


@register(f"""WITH {HOURLY} SELECT DISTINCT ts, {", ".join(rsql(f"{f}({v} * ({_TURN!r} / {p}))", 6) + f" AS {n}_{f}" for n, v, p in
(("hour", "hour(ts)", 24), ("day_of_week", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12)) for f in ("sin", "cos"))} FROM hourly""")
def calendar_cyclical(spark, d):
    out = calendar.add_calendar(hourly(spark, d).select("ts").distinct(), ["hour", "day_of_week", "month"], "cyclical")
    return out.select("ts", *[rounded(c, 6).alias(c) for c in out.columns if c != "ts"])


@register(f"""WITH {REVENUE} SELECT ts, {", ".join(f"(isodow(ts) - 1 = {i})::BIGINT AS day_of_week_{i}" for i in range(7))} FROM revenue""")
def calendar_onehot(spark, d):
    return calendar.add_calendar(revenue(spark, d), ["day_of_week"], "onehot").drop("series_id", "y")


_HAT = lambda g: f"CASE WHEN {g} < 1 THEN (4 - 6 * {g} ** 2 + 3 * {g} ** 3) / 6 WHEN {g} < 2 THEN (2 - {g}) ** 3 / 6 ELSE 0 END"


@register(f"""WITH {HOURLY}, t AS (SELECT DISTINCT ts, hour(ts) / 4.0::DOUBLE AS u FROM hourly),
g AS (SELECT ts, {", ".join(f"least(((u - {i}) % 6 + 6) % 6, 6 - ((u - {i}) % 6 + 6) % 6) AS g{i}" for i in range(6))} FROM t)
SELECT ts, {", ".join(rsql(_HAT(f"g{i}"), 6) + f" AS hour_spline_{i}" for i in range(6))} FROM g""")
def calendar_spline(spark, d):
    out = calendar.add_calendar(hourly(spark, d).select("ts").distinct(), ["hour"], "spline")
    return out.select("ts", *[rounded(f"hour_spline_{i}", 6).alias(f"hour_spline_{i}") for i in range(6)])


@register(f"WITH {HOURLY} SELECT DISTINCT ts, ts + INTERVAL 5 HOUR AS five_on, ts - INTERVAL 2 HOUR AS two_back FROM hourly")
def position_to_date(spark, d):
    step = Freq.parse("h")
    return hourly(spark, d).select("ts").distinct().select("ts", step.shift(F.col("ts"), 5).alias("five_on"), step.shift(F.col("ts"), -2).alias("two_back"))


@register(f"""WITH {HOURLY}, f AS (
SELECT series_id, avg(y) AS m, stddev_pop(y) AS s FROM hourly_grid WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT g.series_id, g.ts, {rsql("(g.y - f.m) / CASE WHEN f.s > 0 THEN f.s ELSE 1 END", 6)} AS scaled FROM hourly_grid g JOIN f USING (series_id)""")
def standardize(spark, d):
    out = scaling.standardize(hourly_grid(spark, d), "y", ["series_id"], F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return out.select("series_id", "ts", rounded("scaled", 6).alias("scaled"))


# Splits and autocorrelation


@register(f"WITH {HOURLY} SELECT series_id, ts, pos <= max(pos) OVER (PARTITION BY series_id) - 48 AS is_train FROM hourly_grid")
def train_test_split(spark, d):
    return evaluation.split_by_share(hourly_grid(spark, d), 48).select("series_id", "ts", "is_train")


@register(f"""WITH {REVENUE}, s AS (SELECT count(*) AS n, floor(0.7 * count(*)::DOUBLE)::BIGINT AS init FROM revenue_grid),
f AS (SELECT unnest(range(0, (n - init + 6) // 7))::BIGINT AS fold, n, init FROM s)
SELECT fold, 0::BIGINT AS train_from, init + 7 * fold AS train_to, init + 7 * fold AS test_from, least(init + 7 * fold + 7, n) AS test_to FROM f""")
def cv_folds(spark, d):
    n = profile.span_length(revenue(spark, d), "D").first()[0]
    return evaluation.cv_folds(spark, n=n, initial=int(0.7 * n), steps=7).select("fold", "train_from", "train_to", "test_from", "test_to")


def _span(grid):
    """Positions of the longest series."""
    return grid.agg(F.max("pos") + 1).first()[0]


@register(f"""WITH {HOURLY}, s AS (SELECT max(pos) + 1 AS n, floor(0.7 * (max(pos) + 1)::DOUBLE)::BIGINT AS init FROM hourly_grid),
f AS (SELECT unnest(range(0, (n - init - 2 + 23) // 24))::BIGINT AS fold, n, init FROM s),
folds AS (SELECT fold, init + 2 + 24 * fold AS a, least(init + 2 + 24 * fold + 12, n) AS b FROM f)
SELECT fold, series_id, count(*)::BIGINT AS n, sum(y) AS total FROM hourly_grid g JOIN folds f ON g.pos >= f.a AND g.pos < f.b GROUP BY ALL""")
def fold_rows(spark, d):
    grid = hourly_grid(spark, d)
    n = _span(grid)
    folds = evaluation.cv_folds(spark, n=n, initial=int(0.7 * n), steps=12, stride=24, gap=2)
    rows = evaluation.fold_rows(grid, folds)
    return rows.groupBy("fold", "series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))


@register(f"""WITH {HOURLY}, s AS (SELECT max(pos) + 1 AS n, floor(0.7 * (max(pos) + 1)::DOUBLE)::BIGINT AS init FROM hourly_grid),
f AS (SELECT unnest(range(0, (n - init + 47) // 48))::BIGINT AS fold, init FROM s),
folds AS (SELECT fold, 48 * fold AS a, init + 48 * fold AS b FROM f)
SELECT fold, series_id, count(*)::BIGINT AS n, sum(y) AS total FROM hourly_grid g JOIN folds f ON g.pos >= f.a AND g.pos < f.b GROUP BY ALL""")
def fold_train_rows(spark, d):
    grid = hourly_grid(spark, d)
    n = _span(grid)
    folds = evaluation.cv_folds(spark, n=n, initial=int(0.7 * n), steps=48, fixed_train=True)
    rows = evaluation.fold_rows(grid, folds, "train")
    return rows.groupBy("fold", "series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"))


@register(f"""WITH {REVENUE}, e AS (SELECT pos, coalesce(y, 0) - avg(coalesce(y, 0)) OVER () AS e FROM revenue_grid),
l AS (SELECT k, e.e, e2.e AS ek FROM e, range(1, 11) t(k) JOIN e e2 ON e2.pos = e.pos - k)
SELECT k::BIGINT AS lag, {rsql("sum(e * ek) / (SELECT sum(e * e) FROM e)", 6)} AS acf FROM l GROUP BY k""")
def acf(spark, d):
    grid = revenue_grid(spark, d).withColumn("y", F.coalesce("y", F.lit(0.0)))
    return autocorrelation.acf(grid, 10).select("lag", rounded("acf", 6).alias("acf"))


def _given_p(spark, d):
    """P-values to screen, made from hourly counts so that SQL can state them."""
    p = (F.coalesce("y", F.lit(0.0)) * F.col("pos") % 97) / 1000
    return hourly_grid(spark, d).select("series_id", (F.col("pos") + 1).alias("lag"), p.alias("p"))


@register(f"""WITH {HOURLY}, t AS (
SELECT series_id, pos + 1 AS lag, ((coalesce(y, 0) * pos) % 97) / 1000 AS p FROM hourly_grid),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p, lag) AS rk, count(*) OVER (PARTITION BY series_id) AS m FROM t),
c AS (SELECT *, max(CASE WHEN p <= rk * 0.05 / m THEN p END) OVER (PARTITION BY series_id) AS cut FROM r)
SELECT series_id, lag::BIGINT AS lag, {rsql("p", 6)} AS p FROM c WHERE p <= cut""")
def bh_screen(spark, d):
    return autocorrelation.bh_screen(_given_p(spark, d)).select("series_id", "lag", rounded("p", 6).alias("p"))


def _pacf_sql() -> str:
    r = "(SELECT sum(e * ek) FROM l WHERE l.series_id = v.series_id AND k = {k}) / v.v"
    return f"""WITH {HOURLY}, e AS (SELECT series_id, pos, coalesce(y, 0) - avg(coalesce(y, 0)) OVER (PARTITION BY series_id) AS e FROM hourly_grid),
l AS (SELECT e.series_id, k, e.e, e2.e AS ek FROM e, range(1, 3) t(k) JOIN e e2 ON e2.series_id = e.series_id AND e2.pos = e.pos - k),
v AS (SELECT series_id, sum(e * e) AS v FROM e GROUP BY 1),
r AS (SELECT series_id, {r.format(k=1)} AS r1, {r.format(k=2)} AS r2 FROM v)
SELECT series_id, 1::BIGINT AS lag, {rsql("r1", 6)} AS pacf FROM r
UNION ALL SELECT series_id, 2::BIGINT, {rsql("(r2 - r1 * r1) / (1 - r1 * r1)", 6)} FROM r"""


@register(_pacf_sql())
def pacf(spark, d):
    grid = hourly_grid(spark, d).withColumn("y", F.coalesce("y", F.lit(0.0)))
    return autocorrelation.pacf(grid, 2).select("series_id", "lag", rounded("pacf", 6).alias("pacf"))


_FOUND = f"""{HOURLY}, e AS (SELECT series_id, pos, coalesce(y, 0) - avg(coalesce(y, 0)) OVER (PARTITION BY series_id) AS e FROM hourly_grid),
v AS (SELECT series_id, sum(e * e) AS v FROM e GROUP BY 1),
a AS (SELECT e.series_id, k AS lag, sum(e.e * e2.e) / any_value(v) AS r
  FROM e JOIN v USING (series_id), range(1, 25) t(k) JOIN e e2 ON e2.series_id = e.series_id AND e2.pos = e.pos - k GROUP BY ALL),
found AS (SELECT * FROM a WHERE abs(r) > 0.03)"""


def _found(spark, d):
    """Lags whose autocorrelation is above a floor, as SQL can state it."""
    grid = hourly_grid(spark, d).withColumn("y", F.coalesce("y", F.lit(0.0)))
    return autocorrelation.acf(grid, 24).where(F.abs("acf") > 0.03).withColumnRenamed("acf", "pacf")


@register(f"""WITH {_FOUND}, c AS (SELECT lag::BIGINT AS lag, count(*)::BIGINT AS series, sum(abs(r)) AS strength FROM found GROUP BY 1)
SELECT lag, series, {rsql("strength", 6)} AS strength FROM c WHERE series >= 3 OR (SELECT max(series) FROM c) < 3""")
def lag_consensus(spark, d):
    out = autocorrelation.lag_consensus(_found(spark, d), len(TYPES))
    return out.select("lag", "series", rounded("strength", 6).alias("strength"))


@register(f"""WITH {_FOUND}, t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(r) DESC, lag) AS k FROM found)
SELECT lag::BIGINT AS lag, {rsql("sum(abs(r))", 6)} AS strength FROM t WHERE k <= 5 GROUP BY 1""")
def top_lag_union(spark, d):
    return autocorrelation.top_lags(_found(spark, d), 5).select("lag", rounded("strength", 6).alias("strength"))


def _two_sided_sql(x: str) -> str:
    """Twice the normal tail: one minus erf by its series, which converges for the z of the query."""
    return f"1 - 2 / sqrt(pi()) * (SELECT sum((-1) ** k * ({x}) ** (2 * k + 1) / ((2 * k + 1) * gamma(k + 1))) FROM range(0, 60) t(k))"


@register(f"""WITH {HOURLY}, s AS (SELECT series_id, avg(y) AS m, stddev_samp(y) AS d FROM hourly GROUP BY 1),
z AS (SELECT DISTINCT series_id, y, abs(y - m) / d AS z FROM hourly JOIN s USING (series_id))
SELECT series_id, y, {rsql("z", 4)} AS z, {rsql(_two_sided_sql("least(z, 5) / sqrt(2)"), 3)} AS p FROM z""")
def two_sided_p(spark, d):
    """How unusual each hourly count of a series is under a normal distribution."""
    counts = hourly(spark, d)
    moments = counts.groupBy("series_id").agg(F.avg("y").alias("_m"), F.stddev_samp("y").alias("_d"))
    rows = counts.select("series_id", "y").distinct().join(moments, "series_id").withColumn("z", F.abs(F.col("y") - F.col("_m")) / F.col("_d"))
    return rows.select("series_id", "y", rounded("z", 4).alias("z"), rounded(autocorrelation.two_sided(F.least("z", F.lit(5.0))), 3).alias("p"))


# Metrics


def _naive(spark, d, season: int = 24):
    """Predictions of the seasonal naive forecast on the last 96 hours."""
    w = Window.partitionBy("series_id").orderBy("pos")
    grid = hourly_grid(spark, d).withColumn("y", F.coalesce("y", F.lit(0.0))).withColumn("pred", F.lag("y", season).over(w))
    last = F.max("pos").over(Window.partitionBy("series_id"))
    return grid.withColumn("_last", last)


def _test(spark, d, season: int = 24):
    return _naive(spark, d, season).where("pos > _last - 96").drop("_last")


def _train(spark, d):
    return _naive(spark, d).where("pos <= _last - 96").drop("_last")


NAIVE = f"""{HOURLY}, n AS (
SELECT series_id, ts, pos, coalesce(y, 0) AS y, lag(coalesce(y, 0), 24) OVER w AS pred, lag(coalesce(y, 0), 1) OVER w AS y1, max(pos) OVER (PARTITION BY series_id) AS last
FROM hourly_grid WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
test AS (SELECT * FROM n WHERE pos > last - 96), train AS (SELECT * FROM n WHERE pos <= last - 96),
scale AS (SELECT series_id, avg(abs(y - y1)) AS a, avg((y - y1) * (y - y1)) AS b FROM train GROUP BY 1)"""


def _metrics(spark, d, names):
    out = evaluation.evaluate(_test(spark, d), names, evaluation.naive_scale(_train(spark, d)) if {"mase", "rmsse"} & set(names) else None)
    return out.select("series_id", *[rounded(n, 6).alias(n) for n in names])


@register(f"""WITH {NAIVE} SELECT series_id, {rsql("avg(abs(y - pred))", 6)} AS mae, {rsql("avg((y - pred) * (y - pred))", 6)} AS mse,
{rsql("avg(CASE WHEN y <> 0 THEN abs(y - pred) / abs(y) END)", 6)} AS mape FROM test GROUP BY 1""")
def metric_mae_mse_mape(spark, d):
    return _metrics(spark, d, ["mae", "mse", "mape"])


@register(f"WITH {NAIVE} SELECT series_id, {rsql('avg(abs(y - pred)) / any_value(a)', 6)} AS mase FROM test JOIN scale USING (series_id) GROUP BY 1")
def metric_mase(spark, d):
    return _metrics(spark, d, ["mase"])


@register(f"WITH {NAIVE} SELECT series_id, {rsql('sqrt(avg((y - pred) * (y - pred)) / any_value(b))', 6)} AS rmsse FROM test JOIN scale USING (series_id) GROUP BY 1")
def metric_rmsse(spark, d):
    return _metrics(spark, d, ["rmsse"])


@register(f"""WITH {NAIVE} SELECT series_id,
{rsql("100 * avg(CASE WHEN abs(y) + abs(pred) = 0 THEN 0 ELSE 2 * abs(y - pred) / (abs(y) + abs(pred)) END)", 6)} AS smape,
{rsql("median(abs(y - pred))", 6)} AS medae, {rsql("avg((ln(1 + y) - ln(1 + pred)) * (ln(1 + y) - ln(1 + pred)))", 6)} AS msle FROM test GROUP BY 1""")
def metric_extra(spark, d):
    return _metrics(spark, d, ["smape", "medae", "msle"])


@register(f"""WITH {NAIVE} SELECT series_id AS level, {rsql("avg(abs(y - pred))", 6)} AS mae, {rsql("avg((y - pred) * (y - pred))", 6)} AS mse, count(*)::BIGINT AS n
FROM test GROUP BY GROUPING SETS ((series_id), ())""")
def metrics_by_level(spark, d):
    out = evaluation.metrics_by_level(_test(spark, d), ["mae", "mse"])
    return out.select("level", rounded("mae", 6).alias("mae"), rounded("mse", 6).alias("mse"), "n")


@register(f"""WITH {NAIVE}, p AS (SELECT series_id, avg(abs(y - pred)) AS mae, count(*) AS n FROM test GROUP BY 1)
SELECT 'average' AS level, {rsql("avg(mae)", 6)} AS mae, sum(n)::BIGINT AS n FROM p
UNION ALL SELECT 'weighted_average', {rsql("sum(mae * n) / sum(n)", 6)}, sum(n)::BIGINT FROM p""")
def metric_levels_average(spark, d):
    out = evaluation.aggregate_levels(evaluation.metrics_by_level(_test(spark, d), ["mae"]), ["mae"])
    return out.select("level", rounded("mae", 6).alias("mae"), F.col("n").cast("long").alias("n"))


@register(f"""WITH {NAIVE} SELECT series_id, {rsql("avg((y BETWEEN pred - 2 AND pred + 2)::INT)", 6)} AS coverage FROM test GROUP BY 1""")
def metric_coverage(spark, d):
    preds = _test(spark, d).withColumns({"lower_bound": F.col("pred") - 2, "upper_bound": F.col("pred") + 2})
    out = evaluation.coverage(preds)
    return out.select("series_id", rounded("coverage", 6).alias("coverage"))


@register(f"""WITH {NAIVE} SELECT series_id, {rsql("avg(greatest((y - pred) * 0.9, (y - pred) * -0.1))", 6)} AS pinball FROM test GROUP BY 1""")
def metric_pinball(spark, d):
    out = _test(spark, d).groupBy("series_id").agg(evaluation.pinball(F.col("y"), F.col("pred"), 0.9).alias("pinball"))
    return out.select("series_id", rounded("pinball", 6).alias("pinball"))


@register(f"""WITH {NAIVE}, q AS (SELECT series_id, greatest((y - pred + 2) * 0.1, (y - pred + 2) * -0.9) + greatest((y - pred) * 0.5, (y - pred) * -0.5) + greatest((y - pred - 2) * 0.9, (y - pred - 2) * -0.1) AS l FROM test)
SELECT series_id, {rsql("avg(l) * 2 / 3", 6)} AS crps FROM q GROUP BY 1""")
def metric_crps(spark, d):
    preds = _test(spark, d).withColumns({f"q_{q}": F.col("pred") + shift for q, shift in ((0.1, -2.0), (0.5, 0.0), (0.9, 2.0))})
    return evaluation.crps_from_quantiles(preds, [0.1, 0.5, 0.9]).select("series_id", rounded("crps", 6).alias("crps"))


@register(f"""WITH {NAIVE} SELECT series_id, {rsql("avg(CASE WHEN y > pred THEN 2 * (y - pred) ELSE pred - y END)", 6)} AS underestimate FROM test GROUP BY 1""")
def custom_metric(spark, d):
    """A metric of the caller's own: what is under counts twice."""
    evaluation.register_metric("underestimate", lambda y, pred: F.avg(F.when(y > pred, 2 * (y - pred)).otherwise(pred - y)))
    return _metrics(spark, d, ["underestimate"])


_CELL = f"""{NAIVE}, c AS (SELECT series_id, least(y, 2)::BIGINT::VARCHAR AS y, least(pred, 2)::BIGINT::VARCHAR AS p FROM test),
l AS (SELECT series_id, label, count_if(y = label AND p = label)::DOUBLE AS hits, count_if(y = label)::DOUBLE AS real, count_if(p = label)::DOUBLE AS said
  FROM c JOIN (SELECT series_id, y AS label FROM c UNION SELECT series_id, p FROM c) k USING (series_id) GROUP BY ALL),
r AS (SELECT *, CASE WHEN said > 0 THEN hits / said ELSE 0 END AS p, CASE WHEN real > 0 THEN hits / real ELSE 0 END AS r FROM l)"""


@register(f"""WITH {_CELL} SELECT series_id, {rsql("sum(hits) / sum(real)", 6)} AS accuracy, {rsql("avg(r) FILTER (real > 0)", 6)} AS balanced_accuracy,
{rsql("avg(p)", 6)} AS precision, {rsql("avg(r)", 6)} AS recall, {rsql("avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END)", 6)} AS f1 FROM r GROUP BY 1""")
def metric_classes(spark, d):
    """Counts of 0, 1 and more as classes."""
    kind = lambda c: F.least(F.col(c), F.lit(2)).cast("long").cast("string")
    out = evaluation.classification_metrics(_test(spark, d).withColumns({"y": kind("y"), "pred": kind("pred")}))
    return out.select("series_id", *[rounded(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")])


@register(f"""WITH {NAIVE}, w AS (SELECT series_id, quantile_cont(abs(y - pred), 0.8) AS w FROM train WHERE pred IS NOT NULL GROUP BY 1)
SELECT series_id, ts, pred, {rsql("pred - w", 6)} AS lower_bound, {rsql("pred + w", 6)} AS upper_bound FROM test JOIN w USING (series_id)""")
def conformal_interval(spark, d):
    out = evaluation.conformal_interval(_test(spark, d), _train(spark, d).where("pred is not null"))
    return out.select("series_id", "ts", "pred", rounded("lower_bound", 6).alias("lower_bound"), rounded("upper_bound", 6).alias("upper_bound"))


@register(f"""WITH {NAIVE}, v AS (
SELECT 'naive_24' AS candidate, avg(abs(y - pred)) AS value FROM test UNION ALL SELECT 'naive_1', avg(abs(y - y1)) FROM test UNION ALL SELECT 'failed', NULL)
SELECT candidate, {rsql("value", 6)} AS value, row_number() OVER (ORDER BY value NULLS LAST, candidate)::BIGINT AS rank FROM v""")
def leaderboard(spark, d):
    score = lambda season: _test(spark, d, season).agg(F.lit(f"naive_{season}").alias("candidate"), evaluation.metric("mae", F.col("y"), F.col("pred")).alias("value"))
    failed = spark.range(1).select(F.lit("failed").alias("candidate"), F.lit(float("nan")).alias("value"))
    out = evaluation.leaderboard(score(24).unionByName(score(1)).unionByName(failed))
    return out.select("candidate", F.when(~F.isnan("value"), rounded("value", 6)).alias("value"), "rank")


@register(f"""WITH {HOURLY}, t AS (SELECT series_id, coalesce(y, 0) AS y, max(pos) OVER (PARTITION BY series_id) - pos AS back FROM hourly_grid)
SELECT series_id, (s.step)::BIGINT AS step, {rsql("avg(y)", 6)} AS pred FROM t, (SELECT unnest(range(1, 37)) AS step) s
WHERE back < 48 AND back % 24 = (23 - (s.step - 1) % 24) GROUP BY ALL""")
def seasonal_naive_forecast(spark, d):
    grid = hourly_grid(spark, d).withColumn("y", F.coalesce("y", F.lit(0.0)))
    return evaluation.seasonal_naive(grid, 36, 24, 2).select("series_id", F.col("step").cast("long").alias("step"), rounded("pred", 6).alias("pred"))


# Drift


def _halves(spark, d):
    events = table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("value").alias("y"), "ts")
    return events.withColumn("is_new", F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"))


HALVES = "halves AS (SELECT event_type AS series_id, value AS y, ts >= TIMESTAMP '2024-01-16' AS is_new FROM events)"


@register(f"""WITH {HALVES}, b AS (SELECT series_id, min(y) AS lo, max(y) AS hi FROM halves WHERE NOT is_new GROUP BY 1)
SELECT series_id, count(y)::BIGINT AS n, count_if(y < lo OR y > hi)::BIGINT AS outside, {rsql("count_if(y < lo OR y > hi) / count(y)::DOUBLE", 6)} AS share,
count_if(y < lo OR y > hi) / count(y)::DOUBLE > 0.1 AS drifted FROM halves JOIN b USING (series_id) WHERE is_new GROUP BY 1""")
def range_drift(spark, d):
    both = _halves(spark, d)
    out = drift.range_drift(both.where("not is_new"), both.where("is_new"))
    return out.select("series_id", "n", "outside", rounded("share", 6).alias("share"), "drifted")


@register(f"""WITH {HALVES}, c AS (SELECT series_id, y, count_if(is_new) AS a, count_if(NOT is_new) AS b FROM halves WHERE y IS NOT NULL GROUP BY ALL),
g AS (SELECT series_id, abs(sum(a) OVER w / sum(a) OVER p - sum(b) OVER w / sum(b) OVER p) AS gap FROM c
WINDOW w AS (PARTITION BY series_id ORDER BY y), p AS (PARTITION BY series_id))
SELECT series_id, {rsql("max(gap)", 6)} AS ks FROM g GROUP BY 1""")
def drift_ks(spark, d):
    return drift.ks_statistic(_halves(spark, d), "y", "is_new").select("series_id", rounded("ks", 6).alias("ks"))


_SHARES = f"""{HALVES}, c AS (SELECT series_id, floor(y / 50)::BIGINT AS bin, count_if(is_new) AS a, count_if(NOT is_new) AS b FROM halves GROUP BY ALL),
s AS (SELECT *, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q, sum(a) OVER w AS ta, sum(b) OVER w AS tb FROM c WINDOW w AS (PARTITION BY series_id))"""


@register(f"""WITH {_SHARES}, j AS (SELECT series_id, CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END AS x FROM s)
SELECT series_id, {rsql("sqrt(greatest(sum(x) / 2, 0))", 6)} AS js FROM j GROUP BY 1""")
def drift_js(spark, d):
    rows = _halves(spark, d).withColumn("bin", F.floor(F.col("y") / 50))
    return drift.js_divergence(rows, "bin", "is_new").select("series_id", rounded("js", 6).alias("js"))


@register(f"""WITH {_SHARES} SELECT series_id,
{rsql("sum((a - (a + b) * ta / (ta + tb)) ** 2 / ((a + b) * ta / (ta + tb)) + (b - (a + b) * tb / (ta + tb)) ** 2 / ((a + b) * tb / (ta + tb)))", 4)} AS chi2,
(count(*) - 1)::BIGINT AS df FROM s GROUP BY 1""")
def drift_chi2(spark, d):
    rows = _halves(spark, d).withColumn("bin", F.floor(F.col("y") / 50))
    return drift.chi_square(rows, "bin", "is_new").select("series_id", rounded("chi2", 4).alias("chi2"), F.col("df").cast("long").alias("df"))


# Event windows


def _events(spark, d):
    return table(spark, d, "events").select("event_type", "ts", F.col("value").cast("decimal(18,4)").alias("value"))


@register("""SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR AS "end", count(*)::BIGINT AS n,
sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY ALL""")
def tumbling_agg(spark, d):
    out = windows.tumbling(_events(spark, d), ["event_type"], "value", "6 hours")
    return out.select("event_type", stamp("start").alias("start"), stamp("end").alias("end"), "n", F.col("total").cast("double").alias("total"))


@register("""WITH s AS (SELECT event_type, value, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(unnest([0, 1])) AS start FROM events)
SELECT event_type, start, start + INTERVAL 2 HOUR AS "end", count(*)::BIGINT AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM s GROUP BY ALL""")
def sliding_agg(spark, d):
    out = windows.sliding(_events(spark, d), ["event_type"], "value", "2 hours", "1 hour")
    return out.select("event_type", stamp("start").alias("start"), stamp("end").alias("end"), "n", F.col("total").cast("double").alias("total"))


@register("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS first FROM events),
s AS (SELECT *, sum(first) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM m)
SELECT event_type, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*)::BIGINT AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total
FROM s GROUP BY event_type, session""")
def session_agg(spark, d):
    out = windows.sessions(_events(spark, d), ["event_type"], "value", "30 minutes")
    return out.select("event_type", stamp("start").alias("start"), stamp("end").alias("end"), "n", F.col("total").cast("double").alias("total"))


# The flagship: alignment, lags, rolling statistics and calendar in one matrix


@register(f"""WITH {REVENUE} SELECT ts, y, lag(y, 1) OVER o AS lag_1, lag(y, 7) OVER o AS lag_7,
{_full("avg(y) OVER w", 3)} AS roll_mean_7, {_full("stddev_samp(y) OVER w", 3)} AS roll_std_7, month(ts)::BIGINT AS month FROM revenue_grid
WINDOW o AS (ORDER BY pos), w AS (ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def rolling_features(spark, d):
    out = features.add_features(revenue_grid(spark, d), [1, 7], [("mean", 7), ("std", 7)])
    out = calendar.add_calendar(out, ["month"])
    return out.select("ts", "y", "lag_1", "lag_7", rounded("roll_mean_7", 3).alias("roll_mean_7"), rounded("roll_std_7", 3).alias("roll_std_7"), "month")


# Models and backtests, by closed forms in SQL where there are any


def _filled(spark, d):
    return hourly_grid(spark, d).withColumn("y", F.coalesce("y", F.lit(0.0)))


@register(f"""WITH {HOURLY}, x AS (SELECT series_id, pos, coalesce(y, 0) AS y FROM hourly_grid),
m AS (SELECT series_id, y, lag(y, 1) OVER (PARTITION BY series_id ORDER BY pos) AS x FROM x),
s AS (SELECT series_id, avg(x) AS mx, avg(y) AS my, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx FROM m WHERE x IS NOT NULL GROUP BY 1)
SELECT series_id, {rsql("sxy / (sxx + 1)", 6)} AS slope, {rsql("my - mx * sxy / (sxx + 1)", 6)} AS intercept FROM s""")
def ridge_one_lag(spark, d):
    matrix = features.train_matrix(_filled(spark, d), [1])
    out = models.fit_ridge(matrix, ["lag_1"], ["series_id"])
    return out.select("series_id", rounded(F.col("beta")[0], 6).alias("slope"), rounded(F.col("beta")[1], 6).alias("intercept"))




@register(f"""WITH RECURSIVE {HOURLY}, x AS (SELECT series_id, pos, coalesce(y, 0) AS y FROM hourly_grid),
m AS (SELECT series_id, y, lag(y, 1) OVER (PARTITION BY series_id ORDER BY pos) AS x FROM x),
s AS (SELECT series_id, avg(x) AS mx, avg(y) AS my, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx FROM m WHERE x IS NOT NULL GROUP BY 1),
c AS (SELECT series_id, sxy / (sxx + 1) AS a, my - mx * sxy / (sxx + 1) AS b FROM s),
f AS (SELECT c.series_id, 1::BIGINT AS step, a, b, a * arg_max(x.y, x.pos) + b AS p FROM c JOIN x ON c.series_id = x.series_id GROUP BY c.series_id, a, b
  UNION ALL SELECT series_id, step + 1, a, b, a * p + b FROM f WHERE step < 12)
SELECT series_id, step, {rsql("p", 5)} AS pred FROM f""")
def recursive_ridge_forecast(spark, d):
    grid = _filled(spark, d)
    betas = models.fit_ridge(features.train_matrix(grid, [1]), ["lag_1"], ["series_id"])
    out = models.recursive_forecast(models.tails_at_end(grid, 1), betas, [1], [], 12, "h")
    return out.select("series_id", F.col("step").cast("long").alias("step"), rounded("pred", 5).alias("pred"))


def _two(y: str, x: str, z: str, rows: str, by: str = "") -> str:
    """Coefficients b1, b2 and intercept b0 of a ridge on two features, alpha 1, by the columns of ``by``."""
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""(SELECT {keys}b1, b2, my - b1 * mx - b2 * mz AS b0 FROM (SELECT *, (sxy * (szz + 1) - szy * sxz) / ((sxx + 1) * (szz + 1) - sxz * sxz) AS b1,
(szy * (sxx + 1) - sxy * sxz) / ((sxx + 1) * (szz + 1) - sxz * sxz) AS b2 FROM (
SELECT {keys}avg({y}) AS my, avg({x}) AS mx, avg({z}) AS mz, regr_sxx({x}, {x}) AS sxx, regr_sxx({z}, {z}) AS szz,
covar_pop({x}, {z}) * count(*) AS sxz, covar_pop({x}, {y}) * count(*) AS sxy, covar_pop({z}, {y}) * count(*) AS szy FROM {rows} {group})))"""


_PANEL = f"{HOURLY}, x AS (SELECT series_id, ts, date_diff('hour', min(ts) OVER (), ts) AS pos, coalesce(y, 0) AS y FROM hourly_grid)"
_X = f"{HOURLY}, x AS (SELECT series_id, ts, pos, coalesce(y, 0) AS y FROM hourly_grid)"


@register(f"""WITH RECURSIVE {_X}, m AS (SELECT *, lag(y, 1) OVER w AS a, lag(y, 24) OVER w AS b FROM x WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
full_rows AS (SELECT * FROM m WHERE a IS NOT NULL AND b IS NOT NULL), c AS {_two("y", "a", "b", "full_rows")},
e AS (SELECT series_id, arg_max(y, pos) AS last, max(pos) AS p, max(ts) AS t FROM x GROUP BY 1),
f AS (SELECT series_id, p, t, 0::BIGINT AS step, last AS pred FROM e
  UNION ALL SELECT f.series_id, p, t, step + 1, b1 * pred + b2 * x.y + b0 FROM f JOIN x ON x.series_id = f.series_id AND x.pos = p + step + 1 - 24, c WHERE step < 12)
SELECT series_id, step::INT AS step, t + to_hours(step) AS ts, {rsql("pred", 4)} AS pred FROM f WHERE step > 0""")
def global_ridge_forecast(spark, d):
    """One model of all series; recursive in the first lag, the last day's values in the second."""
    grid = _filled(spark, d)
    matrix, names, target = models.design_matrix(grid, models.Design([1, 24]))
    betas = models.fit_ridge(matrix, names, target=target)
    out = models.recursive_forecast(models.tails_at_end(grid, 24), betas, [1, 24], [], 12, "h")
    return out.select("series_id", "step", "ts", rounded("pred", 4).alias("pred"))


@register(f"""WITH RECURSIVE {_X}, m AS (SELECT *, lag(y, 1) OVER (PARTITION BY series_id ORDER BY pos) AS a, hour(ts)::DOUBLE AS b FROM x),
full_rows AS (SELECT * FROM m WHERE a IS NOT NULL), c AS {_two("y", "a", "b", "full_rows")},
e AS (SELECT series_id, arg_max(y, pos) AS last, max(ts) AS t FROM x GROUP BY 1),
f AS (SELECT series_id, t, 0::BIGINT AS step, last AS pred FROM e
  UNION ALL SELECT series_id, t, step + 1, b1 * pred + b2 * hour(t + to_hours(step + 1)) + b0 FROM f, c WHERE step < 12)
SELECT series_id, step::INT AS step, t + to_hours(step) AS ts, {rsql("pred", 4)} AS pred FROM f WHERE step > 0""")
def exog_forecast(spark, d):
    """An exogenous column of the data, and its rows ahead by timestamp, through the whole interface."""
    a = Assistant(hourly(spark, d).withColumn("load", F.hour("ts").cast("double")), "ts", "y", "series_id", freq="h")
    a._grid = _filled(spark, d).withColumn("load", F.hour("ts").cast("double"))
    plan = a.plan(12, strategy="multi_series", estimator="ridge", lags=[1], windows=[], calendar=[], scale=False, encode_series=False)
    last = F.lit(a.profile().end).cast("timestamp_ntz")
    ahead = spark.range(-24 * 31, 13).select(F.timestamp_add("HOUR", F.col("id"), last).alias("ts")).withColumn("load", F.hour("ts").cast("double"))
    out = a.forecast(plan, exog=ahead).predictions
    return out.select("series_id", "step", "ts", rounded("pred", 4).alias("pred"))


@register(f"""WITH RECURSIVE {_X}, z AS (SELECT *, y - lag(y) OVER w AS z FROM x WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
m AS (SELECT *, lag(z) OVER (PARTITION BY series_id ORDER BY pos) AS a FROM z),
s AS (SELECT series_id, covar_pop(a, z) * count(*) / (regr_sxx(a, a) + 1) AS b, avg(z) AS mz, avg(a) AS ma FROM m WHERE a IS NOT NULL GROUP BY 1),
e AS (SELECT series_id, arg_max(y, pos) AS last, arg_max(z, pos) AS lz FROM z GROUP BY 1),
f AS (SELECT series_id, b, mz - b * ma AS c, 0::BIGINT AS step, last AS pred, lz FROM s JOIN e USING (series_id)
  UNION ALL SELECT series_id, b, c, step + 1, pred + b * lz + c, b * lz + c FROM f WHERE step < 6)
SELECT series_id, step::INT AS step, {rsql("pred", 4)} AS pred FROM f WHERE step > 0""")
def differenced_forecast(spark, d):
    """Recursive forecasts of the first difference, added up again."""
    grid = _filled(spark, d)
    matrix, names, target = models.design_matrix(grid, models.Design([1], differentiation=1))
    betas = models.fit_ridge(matrix, names, ["series_id"], target=target)
    out = models.recursive_forecast(models.tails_at_end(grid, 2), betas, [1], [], 6, "h", differentiation=1)
    return out.select("series_id", "step", rounded("pred", 4).alias("pred"))


@register(f"""WITH {HOURLY}, x AS (SELECT series_id, pos, coalesce(y, 0) AS y FROM hourly_grid),
m AS (SELECT series_id, pos, lag(y, 1) OVER w AS x, unnest([1, 2, 3])::BIGINT AS step, unnest([y, lead(y, 1) OVER w, lead(y, 2) OVER w]) AS y FROM x WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
s AS (SELECT series_id, step, avg(x) AS mx, avg(y) AS my, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx
  FROM m WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
t AS (SELECT series_id, arg_max(y, pos) AS last FROM x GROUP BY 1)
SELECT series_id, step, {rsql("last * sxy / (sxx + 1) + my - mx * sxy / (sxx + 1)", 5)} AS pred FROM s JOIN t USING (series_id)""")
def direct_ridge_forecast(spark, d):
    out = models.direct_forecast(_filled(spark, d), [1], 3)
    return out.select("series_id", F.col("step").cast("long").alias("step"), rounded("pred", 5).alias("pred"))


_TWO_SERIES = ["purchase", "view"]


@register(f"""WITH {DAILY}, wide AS (SELECT ts, {_PIVOT} FROM daily GROUP BY ts),
m AS (SELECT ts, lag(purchase) OVER o AS a, lag(view) OVER o AS b, unnest(['purchase', 'purchase', 'view', 'view']) AS series_id, unnest([1, 2, 1, 2]) AS step,
  unnest([purchase, lead(purchase) OVER o, view, lead(view) OVER o]) AS y FROM wide WINDOW o AS (ORDER BY ts)),
full_rows AS (SELECT * FROM m WHERE a IS NOT NULL AND b IS NOT NULL AND y IS NOT NULL), c AS {_two("y", "a", "b", "full_rows", "series_id, step")},
e AS (SELECT arg_max(purchase, ts) AS a, arg_max(view, ts) AS b FROM wide)
SELECT series_id, step::BIGINT AS step, {rsql("b1 * a + b2 * b + b0", 4)} AS pred FROM c, e""")
def multivariate_forecast(spark, d):
    out = models.multivariate_forecast(daily_events(spark, d), _TWO_SERIES, _TWO_SERIES, [1], 2)
    return out.select("series_id", F.col("step").cast("long").alias("step"), rounded("pred", 4).alias("pred"))


@register(f"""WITH RECURSIVE {_X}, m AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY pos) AS a FROM x),
s AS (SELECT max(pos) + 1 AS n, floor(0.7 * (max(pos) + 1)::DOUBLE)::BIGINT AS init FROM x),
folds AS (SELECT unnest(range(0, (n - init + 23) // 24))::BIGINT AS fold, n, init FROM s),
b AS (SELECT fold, init + 24 * fold AS train_to, init + 24 * (fold - fold % 3) AS model_to, least(init + 24 * fold + 12, n) AS test_to FROM folds),
c AS (SELECT series_id, fold, train_to, test_to, covar_pop(a, y) * count(*) / (regr_sxx(a, a) + 1) AS k, avg(y) AS my, avg(a) AS ma
  FROM m JOIN b ON m.pos < b.model_to WHERE a IS NOT NULL GROUP BY ALL),
f AS (SELECT c.series_id, fold, train_to, test_to, k, my - k * ma AS b0, 0::BIGINT AS step, x.y AS pred FROM c JOIN x ON x.series_id = c.series_id AND x.pos = train_to - 1
  UNION ALL SELECT series_id, fold, train_to, test_to, k, b0, step + 1, k * pred + b0 FROM f WHERE step < 12)
SELECT f.series_id, fold, step::INT AS step, x.ts, x.y, {rsql("pred", 4)} AS pred FROM f JOIN x ON x.series_id = f.series_id AND x.pos = train_to + step - 1 WHERE step > 0 AND x.pos < test_to""")
def backtest_ridge(spark, d):
    """Walk-forward folds that refit every third time."""
    grid = _filled(spark, d)
    n = _span(grid)
    folds = evaluation.cv_folds(spark, n=n, initial=int(0.7 * n), steps=12, stride=24, refit=3)
    out = models.backtest_ridge(grid, folds, [1], [], "h", steps=12)
    return out.select("series_id", "fold", "step", "ts", "y", rounded("pred", 4).alias("pred"))


@register(f"""WITH {_X}, m AS (SELECT series_id, pos, lag(y) OVER w AS a, unnest([1, 2, 3]) AS step, unnest([y, lead(y, 1) OVER w, lead(y, 2) OVER w]) AS y FROM x WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
s AS (SELECT max(pos) + 1 AS n, floor(0.7 * (max(pos) + 1)::DOUBLE)::BIGINT AS init FROM x),
folds AS (SELECT unnest(range(0, (n - init + 23) // 24))::BIGINT AS fold, n, init FROM s),
b AS (SELECT fold, init + 24 * fold AS train_to, least(init + 24 * fold + 3, n) AS test_to FROM folds),
c AS (SELECT series_id, fold, step, train_to, test_to, covar_pop(a, y) * count(*) / (regr_sxx(a, a) + 1) AS k, avg(y) AS my, avg(a) AS ma
  FROM m JOIN b ON m.pos + step - 1 < b.train_to WHERE a IS NOT NULL AND y IS NOT NULL GROUP BY ALL)
SELECT c.series_id, fold, step::INT AS step, t.ts, t.y, {rsql("k * o.y + my - k * ma", 4)} AS pred FROM c JOIN x o ON o.series_id = c.series_id AND o.pos = train_to - 1
JOIN x t ON t.series_id = c.series_id AND t.pos = train_to + step - 1 WHERE t.pos < test_to""")
def backtest_direct(spark, d):
    grid = _filled(spark, d)
    n = _span(grid)
    folds = evaluation.cv_folds(spark, n=n, initial=int(0.7 * n), steps=3, stride=24)
    out = models.backtest_direct(grid, folds, models.Design([1]), 3)
    return out.select("series_id", "fold", "step", "ts", "y", rounded("pred", 4).alias("pred"))


@register(f"""WITH RECURSIVE {_X}, m AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY pos) AS a FROM x),
c AS (SELECT series_id, covar_pop(a, y) * count(*) / (regr_sxx(a, a) + 1) AS k, avg(y) AS my, avg(a) AS ma, arg_max(y, pos) AS last, max(ts) AS t FROM m WHERE a IS NOT NULL GROUP BY 1),
r AS (SELECT series_id, quantile_cont(y - k * a - my + k * ma, list_transform(range(0, 201), lambda i: i / 200)) AS resid FROM m JOIN c USING (series_id) WHERE a IS NOT NULL GROUP BY 1),
f AS (SELECT series_id, k, my - k * ma AS b0, t, resid, p, 0::BIGINT AS step, last AS v, last AS pred FROM c JOIN r USING (series_id), range(0, 250) g(p)
  UNION ALL SELECT series_id, k, b0, t, resid, p, step + 1, k * v + b0 + resid[1 + ('0x' || substr(md5('123|' || series_id || '|' || p || '|' || (step + 1)), 1, 8))::BIGINT % 201], k * pred + b0 FROM f WHERE step < 12)
SELECT series_id, step::INT AS step, t + to_hours(step) AS ts, {rsql("any_value(pred)", 4)} AS pred, {rsql("quantile_cont(v, 0.1)", 4)} AS lower_bound, {rsql("quantile_cont(v, 0.9)", 4)} AS upper_bound
FROM f WHERE step > 0 GROUP BY series_id, step, t""")
def bootstrap_interval(spark, d):
    """Quantiles of 250 paths whose residuals are drawn from the model's own."""
    grid = _filled(spark, d)
    matrix, names, target = models.design_matrix(grid, models.Design([1]))
    betas = models.fit_ridge(matrix, names, ["series_id"], target=target)
    resid = models.residual_quantiles(matrix, betas, names, ["series_id"], target)
    out = models.recursive_forecast(models.tails_at_end(grid, 1), betas, [1], [], 12, "h", interval=(0.1, 0.9), residuals=resid)
    return out.select("series_id", "step", "ts", *[rounded(c, 4).alias(c) for c in ("pred", "lower_bound", "upper_bound")])


_SMOOTHING = [(0.1, 0.0, 0.1), (0.3, 0.05, 0.1), (0.3, 0.05, 0.3)]


@register(f"""WITH RECURSIVE {_X}, g AS (SELECT unnest({[a for a, _, _ in _SMOOTHING]})::DOUBLE AS a, unnest({[b for _, b, _ in _SMOOTHING]})::DOUBLE AS b, unnest({[c for _, _, c in _SMOOTHING]})::DOUBLE AS c),
v AS (SELECT series_id, list(y ORDER BY pos) AS v FROM x GROUP BY 1),
i AS (SELECT series_id, v, len(v) AS n, list_avg(v[1:24]) AS l0, (list_avg(v[25:48]) - list_avg(v[1:24])) / 24 AS t0 FROM v),
f AS (SELECT series_id, v, n, a, b, c, 0::BIGINT AS t, l0 AS l, t0 AS tr, list_transform(v[1:24], lambda q: q - l0) AS s, 0.0::DOUBLE AS err FROM i, g
  UNION ALL SELECT series_id, v, n, a, b, c, t + 1, nl, b * (nl - l) + (1 - b) * tr,
    list_concat(list_concat(s[1:t % 24], [c * (v[t + 1] - nl) + (1 - c) * s[1 + t % 24]]), s[t % 24 + 2:24]), err + (v[t + 1] - l - tr - s[1 + t % 24]) ** 2
  FROM (SELECT *, a * (v[t + 1] - s[1 + t % 24]) + (1 - a) * (l + tr) AS nl FROM f WHERE t < n)),
best AS (SELECT series_id, n, l, tr, s FROM f WHERE t = n QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY err, a, b, c) = 1)
SELECT series_id, k::BIGINT AS step, {rsql("l + k * tr + s[1 + (n + k - 1) % 24]", 4)} AS pred FROM best, range(1, 13) h(k)""")
def holt_winters_forecast(spark, d):
    out = models.statistical_forecast(_filled(spark, d), 12, 24, smoothing=_SMOOTHING)
    return out.select("series_id", F.col("step").cast("long").alias("step"), rounded("pred", 4).alias("pred"))


@register()
def tree_forecast(spark, d):
    return models.forest_forecast(_filled(spark, d), [1, 2, 24], 3, "random_forest", numTrees=10, maxDepth=4).select("series_id", "step", rounded("pred", 3).alias("pred"))


@register(f"""WITH RECURSIVE {_PANEL}, m AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY pos) AS a FROM x),
s AS (SELECT n, least(floor(0.7 * n::DOUBLE)::BIGINT, n - 24) AS init FROM (SELECT len(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS n FROM hourly)),
folds AS (SELECT unnest(range(0, (n - init + 11) // 12))::BIGINT AS fold, n, init FROM s),
b AS (SELECT fold, init + 12 * fold AS train_to, least(init + 12 * fold + 12, n) AS test_to FROM folds),
c AS (SELECT fold, train_to, test_to, covar_pop(a, y) * count(*) / (regr_sxx(a, a) + 1) AS k, avg(y) AS my, avg(a) AS ma FROM m JOIN b ON m.pos < b.train_to WHERE a IS NOT NULL GROUP BY ALL),
f AS (SELECT x.series_id, fold, train_to, test_to, k, my - k * ma AS b0, 0::BIGINT AS step, x.y AS pred FROM c JOIN x ON x.pos = train_to - 1
  UNION ALL SELECT series_id, fold, train_to, test_to, k, b0, step + 1, k * pred + b0 FROM f WHERE step < 12),
r AS (SELECT 'ridge' AS candidate, f.series_id, avg(abs(x.y - pred)) AS mae FROM f JOIN x ON x.series_id = f.series_id AND x.pos = train_to + step - 1 WHERE step > 0 AND x.pos < test_to GROUP BY ALL),
nv AS (SELECT 'seasonal_naive' AS candidate, x.series_id, avg(abs(x.y - o.y)) AS mae FROM x JOIN b ON x.pos >= train_to AND x.pos < test_to
  JOIN x o ON o.series_id = x.series_id AND o.pos = x.pos - 24 GROUP BY ALL),
v AS (SELECT candidate, avg(mae) AS value FROM (SELECT * FROM r UNION ALL SELECT * FROM nv) GROUP BY 1)
SELECT candidate, {rsql("value", 5)} AS value, row_number() OVER (ORDER BY value)::BIGINT AS rank FROM v""")
def compare_candidates(spark, d):
    a = Assistant(hourly(spark, d), "ts", "y", "series_id", freq="h", fill="zero")
    ridge = {"strategy": "multi_series", "estimator": "ridge", "lags": [1], "windows": [], "calendar": [], "scale": False, "encode_series": False}
    found = a.compare([("ridge", ridge), ("seasonal_naive", {"estimator": "seasonal_naive"})], 12, "mae")
    return found.leaderboard.select("candidate", rounded("value", 5).alias("value"), "rank")


@register(f"""WITH RECURSIVE {USER_DAYS}, m AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY pos) AS a FROM user_grid),
s AS (SELECT max(pos) + 1 AS n, floor(0.5 * (max(pos) + 1)::DOUBLE)::BIGINT AS init FROM m),
folds AS (SELECT unnest(range(0, (n - init + 2) // 3))::BIGINT AS fold, n, init FROM s),
b AS (SELECT fold, init + 3 * fold AS train_to, least(init + 3 * fold + 3, n) AS test_to FROM folds),
c AS (SELECT fold, train_to, test_to, covar_pop(a, y) * count(*) / (regr_sxx(a, a) + 1) AS k, avg(y) AS my, avg(a) AS ma FROM m JOIN b ON m.pos < b.train_to WHERE a IS NOT NULL GROUP BY ALL),
f AS (SELECT m.series_id, fold, train_to, test_to, k, my - k * ma AS b0, 0::BIGINT AS step, m.y AS pred FROM c JOIN m ON m.pos = train_to - 1
  UNION ALL SELECT series_id, fold, train_to, test_to, k, b0, step + 1, k * pred + b0 FROM f WHERE step < 3)
SELECT f.series_id, fold, step::INT AS step, m.ts, m.y, {rsql("pred", 5)} AS pred FROM f JOIN m ON m.series_id = f.series_id AND m.pos = train_to + step - 1 WHERE step > 0 AND m.pos < test_to""")
def backtest_ragged(spark, d):
    """Series that start and end on different days: folds are the same days for all, no model sees a day after its cut."""
    a = Assistant(user_days(spark, d), "ts", "y", "series_id", freq="D", fill="zero")
    plan = a.plan(3, strategy="multi_series", estimator="ridge", lags=[1], windows=[], calendar=[], scale=False, encode_series=False)
    out = a.backtest(plan, a.create_cv(plan, initial=int(0.5 * a.profile().span))).predictions
    return out.select("series_id", "fold", "step", "ts", "y", rounded("pred", 5).alias("pred"))
