"""Queries of trees, search, intervals, statistical models and drift, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.functions import scaling
from seriesloom.operators import autocorrelation, buckets, drift, evaluation, features
from seriesloom.plans import arima, models, quantiles, search
from seriesloom.queries.base import HOURLY, REVENUE, hourly_grid, revenue, revenue_grid, rounded, rsql, table
from seriesloom.queries.registry import _two_sided_sql as two_sided_sql
from seriesloom.queries.registry import register

# Recursive forecasts by boosted trees


def _stump(k: int, residual: str) -> str:
    """The best split of ``full_rows(a, b, y)`` by either feature, missing values to either side, as the table ``stump{k}``."""
    return f"""e{k} AS (SELECT unnest([1, 2]) AS f, unnest([a, b]) AS v, {residual} AS e FROM full_rows, base{"".join(f", stump{i}" for i in range(1, k))}),
g{k} AS (SELECT f, v, sum(e) AS s, count(*) AS n FROM e{k} GROUP BY ALL),
k{k} AS (SELECT f, v, sum(s) OVER w AS ks, sum(n) OVER w AS kn FROM g{k} WHERE v IS NOT NULL WINDOW w AS (PARTITION BY f ORDER BY v)),
m{k} AS (SELECT f, coalesce(sum(s) FILTER (v IS NULL), 0) AS ms, coalesce(sum(n) FILTER (v IS NULL), 0) AS mn, sum(s) AS ts, sum(n) AS tn FROM g{k} GROUP BY f),
c{k} AS (SELECT f, v, side, ks + CASE side WHEN 0 THEN ms ELSE 0 END AS ls, kn + CASE side WHEN 0 THEN mn ELSE 0 END AS ln, ts, tn
  FROM k{k} JOIN m{k} USING (f), (SELECT unnest([0, 1]) AS side)),
stump{k} AS (SELECT f AS f{k}, v AS v{k}, side AS side{k}, 0.5 * ls / (ln + 1) AS l{k}, 0.5 * (ts - ls) / (tn - ln + 1) AS r{k} FROM c{k} WHERE ln >= 5 AND tn - ln >= 5
  ORDER BY round(ls * ls / (ln + 1) + (ts - ls) * (ts - ls) / (tn - ln + 1) - ts * ts / (tn + 1), 9) DESC, f, v, side LIMIT 1)"""


def _leaf(k: int, a: str, b: str) -> str:
    x = f"CASE f{k} WHEN 1 THEN {a} ELSE {b} END"
    return f"CASE WHEN {x} IS NULL AND side{k} = 0 OR {x} <= v{k} THEN l{k} ELSE r{k} END"


@register(f"""WITH RECURSIVE {HOURLY}, m AS (SELECT series_id, pos, y, lag(y, 1) OVER w AS a, lag(y, 24) OVER w AS b FROM hourly_grid WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
full_rows AS (SELECT * FROM m WHERE y IS NOT NULL AND pos >= 24), base AS (SELECT avg(y) AS c FROM full_rows),
{_stump(1, "y - c")}, {_stump(2, f"y - c - {_leaf(1, 'a', 'b')}")},
e AS (SELECT series_id, arg_max(y, pos) AS last, max(pos) AS p, max(ts) AS t FROM hourly_grid WHERE y IS NOT NULL GROUP BY 1),
f AS (SELECT series_id, p, t, 0::BIGINT AS step, last AS pred FROM e
  UNION ALL SELECT series_id, p, t, step + 1, c + {_leaf(1, "pred", "b")} + {_leaf(2, "pred", "b")}
  FROM (SELECT f.*, x.y AS b FROM f LEFT JOIN hourly_grid x ON x.series_id = f.series_id AND x.pos = p + step + 1 - 24), base, stump1, stump2 WHERE step < 12)
SELECT series_id, step::INT AS step, t + to_hours(step) AS ts, {rsql("pred", 5)} AS pred FROM f WHERE step > 0""")
def recursive_tree_forecast(spark, d):
    """Two boosted stumps of all series over rows that lack values, walked step by step with the predictions fed back."""
    grid = hourly_grid(spark, d)
    matrix, names, target = models.design_matrix(grid, models.Design([1, 24]))
    trees = models.fit_trees(matrix, names, params={"maxIter": 2, "maxDepth": 1, "stepSize": 0.5, "maxBins": 512, "minRows": 5}, target=target)
    out = models.recursive_forecast(models.tails_at_end(grid, 24), trees, [1, 24], [], 12, "h")
    return out.select("series_id", "step", "ts", rounded("pred", 5).alias("pred"))


# Statistical models


def _ols(y: str, x: str, z: str, rows: str) -> str:
    """Coefficients b1, b2 and intercept b0 of a regression on two features, by series."""
    return f"""(SELECT series_id, b1, b2, my - b1 * mx - b2 * mz AS b0 FROM (SELECT *, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS b1, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS b2
FROM (SELECT series_id, avg({y}) AS my, avg({x}) AS mx, avg({z}) AS mz, regr_sxx({x}, {x}) AS sxx, regr_sxx({z}, {z}) AS szz, covar_pop({x}, {z}) * count(*) AS sxz,
covar_pop({x}, {y}) * count(*) AS sxy, covar_pop({z}, {y}) * count(*) AS szy FROM {rows} GROUP BY series_id)))"""


@register(f"""WITH RECURSIVE {REVENUE}, x AS (SELECT *, coalesce(y, 0) AS v, coalesce(y, 0) - lag(coalesce(y, 0)) OVER (ORDER BY pos) AS z FROM revenue_grid),
l AS (SELECT *, lag(z) OVER (ORDER BY pos) AS a FROM x),
r AS (SELECT regr_slope(z, a) AS k, regr_intercept(z, a) AS c FROM l WHERE a IS NOT NULL),
e AS (SELECT series_id, ts, pos, v, z, a, z - k * a - c AS e FROM l, r), m AS (SELECT *, lag(e) OVER (ORDER BY pos) AS b FROM e),
full_rows AS (SELECT * FROM m WHERE a IS NOT NULL AND b IS NOT NULL), o AS {_ols("z", "a", "b", "full_rows")},
t AS (SELECT arg_max(v, pos) AS y, arg_max(z, pos) AS z, arg_max(e, pos) AS e, max(ts) AS ts FROM e),
f AS (SELECT ts, b1, b2, b0, 0::BIGINT AS step, y AS pred, z, e FROM o, t
  UNION ALL SELECT ts, b1, b2, b0, step + 1, pred + b1 * z + b2 * e + b0, b1 * z + b2 * e + b0, 0.0 FROM f WHERE step < 6)
SELECT step::INT AS step, ts + to_days(step::INT) AS ts, {rsql("pred", 0)} AS pred FROM f WHERE step > 0""")
def arima_forecast(spark, d):
    """Daily changes of revenue by one lag of values and one of shocks, the changes added up again."""
    grid = revenue_grid(spark, d).withColumn("y", F.coalesce("y", F.lit(0.0)))
    out = arima.arima_forecast(grid, 6, "D", 1, long=1, tried=[(1, 1, 0, 0)])
    return out.select("step", "ts", rounded("pred", 0).alias("pred"))


@register(f"""WITH {HOURLY}, x AS (SELECT series_id, pos, coalesce(y, 0) AS y FROM hourly_grid),
l AS (SELECT *, lag(y, 1) OVER w AS a, lag(y, 2) OVER w AS b FROM x WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
full_rows AS (SELECT * FROM l WHERE b IS NOT NULL),
o AS {_ols("y", "a", "b", "full_rows")},
s AS (SELECT f.series_id, count(*) AS n, regr_syy(y, a) AS r0, regr_syy(y, a) - regr_sxy(y, a) ** 2 / regr_sxx(y, a) AS r1, sum((y - b1 * a - b2 * b - b0) ** 2) AS r2 FROM full_rows f JOIN o USING (series_id) GROUP BY 1),
c AS (SELECT series_id, unnest([0, 1, 2]) AS p, n * ln(unnest([r0, r1, r2]) / n) + (unnest([0, 1, 2]) + 2) * ln(n) AS score FROM s)
SELECT series_id, arg_min(p, score)::BIGINT AS p, {rsql("min(score)", 3)} AS score FROM c GROUP BY 1""")
def arima_order(spark, d):
    """The best number of autoregressive lags, up to two, of each series by BIC, from one matrix of sums."""
    grid = hourly_grid(spark, d).withColumn("y", F.coalesce("y", F.lit(0.0)))
    fits, _ = arima.fit_arima(grid, max_p=2, max_q=0, long=1)
    return fits.select("series_id", F.col("p").cast("long").alias("p"), rounded("criterion", 3).alias("score"))


# Intervals from residuals by predicted level and from folds


@register(f"""WITH RECURSIVE {HOURLY}, x AS (SELECT series_id, ts, pos, coalesce(y, 0) AS y FROM hourly_grid),
m AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY pos) AS a FROM x),
c AS (SELECT series_id, covar_pop(a, y) * count(*) / (regr_sxx(a, a) + 1) AS k, avg(y) AS my, avg(a) AS ma, arg_max(y, pos) AS last, max(ts) AS t FROM m WHERE a IS NOT NULL GROUP BY 1),
h AS (SELECT series_id, k * a + my - k * ma AS p, y - k * a - my + k * ma AS e FROM m JOIN c USING (series_id) WHERE a IS NOT NULL),
g AS (SELECT series_id, quantile_cont(p, [0.25, 0.5, 0.75]) AS edges, quantile_cont(e, list_transform(range(0, 201), lambda i: i / 200)) AS whole FROM h GROUP BY 1),
b AS (SELECT h.series_id, len(list_filter(edges, lambda q: p > q + 1e-9 * greatest(1, abs(q)))) AS bin, quantile_cont(e, list_transform(range(0, 201), lambda i: i / 200)) AS grid FROM h JOIN g USING (series_id) GROUP BY ALL),
r AS (SELECT g.series_id, edges, list(coalesce(grid, whole) ORDER BY i) AS grids FROM g CROSS JOIN range(0, 4) s(i) LEFT JOIN b ON b.series_id = g.series_id AND b.bin = i GROUP BY ALL),
f AS (SELECT c.series_id, k, my - k * ma AS b0, t, edges, grids, p, 0::BIGINT AS step, last AS v, last AS pred FROM c JOIN r USING (series_id), range(0, 250) n(p)
  UNION ALL SELECT series_id, k, b0, t, edges, grids, p, step + 1, k * v + b0
    + grids[1 + len(list_filter(edges, lambda q: k * v + b0 > q + 1e-9 * greatest(1, abs(q))))][1 + ('0x' || substr(md5('123|' || series_id || '|' || p || '|' || (step + 1)), 1, 8))::BIGINT % 201], k * pred + b0 FROM f WHERE step < 12)
SELECT series_id, step::INT AS step, t + to_hours(step) AS ts, {rsql("any_value(pred)", 4)} AS pred, {rsql("quantile_cont(v, 0.1)", 4)} AS lower_bound, {rsql("quantile_cont(v, 0.9)", 4)} AS upper_bound
FROM f WHERE step > 0 GROUP BY series_id, step, t""")
def interval_by_level(spark, d):
    """Quantiles of 250 paths, each drawing its residuals from the level of its own prediction."""
    grid = hourly_grid(spark, d).withColumn("y", F.coalesce("y", F.lit(0.0)))
    matrix, names, target = models.design_matrix(grid, models.Design([1]))
    betas = models.fit_ridge(matrix, names, ["series_id"], target=target)
    resid = models.residuals_by_level(matrix, betas, names, ["series_id"], target, 4)
    out = models.recursive_forecast(models.tails_at_end(grid, 1), betas, [1], [], 12, "h", interval=(0.1, 0.9), residuals=resid)
    return out.select("series_id", "step", "ts", *[rounded(c, 4).alias(c) for c in ("pred", "lower_bound", "upper_bound")])


@register(f"""WITH {HOURLY}, x AS (SELECT series_id, ts, pos, coalesce(y, 0) AS y FROM hourly_grid),
m AS (SELECT series_id, ts, y, [{", ".join(f"lag(y, {24 * k}) OVER w" for k in range(1, 11))}] AS paths, pos FROM x WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
s AS (SELECT series_id, y, unnest(paths) AS a, paths FROM m WHERE pos >= 240),
d AS (SELECT m.series_id, m.ts, list_avg(list_transform(paths, lambda a: abs(a - y))) - list_sum(list_transform(paths, lambda a: list_sum(list_transform(paths, lambda b: abs(a - b))))) / 200 AS score FROM m WHERE pos >= 240)
SELECT series_id, {rsql("avg(score)", 5)} AS crps FROM d GROUP BY 1""")
def crps_samples(spark, d):
    """The ranked probability score of ten samples a row, the values of the same hour on the ten days before."""
    w = Window.partitionBy("series_id").orderBy("pos")
    grid = hourly_grid(spark, d).withColumn("y", F.coalesce("y", F.lit(0.0)))
    rows = grid.withColumn("paths", F.array(*[F.lag("y", 24 * k).over(w) for k in range(1, 11)])).where("pos >= 240")
    return evaluation.crps_from_samples(rows).select("series_id", rounded("crps", 5).alias("crps"))


# Drift by chunk


_OLD = "TIMESTAMP '2024-01-16'"
_CHUNKS = f"""e AS (SELECT event_type AS series_id, value AS y, date_trunc('day', ts)::TIMESTAMP AS chunk, ts < {_OLD} AS old FROM events WHERE value IS NOT NULL),
k AS (SELECT DISTINCT series_id, chunk, old FROM e),
v AS (SELECT DISTINCT series_id, y FROM e)"""


def _chunks(spark, d):
    events = table(spark, d, "events").where("value is not null")
    rows = events.select(F.col("event_type").alias("series_id"), F.col("value").alias("y"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("chunk"), (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("old"))
    return rows.where("old"), rows.where("not old")


@register(f"""WITH {_CHUNKS}, r AS (SELECT series_id, y, count(*) AS n FROM e WHERE old GROUP BY ALL),
f AS (SELECT v.series_id, v.y, coalesce(sum(n) OVER (PARTITION BY v.series_id ORDER BY v.y), 0) / sum(n) OVER (PARTITION BY v.series_id) AS ref FROM v LEFT JOIN r ON r.series_id = v.series_id AND r.y = v.y),
c AS (SELECT series_id, chunk, old, y, count(*) AS n FROM e GROUP BY ALL),
g AS (SELECT k.series_id, k.chunk, k.old, f.y, f.ref, coalesce(sum(c.n) OVER (PARTITION BY k.series_id, k.chunk, k.old ORDER BY f.y), 0) / sum(c.n) OVER (PARTITION BY k.series_id, k.chunk, k.old) AS own
  FROM k JOIN f USING (series_id) LEFT JOIN c ON c.series_id = k.series_id AND c.chunk = k.chunk AND c.old = k.old AND c.y = f.y),
s AS (SELECT series_id, chunk, old, max(abs(own - ref)) AS ks FROM g GROUP BY ALL),
l AS (SELECT series_id, avg(ks) + 3 * stddev_samp(ks) AS most FROM s WHERE old GROUP BY 1)
SELECT series_id, chunk, {rsql("ks", 6)} AS ks, {rsql("most", 6)} AS ks_limit, ks > most AS ks_drifted FROM s JOIN l USING (series_id) WHERE NOT old""")
def drift_by_chunk(spark, d):
    """Each day of the second half against the whole first half, with the limits that the first half's own days teach."""
    old, new = _chunks(spark, d)
    limits = drift.learned_thresholds(drift.chunk_ks(old, old), ["ks"])
    flagged, _ = drift.chunk_drift(drift.chunk_ks(old, new), limits, ["ks"])
    return flagged.select("series_id", "chunk", rounded("ks", 6).alias("ks"), rounded("ks_limit", 6).alias("ks_limit"), "ks_drifted")


@register(f"""WITH {_CHUNKS}, r AS (SELECT series_id, floor(y / 50)::BIGINT AS bin, count(*) AS n FROM e WHERE old GROUP BY ALL),
c AS (SELECT series_id, chunk, floor(y / 50)::BIGINT AS bin, count(*) AS n FROM e WHERE NOT old GROUP BY ALL),
b AS (SELECT DISTINCT c.series_id, c.chunk, u.bin FROM c, LATERAL (SELECT r.bin FROM r WHERE r.series_id = c.series_id UNION SELECT x.bin FROM c x WHERE x.series_id = c.series_id AND x.chunk = c.chunk) u),
t AS (SELECT b.series_id, b.chunk, coalesce(c.n, 0) AS a, coalesce(r.n, 0) AS o, sum(coalesce(c.n, 0)) OVER w AS ta, sum(coalesce(r.n, 0)) OVER w AS tb
  FROM b LEFT JOIN c ON c.series_id = b.series_id AND c.chunk = b.chunk AND c.bin = b.bin LEFT JOIN r ON r.series_id = b.series_id AND r.bin = b.bin WINDOW w AS (PARTITION BY b.series_id, b.chunk)),
j AS (SELECT *, a / ta AS q, o / tb AS p FROM t)
SELECT series_id, chunk, max(ta)::BIGINT AS n,
{rsql("sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0))", 6)} AS js,
{rsql("sum((a - (a + o) * ta / (ta + tb)) ** 2 / ((a + o) * ta / (ta + tb)) + (o - (a + o) * tb / (ta + tb)) ** 2 / ((a + o) * tb / (ta + tb)))", 4)} AS chi2, (count(*) - 1)::BIGINT AS df
FROM j GROUP BY ALL""")
def drift_chunk_categories(spark, d):
    """Jensen-Shannon distance and chi-square of each day's bins against those of the whole first half."""
    old, new = (x.withColumn("bin", F.floor(F.col("y") / 50)) for x in _chunks(spark, d))
    out = drift.chunk_categories(old, new, "bin")
    return out.select("series_id", "chunk", "n", rounded("js", 6).alias("js"), rounded("chi2", 4).alias("chi2"), F.col("df").cast("long").alias("df"))


# Search and selection from sums of products


@register(f"""WITH {HOURLY}, x AS (SELECT series_id, pos, coalesce(y, 0) AS y FROM hourly_grid),
m AS (SELECT pos, y, lag(y, 1) OVER w AS l1, lag(y, 24) OVER w AS l24 FROM x WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
full_rows AS (SELECT * FROM m WHERE l24 IS NOT NULL), t AS (SELECT * FROM full_rows WHERE pos < 500), v AS (SELECT * FROM full_rows WHERE pos >= 500),
a AS (SELECT unnest([1.0, 100.0])::DOUBLE AS alpha),
g AS (SELECT avg(y) AS my, avg(l1) AS m1, avg(l24) AS m2, regr_sxx(l1, l1) AS s11, regr_sxx(l24, l24) AS s22, covar_pop(l1, l24) * count(*) AS s12, covar_pop(l1, y) * count(*) AS s1y, covar_pop(l24, y) * count(*) AS s2y FROM t),
f AS (SELECT alpha, unnest(['lag_1', 'lag_24', 'lag_1,lag_24']) AS features,
  unnest([s1y / (s11 + alpha), 0, (s1y * (s22 + alpha) - s2y * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12)]) AS b1,
  unnest([0, s2y / (s22 + alpha), (s2y * (s11 + alpha) - s1y * s12) / ((s11 + alpha) * (s22 + alpha) - s12 * s12)]) AS b2, my, m1, m2 FROM g, a)
SELECT features, alpha, {rsql("sqrt(avg((y - my - b1 * (l1 - m1) - b2 * (l24 - m2)) ** 2))", 6)} AS rmse FROM f, v GROUP BY ALL""")
def one_step_search(spark, d):
    """Six tries of lags and penalties, all scored from one pair of matrices of sums."""
    grid = hourly_grid(spark, d).withColumn("y", F.coalesce("y", F.lit(0.0)))
    found = search.lag_search(grid, [[1], [24], [1, 24]], [1.0, 100.0], 500)
    rows = [(",".join(s["features"]), s["alpha"], s["rmse"]) for s in found.scores]
    return spark.createDataFrame(rows, "features string, alpha double, rmse double").select("features", "alpha", rounded("rmse", 6).alias("rmse"))


@register(f"""WITH {HOURLY}, x AS (SELECT series_id, pos, coalesce(y, 0) AS y FROM hourly_grid),
m AS (SELECT pos // 180 AS fold, y, lag(y, 1) OVER w AS l1, lag(y, 24) OVER w AS l2 FROM x WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
r AS (SELECT * FROM m WHERE l2 IS NOT NULL), f AS (SELECT DISTINCT fold FROM r),
g AS (SELECT f.fold, avg(y) AS my, avg(l1) AS m1, avg(l2) AS m2, regr_sxx(l1, l1) AS s11, regr_sxx(l2, l2) AS s22, covar_pop(l1, l2) * count(*) AS s12, covar_pop(l1, y) * count(*) AS s1y, covar_pop(l2, y) * count(*) AS s2y, count(*) AS n
  FROM f JOIN r ON r.fold <> f.fold GROUP BY 1),
b AS (SELECT *, (s1y * (s22 + 1) - s2y * s12) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS b1, (s2y * (s11 + 1) - s1y * s12) / ((s11 + 1) * (s22 + 1) - s12 * s12) AS b2 FROM g),
c AS (SELECT *, abs(b1) * sqrt(s11 / n) < abs(b2) * sqrt(s22 / n) AS first_goes FROM b),
e AS (SELECT c.fold, avg((y - my - b1 * (l1 - m1) - b2 * (l2 - m2)) ** 2) AS two,
  avg((y - my - CASE WHEN first_goes THEN s2y / (s22 + 1) * (l2 - m2) ELSE s1y / (s11 + 1) * (l1 - m1) END) ** 2) AS one FROM c JOIN r USING (fold) GROUP BY 1)
SELECT unnest([1, 2])::BIGINT AS features, {rsql("unnest([avg(one), avg(two)])", 6)} AS mse FROM e""")
def feature_elimination_cv(spark, d):
    """The held-out error of each number of features, eliminated anew within every fold from its sums."""
    grid = hourly_grid(spark, d).withColumn("y", F.coalesce("y", F.lit(0.0)))
    matrix = features.train_matrix(grid, [1, 24]).withColumn("fold", F.floor(F.col("pos") / 180))
    _, scores = search.select_features_cv(matrix, ["lag_1", "lag_24"], "fold")
    rows = [(s["features"], s["mse"]) for s in scores]
    return spark.createDataFrame(rows, "features long, mse double").select("features", rounded("mse", 6).alias("mse"))


# One long series in buckets


@register(f"""WITH {REVENUE} SELECT ts, pos, y, lag(y, 1) OVER o AS lag_1, lag(y, 30) OVER o AS lag_30, CASE WHEN count(y) OVER w = 7 THEN {rsql("avg(y) OVER w", 3)} END AS roll_mean_7,
CASE WHEN count(y) OVER v = 30 THEN {rsql("max(y) OVER v", 3)} END AS roll_max_30 FROM revenue_grid
WINDOW o AS (ORDER BY pos), w AS (ORDER BY pos ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), v AS (ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def bucketed_features(spark, d):
    """Grid, lags and rolling statistics of one series, cut into buckets with halos."""
    grid = buckets.bucketed_asfreq(revenue(spark, d), "D", 256)
    out = buckets.bucketed_features(grid, [1, 30], [("mean", 7), ("max", 30)], rows=256)
    return out.select("ts", "pos", "y", "lag_1", "lag_30", rounded("roll_mean_7", 3).alias("roll_mean_7"), rounded("roll_max_30", 3).alias("roll_max_30"))


@register(f"""WITH {HOURLY}, s AS (SELECT *, sum((y IS NOT NULL)::INT) OVER w AS back, sum((y IS NOT NULL)::INT) OVER (PARTITION BY series_id ORDER BY pos DESC) AS ahead FROM hourly_grid WINDOW w AS (PARTITION BY series_id ORDER BY pos)),
k AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN pos END) OVER (PARTITION BY series_id, back) AS p0, max(y) OVER (PARTITION BY series_id, back) AS y0,
  max(CASE WHEN y IS NOT NULL THEN pos END) OVER (PARTITION BY series_id, ahead) AS p1, max(y) OVER (PARTITION BY series_id, ahead) AS y1 FROM s)
SELECT series_id, ts, pos, {rsql("CASE WHEN y IS NOT NULL THEN y ELSE y0 + (y1 - y0) * (pos - p0) / (p1 - p0) END", 6)} AS filled FROM k""")
def bucketed_fill(spark, d):
    """Linear filling by buckets of positions, across those without a value."""
    out = buckets.bucketed_fill(hourly_grid(spark, d), "interpolate", rows=50)
    return out.select("series_id", "ts", "pos", rounded("filled", 6).alias("filled"))


# Power transformations


_POWERS = [-1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0]


@register(f"""WITH x AS (SELECT event_type AS series_id, value + 1 AS y FROM events WHERE value IS NOT NULL AND value > 0),
p AS (SELECT unnest({_POWERS})::DOUBLE AS k),
s AS (SELECT series_id, k, round(-count(*) / 2 * ln(var_pop(CASE WHEN k = 0 THEN ln(y) ELSE (y ** k - 1) / k END)) + (k - 1) * sum(ln(y)), 9) AS score FROM x, p GROUP BY series_id, k)
SELECT series_id, k AS exponent FROM s QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY score DESC, abs(k - 1), k) = 1""")
def power_transform(spark, d):
    """The exponent of greatest likelihood of each event type's values, from one aggregate over the grid."""
    events = table(spark, d, "events").where("value > 0").select(F.col("event_type").alias("series_id"), F.col("value").alias("y"))
    return scaling.fit_power(events, powers=_POWERS).select("series_id", "exponent")


# The whole lag screen


_TRIED_LAGS = 12


@register(f"""WITH RECURSIVE {REVENUE}, z AS (SELECT pos, coalesce(y, 0) - lag(coalesce(y, 0)) OVER (ORDER BY pos) AS z FROM revenue_grid),
e AS (SELECT pos, z - avg(z) OVER () AS e FROM z WHERE z IS NOT NULL),
a AS (SELECT k, sum(e.e * e2.e) / (SELECT sum(e * e) FROM e) AS r FROM e, range(1, {_TRIED_LAGS + 1}) t(k) JOIN e e2 ON e2.pos = e.pos - k GROUP BY k),
r AS (SELECT list(r ORDER BY k) AS r, (SELECT count(*) FROM e) AS n FROM a),
d AS (SELECT 1::BIGINT AS k, [r[1]] AS phi, r[1] AS pacf, r, n FROM r
  UNION ALL SELECT k + 1, list_append(list_transform(range(1, k + 1), lambda j: phi[j] - next * phi[k + 1 - j]), next), next, r, n
  FROM (SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS next FROM d WHERE k < {_TRIED_LAGS})),
p AS (SELECT k, pacf, {two_sided_sql("least(abs(pacf) * sqrt(n / 2), 4)")} AS p FROM d),
b AS (SELECT *, max(CASE WHEN p <= rk * 0.05 / m THEN p END) OVER () AS cut FROM (SELECT *, row_number() OVER (ORDER BY p, k) AS rk, count(*) OVER () AS m FROM p))
SELECT k AS lag, {rsql("pacf", 6)} AS pacf FROM b WHERE p <= cut AND abs(pacf) > 0.05""")
def significant_lags(spark, d):
    """Partial autocorrelations of the changes of daily revenue that pass the false-discovery screen and the effect floor."""
    grid = features.difference(revenue_grid(spark, d).withColumn("y", F.coalesce("y", F.lit(0.0))))
    grid = grid.where("pos > 0").select("series_id", "ts", (F.col("pos") - 1).alias("pos"), F.col("diff").alias("y"))
    return autocorrelation.significant_lags(grid, _TRIED_LAGS, min_effect=0.05).select("lag", rounded("pacf", 6).alias("pacf"))


# Missing features


@register(f"""WITH {REVENUE}, m AS (SELECT ts, pos, y, lag(y, 7) OVER o AS lag_7, CASE WHEN count(y) OVER w = 3 THEN avg(y) OVER w END AS roll FROM revenue_grid
WINDOW o AS (ORDER BY pos), w AS (ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT ts, {rsql("coalesce(lag_7, median(lag_7) OVER ())", 4)} AS lag_7, {rsql("coalesce(roll, median(roll) OVER ())", 4)} AS roll_mean_3 FROM m""")
def feature_fill(spark, d):
    """Lags and rolling means whose missing values are the series' medians."""
    out = features.fill_features(features.add_features(revenue_grid(spark, d), [7], [("mean", 3)]), ["lag_7", "roll_mean_3"], "median")
    return out.select("ts", rounded("lag_7", 4).alias("lag_7"), rounded("roll_mean_3", 4).alias("roll_mean_3"))


# Quantile regression: iterated, so without a statement; its tests compare it with the optimum of linear programming


@register()
def quantile_forecast(spark, d):
    """The next two hours of every series as three quantiles by linear models of two lags."""
    grid = hourly_grid(spark, d).withColumn("y", F.coalesce("y", F.lit(0.0)))
    out = quantiles.quantile_forecast(grid, models.Design([1, 24]), 2, "h", [0.1, 0.5, 0.9], per_series=False, iterations=12)
    return out.select("series_id", "step", "ts", *[rounded(F.col(f"`q_{q}`"), 2).alias(f"q_{int(100 * q)}") for q in (0.1, 0.5, 0.9)])
