"""Forecasting models as Spark jobs.

Linear models are fitted from sums of products, which partial aggregates of every partition give, so no
task ever holds a series' rows; only the small normal equations are solved by row. Walk-forward refits
share these sums: rows are summed once for each stretch between fold bounds, and every fold adds up its
stretches. Recursive forecasts feed predictions back, step by step within a row of tails. Direct
forecasts learn from rows of an origin and a step; any registered estimator may learn from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.calendar import add_calendar
from seriesloom.functions.frequency import Freq
from seriesloom.operators.features import ARRAY_STATS, add_features, difference, integrate, multivariate_lags, rolling_name, window_size

from seriesloom.plans.trees import Ensemble, boost, joined, spark_ensemble

#: Points of the quantile grid that stands for a model's residuals.
RESIDUAL_POINTS = 201


@dataclass(frozen=True)
class Design:
    """What a model sees: lags, windows and calendar of the series, and columns of the grid that are known ahead."""

    lags: list[int]
    windows: list[tuple[str, int]] = field(default_factory=list)
    calendar: list[str] = field(default_factory=list)
    encoding: str | None = None
    exog: list[str] = field(default_factory=list)
    differentiation: int = 0

    @property
    def reach(self) -> int:
        return window_size(self.lags, self.windows, self.differentiation)


def gram_sums(matrix: DataFrame, features: list[str], keys: list[str], target: str = "y", weight: str | None = None) -> DataFrame:
    """Sums of products of (features, target, 1) by ``keys``: rows ``keys…, i, value``; null rows are left out.

    With ``weight``, a column of the matrix, each row counts that often.

    Each task gives the packed sums of its keys; the shuffle adds them by place. Nulls are dropped in the
    task: a filter over as many aliased columns would make the optimizer's constraint sets explode.
    """
    names = [*features, target]
    width = len(names) + 1
    rows = matrix.select(*keys, *[F.col(f"`{n}`").cast("double").alias(f"_c{i}") for i, n in enumerate(names)], *([F.col(weight).cast("double").alias("_w")] if weight else []))

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            groups = frame.groupby(keys, dropna=False, sort=False) if keys else [((), frame)]
            out: dict[str, list] = {k: [] for k in keys} | {"sums": []}
            for key, part in groups:
                x = part[[f"_c{i}" for i in range(len(names))]].to_numpy(float)
                whole = ~np.isnan(x).any(1)
                x = x[whole]
                if not len(x):
                    continue
                x = np.hstack([x, np.ones((len(x), 1))])
                if weight:
                    x = x * np.sqrt(np.maximum(np.nan_to_num(part["_w"].to_numpy(float)[whole]), 0))[:, None]
                for k, v in zip(keys, key if isinstance(key, tuple) else (key,), strict=True):
                    out[k].append(v)
                out["sums"].append((x.T @ x).ravel())
            if out["sums"]:
                yield pd.DataFrame(out)

    schema = "".join(f"`{k}` {matrix.schema[k].dataType.simpleString()}, " for k in keys) + "sums array<double>"
    parts = rows.mapInPandas(partial, schema).select(*keys, F.posexplode("sums").alias("i", "value"))
    return parts.groupBy(*keys, "i").agg(F.sum("value").alias("value")).withColumn("width", F.lit(width))


def solve_ridge(sums: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients with the intercept last, and the residual deviation, from packed sums."""
    width = int(round(len(sums) ** 0.5))
    g = sums.reshape(width, width)
    p, n = width - 2, g[-1, -1]
    mean = g[-1, :-1] / n
    centred = g[:-1, :-1] - n * np.outer(mean, mean)
    xx, xy, yy = centred[:p, :p], centred[:p, p], centred[p, p]
    beta = np.linalg.lstsq(xx + alpha * np.eye(p), xy, rcond=None)[0] if p else np.zeros(0)
    rest = max(yy - 2 * beta @ xy + beta @ xx @ beta, 0.0)
    return np.append(beta, mean[p] - beta @ mean[:p]), float(np.sqrt(rest / max(n - p - 1, 1)))


def _solve(sums: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    packed = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("cells")).where(F.size("cells") > 0)

    def run(frames):
        for frame in frames:
            fits = [solve_ridge(np.array([c["value"] for c in cells]), alpha) for cells in frame["cells"]]
            yield frame[keys].assign(beta=[b.tolist() for b, _ in fits], sigma=[s for _, s in fits])

    schema = "".join(f"`{k}` {sums.schema[k].dataType.simpleString()}, " for k in keys) + "beta array<double>, sigma double"
    return packed.mapInPandas(run, schema)


def fit_ridge(matrix: DataFrame, features: list[str], keys: list[str] | None = None, alpha: float = 1.0, target: str = "y", weight: str | None = None) -> DataFrame:
    """``keys…, beta, sigma``: a ridge model for each key, or one for all rows."""
    keys = keys or []
    return _solve(gram_sums(matrix, features, keys, target, weight), keys, alpha)


def fitted_value(features: list[str]) -> Column:
    """The linear prediction of a row from its ``beta`` and features, in built-in expressions."""
    x = F.array(*[F.col(f"`{n}`").cast("double") for n in features], F.lit(1.0))
    return F.aggregate(F.zip_with(x, F.col("beta"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def residual_quantiles(matrix: DataFrame, betas: DataFrame, features: list[str], keys: list[str], target: str = "y") -> DataFrame:
    """``keys…, resid``: in-sample residuals of each model as ``RESIDUAL_POINTS`` exact quantiles, a bounded row a key."""
    shared = [c for c in betas.columns if c in matrix.columns and c not in ("beta", "sigma")]
    joined = matrix.join(betas, shared) if shared else matrix.crossJoin(F.broadcast(betas))  # one model
    resid = (F.col(target) - fitted_value(features)).alias("_e")
    points = [i / (RESIDUAL_POINTS - 1) for i in range(RESIDUAL_POINTS)]
    return joined.select(*keys, resid).where("_e is not null").groupBy(*keys).agg(F.percentile("_e", F.array(*map(F.lit, points))).alias("resid"))


#: How far above an edge a value must be to lie beyond it, so that ties fall alike whatever the rounding.
EDGE_SLACK = 1e-9


def _beyond(value: Column, edge: Column) -> Column:
    return value > edge + EDGE_SLACK * F.greatest(F.lit(1.0), F.abs(edge))


def level_quantiles(fitted: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """``keys…, resid, edges, by_level``: residuals ``_t - pred`` of ``fitted`` by the level of the prediction.

    ``edges`` are the inner quantiles of the predictions of a key, ``by_level`` one grid of residual
    quantiles for each bin between them, ``resid`` the grid of all, which also stands for empty bins. A
    bounded row a key, whatever its rows.
    """
    points = F.array(*[F.lit(i / (RESIDUAL_POINTS - 1)) for i in range(RESIDUAL_POINTS)])
    rows = fitted.where("_t is not null and pred is not null").select(*keys, F.col("pred").cast("double").alias("_p"), (F.col("_t") - F.col("pred")).alias("_e"))
    cuts = F.array(*[F.lit(i / bins) for i in range(1, bins)]) if bins > 1 else None
    by = rows.groupBy(*keys).agg((F.percentile("_p", cuts) if bins > 1 else F.array().cast("array<double>")).alias("edges"), F.percentile("_e", points).alias("resid"))
    by = by if keys else by.where("resid is not null")
    joined = rows.join(by.select(*keys, "edges"), keys) if keys else rows.crossJoin(F.broadcast(by.select("edges")))  # one row
    level = F.size(F.filter("edges", lambda e: _beyond(F.col("_p"), e)))
    grids = joined.groupBy(*keys, level.alias("_bin")).agg(F.percentile("_e", points).alias("grid"))
    held = grids.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "grid"))).alias("_grids"))  # at most one a bin
    out = by.join(held, keys) if keys else by.crossJoin(F.broadcast(held))
    places = F.sequence(F.lit(0), F.lit(bins - 1))
    return out.select(*keys, "resid", "edges", F.transform(places, lambda b: F.coalesce(F.try_element_at("_grids", b), F.col("resid"))).alias("by_level"))


def residuals_by_level(matrix: DataFrame, betas: DataFrame, features: list[str], keys: list[str], target: str = "y", bins: int = 10) -> DataFrame:
    """In-sample residuals of linear models as ``level_quantiles``."""
    shared = [c for c in betas.columns if c in matrix.columns and c not in ("beta", "sigma")]
    joined = matrix.join(betas, shared) if shared else matrix.crossJoin(F.broadcast(betas))  # one model
    return level_quantiles(joined.select(*keys, F.col(f"`{target}`").alias("_t"), fitted_value(features).alias("pred")), keys, bins)


def fold_residuals(preds: DataFrame, bins: int = 1, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """What the folds of a backtest missed, rows that their models had not seen, as ``level_quantiles``."""
    return level_quantiles(preds.withColumn("_t", F.col("y")), list(keys), bins)


def feature_names(lags: list[int], windows: list[tuple[str, int]], extra: list[str] | None = None) -> list[str]:
    return [f"lag_{k}" for k in lags] + [rolling_name(s, n) for s, n in windows] + (extra or [])


def matrix_of(grid: DataFrame, lags: list[int], windows: list[tuple[str, int]], calendar: list[str] | None = None, encoding: str | None = None) -> tuple[DataFrame, list[str], list[str]]:
    """Features beside the grid, all feature names, and those known ahead."""
    before = set(grid.columns)
    dated = add_calendar(grid, calendar or [], encoding)
    ahead = [c for c in dated.columns if c not in before]
    return add_features(dated, lags, windows), feature_names(lags, windows, ahead), ahead


def _row_back(reach: int) -> Column:
    """The position ``reach`` rows before in the same series, null where it has not so many: its features are not whole there."""
    return F.lag("pos", reach).over(Window.partitionBy("series_id").orderBy("pos"))


def design_matrix(grid: DataFrame, design: Design) -> tuple[DataFrame, list[str], str]:
    """The matrix of a design over ``grid``, its feature names and the name of its target.

    With differentiation, lags and windows look at the differenced series, which is also the target.
    """
    target = "y"
    if design.differentiation:
        grid, target = difference(grid, design.differentiation, out="_z"), "_z"
    before = set(grid.columns)
    dated = add_calendar(grid, design.calendar, design.encoding)
    ahead = [c for c in dated.columns if c not in before]
    out = add_features(dated.withColumn("_back", _row_back(design.reach)), design.lags, design.windows, target).where("_back is not null").drop("_back")
    return out, feature_names(design.lags, design.windows, [*ahead, *design.exog]), target


def roll_forward(tail: np.ndarray, model: np.ndarray | Callable[[np.ndarray], np.ndarray], lags: list[int], windows: list[tuple[str, int]], known: np.ndarray, noise: np.ndarray | Callable[[int, np.ndarray], np.ndarray] | None = None, differentiation: int = 0, stats: dict | None = None, paths: int | None = None) -> np.ndarray:
    """Recursive predictions, a row for each step and a column for each path of ``noise`` (one path without).

    ``model`` is coefficients with the intercept last, or a function of features x paths. ``noise`` may be a
    function of the step and the ``paths`` predictions, for noise that follows their level.
    """
    stats = stats or ARRAY_STATS
    value = model if callable(model) else lambda x: model[:-1] @ x + model[-1]
    paths = paths if callable(noise) else noise.shape[1] if noise is not None else 1
    past = np.repeat(np.asarray(tail, float)[:, None], paths, 1)
    held = np.diff(past, differentiation, axis=0)
    out = np.empty((len(known), paths))
    for s, extra in enumerate(known):
        parts = [held[-k] for k in lags] + [stats[stat](held[-n:], axis=0) for stat, n in windows]
        x = np.vstack([*parts, np.repeat(np.asarray(extra, float)[:, None], paths, 1)]) if len(parts) + len(extra) else np.zeros((0, paths))
        out[s] = value(x)
        if noise is not None:
            out[s] += noise(s, out[s]) if callable(noise) else noise[s]
        held = np.vstack([held, out[s]])
    return integrate(out, past, differentiation)


def draws(name: str, steps: int, paths: int) -> np.ndarray:
    """Whole numbers, a row for each step, that follow from a hash of name, path and step."""
    return np.array([int(hashlib.md5(f"{name}|{p}|{s + 1}".encode()).hexdigest()[:8], 16) for s in range(steps) for p in range(paths)], np.int64).reshape(steps, paths)


def drawn(resid: np.ndarray, name: str, steps: int, paths: int) -> np.ndarray:
    """Residuals drawn with replacement, a row for each step: which one follows from a hash of name, path and step."""
    return np.asarray(resid, float)[draws(name, steps, paths) % len(resid)]


def drawn_by_level(edges: np.ndarray, by_level: np.ndarray, name: str, steps: int, paths: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Residuals drawn like ``drawn`` from the grid of the level that each path's own prediction has."""
    at, top = draws(name, steps, paths), edges + EDGE_SLACK * np.maximum(1.0, np.abs(edges))
    return lambda s, pred: by_level[np.searchsorted(top, pred, "left"), at[s] % by_level.shape[1]]


def with_known(ahead: DataFrame, exog: DataFrame | None, names: list[str]) -> DataFrame:
    """``ahead`` with the columns ``names`` of ``exog``, joined by series and timestamp, or by what of these it has."""
    if not names:
        return ahead
    if exog is None:
        raise ValueError(f"the model uses {', '.join(names)}: give their future rows")
    keys = [c for c in ("series_id", "ts") if c in exog.columns]
    return ahead.join(exog.select(*keys, *names).dropDuplicates(keys), keys, "left")


def recursive_forecast(
    tails: DataFrame,
    betas: DataFrame | Ensemble,
    lags: list[int],
    windows: list[tuple[str, int]],
    steps: int,
    freq: str,
    calendar: list[str] | None = None,
    encoding: str | None = None,
    interval: tuple[float, float] | None = None,
    paths: int = 250,
    seed: int = 123,
    residuals: DataFrame | None = None,
    exog: DataFrame | None = None,
    exog_names: list[str] | None = None,
    differentiation: int = 0,
    model_of: dict[int, int] | None = None,
    keep_paths: bool = False,
) -> DataFrame:
    """``steps`` predictions for each row of ``tails(series_id, …keys, last_ts, tail)``: ``…, step, ts, pred`` and bounds.

    ``betas`` joins on the columns that it shares with ``tails``; an ensemble of trees goes to every task,
    where ``model_of`` names the model of each fold. Steps follow one another within a row,
    rows are independent. Intervals are quantiles of ``paths`` bootstrap paths, whose residuals are drawn
    from ``residuals`` (of ``residual_quantiles``, joined like ``betas``) by a hash of the seed, the row's
    keys, the path and the step; with ``keep_paths`` the paths themselves are the column ``paths``. Where ``residuals`` are by level, from the level of the path's own
    prediction. ``exog`` has the rows ahead of the columns ``exog_names``; where one is
    missing a linear prediction is null, and trees take their branch for missing values.
    """
    if interval and residuals is None:
        raise ValueError("intervals need the model's residuals")
    if keep_paths and not interval:
        raise ValueError("paths come with an interval")
    step = Freq.parse(freq)
    keys = [c for c in tails.columns if c not in ("last_ts", "tail")]
    trees = betas if isinstance(betas, Ensemble) else None
    if trees:
        rows = tails.withColumn("beta", F.lit(None).cast("array<double>"))
    else:
        shared = [c for c in betas.columns if c in keys]
        rows = tails.join(betas, shared) if shared else tails.crossJoin(F.broadcast(betas))  # one model
    if interval:
        on = [c for c in residuals.columns if c in keys]
        if "by_level" not in residuals.columns:
            residuals = residuals.withColumns({"edges": F.lit(None).cast("array<double>"), "by_level": F.lit(None).cast("array<array<double>>")})
        rows = rows.join(residuals, on) if on else rows.crossJoin(F.broadcast(residuals))  # one model
    else:
        rows = rows.withColumns({"resid": F.lit(None).cast("array<double>"), "edges": F.lit(None).cast("array<double>"), "by_level": F.lit(None).cast("array<array<double>>")})
    held = ["tail", "beta", "resid", "edges", "by_level"]
    none = F.array().cast("array<double>")
    if calendar or exog_names:
        ahead = rows.select(*keys, *held, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "last_ts").withColumn("ts", step.shift(F.col("last_ts"), F.col("step")))
        dated = add_calendar(ahead, calendar or [], encoding)
        names = [*[c for c in dated.columns if c not in ahead.columns], *(exog_names or [])]
        dated = with_known(dated, exog, exog_names or [])
        known = F.array(*[F.col(n).cast("double") for n in names]) if names else none
        packed = dated.groupBy(*keys).agg(*[F.first(c).alias(c) for c in held], F.array_sort(F.collect_list(F.struct("step", "ts", known.alias("known")))).alias("ahead"))
    else:  # nothing is known ahead: the steps stay in their row, and nothing is shuffled
        places = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda s: F.struct(s.alias("step"), step.shift(F.col("last_ts"), s).alias("ts"), none.alias("known")))
        packed = rows.select(*keys, *held, places.alias("ahead"))

    stats = {stat: ARRAY_STATS[stat] for stat, _ in windows}  # the caller's own go to the workers too

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                extra = [list(a["known"]) for a in r["ahead"]]
                tail = np.array(r["tail"], float)
                if trees:
                    number = model_of[r["fold"]] if model_of else 0
                    model = lambda x, number=number: trees.predict(x.T, number)
                else:
                    model = np.array(r["beta"], float)
                extra = np.array([[np.nan if x is None else x for x in e] for e in extra], float)
                pred = roll_forward(tail, model, lags, windows, extra, None, differentiation, stats)[:, 0]
                low = high = ends = [None] * steps
                if interval:
                    name = "|".join(str(x) for x in [seed, *[r[k] for k in keys]])
                    if r["by_level"] is None:
                        noise = drawn(np.array(r["resid"], float), name, steps, paths)
                    else:
                        noise = drawn_by_level(np.array(r["edges"], float), np.array([list(g) for g in r["by_level"]], float), name, steps, paths)
                    ends = roll_forward(tail, model, lags, windows, extra, noise, differentiation, stats, paths)
                    low, high = np.quantile(ends, interval[0], axis=1), np.quantile(ends, interval[1], axis=1)
                out += [(*[r[k] for k in keys], a["step"], a["ts"], None if np.isnan(p) else float(p), None if lo is None else float(lo), None if hi is None else float(hi), *([e.tolist()] if keep_paths else [])) for a, p, lo, hi, e in zip(r["ahead"], pred, low, high, ends, strict=True)]
            yield pd.DataFrame(out, columns=[*keys, "step", "ts", "pred", "lower_bound", "upper_bound", *(["paths"] if keep_paths else [])])

    schema = "".join(f"`{k}` {tails.schema[k].dataType.simpleString()}, " for k in keys) + "step int, ts timestamp_ntz, pred double, lower_bound double, upper_bound double" + ", paths array<double>" * keep_paths
    out = packed.mapInPandas(run, schema)
    return out if interval else out.drop("lower_bound", "upper_bound")


def path_distribution(preds: DataFrame) -> DataFrame:
    """``preds`` with the normal distribution of their ``paths``: ``loc`` and ``scale``."""
    mean = F.aggregate("paths", F.lit(0.0), lambda s, x: s + x) / F.size("paths")
    spread = lambda m: F.sqrt(F.aggregate("paths", F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.size("paths") - 1))
    return preds.withColumn("loc", mean).withColumn("scale", spread(F.col("loc")))


def path_quantiles(preds: DataFrame, quantiles: list[float]) -> DataFrame:
    """``preds`` with a column ``q_<quantile>`` for each of the ``paths``' quantiles, by linear interpolation."""
    ordered, n = F.array_sort("paths"), F.size("paths")
    at = lambda i: F.element_at(ordered, (i + 1).cast("int"))
    place = lambda q: (n - 1) * F.lit(q)
    low = lambda q: F.floor(place(q))
    return preds.withColumns({f"q_{q}": at(low(q)) + (at(F.least(low(q) + 1, n - 1)) - at(low(q))) * (place(q) - low(q)) for q in quantiles})


def tails_at_end(grid: DataFrame, size: int) -> DataFrame:
    """The ``size`` rows of each series up to its last value in order, nulls among them, and its timestamp."""
    last = grid.where("y is not null").groupBy("series_id").agg(F.max("pos").alias("_last"), F.max("ts").alias("last_ts"))
    rows = grid.join(last, "series_id").where((F.col("pos") > F.col("_last") - size) & (F.col("pos") <= F.col("_last")))
    cells = F.array_sort(F.collect_list(F.struct("pos", "y")))
    return rows.groupBy("series_id", "last_ts").agg(F.transform(cells, lambda c: c["y"]).alias("tail"))


def tails_at_folds(grid: DataFrame, folds: DataFrame, size: int, with_null: bool = False) -> DataFrame:
    """The ``size`` values before the end of each fold's training range, by series and fold; whole tails only, of values or of rows."""
    spans = folds.select("fold", "train_to", F.explode(F.sequence(F.col("train_to") - size, F.col("train_to") - 1)).alias("pos"))
    cells = F.array_sort(F.collect_list(F.struct("pos", "y")))
    rows = (grid if with_null else grid.where("y is not null")).join(spans, "pos").groupBy("series_id", "fold").agg(F.max("ts").alias("last_ts"), F.transform(cells, lambda c: c["y"]).alias("tail"))
    return rows.where(F.size("tail") == size)


def first_cuts(grid: DataFrame, folds: DataFrame, reach: int) -> DataFrame:
    """``series_id, cut``: the end of the first training range in which a series has ``reach`` rows, or else the last one's.

    Where a panel is ragged, this is what a late series is scaled and judged by; for series that are there
    from the start it is the first fold's.
    """
    ends = sorted(r[0] for r in folds.select("train_to").distinct().collect())  # a row a fold
    begin = grid.where("y is not null").groupBy("series_id").agg(F.min("pos").alias("_first"))
    fits = F.filter(F.array(*[F.lit(int(e)) for e in ends]), lambda e: e >= F.col("_first") + reach)
    return begin.select("series_id", F.coalesce(F.array_min(fits), F.lit(int(ends[-1]))).cast("long").alias("cut"))


def first_rows(grid: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows of each series before its ``cut``."""
    return grid.join(cuts, "series_id").where(F.col("pos") < F.col("cut")).drop("cut")


def fit_folds(matrix: DataFrame, features: list[str], folds: DataFrame, keys: list[str], alpha: float = 1.0, target: str = "y", at: str = "pos", weight: str | None = None) -> DataFrame:
    """A ridge model for each fold that fits (and key) from sums over the stretches between their bounds.

    Columns ``keys…, model_from, model_to, beta, sigma``: folds without a fit of their own find there the
    model of the last that had one.
    """
    ranges = folds.select("model_from", "model_to").distinct()
    found = ranges.collect()  # a row a fit
    bounds = sorted({b for r in found for b in r})
    edges = F.array(*[F.lit(int(b)) for b in bounds])
    stretch = F.size(F.filter(edges, lambda e: e <= F.col(at))) - 1
    sums = gram_sums(matrix.withColumn("_stretch", stretch.cast("long")), features, [*keys, "_stretch"], target, weight)
    start = F.element_at(edges, (F.col("_stretch") + 1).cast("int"))
    placed = sums.where("_stretch >= 0").withColumn("_start", start)
    met = placed.join(F.broadcast(ranges), (F.col("_start") >= F.col("model_from")) & (F.col("_start") < F.col("model_to")))
    whole = met.groupBy(*keys, "model_from", "model_to", "i").agg(F.sum("value").alias("value"))
    return _solve(whole, [*keys, "model_from", "model_to"], alpha)


def longest_test(folds: DataFrame) -> int:
    return folds.agg(F.max(F.col("test_to") - F.col("test_from"))).first()[0]


def scored(preds: DataFrame, grid: DataFrame, folds: DataFrame, gap: int) -> DataFrame:
    """Predictions of steps from the end of training, with the values that came: ``series_id, fold, step, ts, y, pred`` and bounds."""
    bounds = [c for c in ("lower_bound", "upper_bound") if c in preds.columns]
    preds = preds.where(F.col("step") > gap).select("series_id", "fold", (F.col("step") - gap).cast("int").alias("step"), "ts", "pred", *bounds)
    met = preds.join(grid.select("series_id", "ts", "pos", "y"), ["series_id", "ts"]).join(F.broadcast(folds.select("fold", "test_to")), "fold")
    return met.where(F.col("pos") < F.col("test_to")).select("series_id", "fold", "step", "ts", "y", "pred", *bounds)


def _with_pooled(grid: DataFrame, by: DataFrame, pooled: DataFrame) -> DataFrame:
    """The residuals of each series, or those of all where it has none yet; ``pooled`` is one row."""
    names = [c for c in by.columns if c != "series_id"]
    every = grid.select("series_id").distinct().join(by, "series_id", "left").crossJoin(F.broadcast(pooled.select(*[F.col(c).alias(f"_all_{c}") for c in names])))
    return every.select("series_id", *[F.coalesce(c, f"_all_{c}").alias(c) for c in names])


def backtest_ridge(grid: DataFrame, folds: DataFrame, lags: list[int], windows: list[tuple[str, int]], freq: str, calendar=None, encoding=None, alpha: float = 1.0, per_series: bool = True, steps: int | None = None, gap: int = 0, exog: list[str] | None = None, differentiation: int = 0, weight: str | None = None, interval: tuple[float, float] | None = None, residual_bins: int = 0) -> DataFrame:
    """Recursive predictions of every fold by the model of its last fit: ``series_id, fold, step, ts, y, pred`` and bounds.

    ``exog`` are columns of the grid, known ahead. Bounds resample the residuals that the first fit's
    model has on its training rows, for a series that starts later those of all series.
    """
    design = Design(lags, windows, calendar or [], encoding, exog or [], differentiation)
    matrix, names, target = design_matrix(grid, design)
    keys = ["series_id"] if per_series else []
    models = fit_folds(matrix, names, folds, keys, alpha, target, weight=weight)
    steps = longest_test(folds) if steps is None else steps
    fits = folds.select("fold", "model_from", "model_to")
    betas = models.join(F.broadcast(fits), ["model_from", "model_to"]).drop("model_from", "model_to")
    resid = None
    if interval:
        first = folds.orderBy("fold").limit(1).select("model_from", "model_to")
        start = models.join(F.broadcast(first), ["model_from", "model_to"]).drop("model_from", "model_to")
        train = matrix.join(F.broadcast(first), (F.col("pos") >= F.col("model_from")) & (F.col("pos") < F.col("model_to"))).drop("model_from", "model_to")
        of = lambda keys: residuals_by_level(train, start, names, keys, target, residual_bins) if residual_bins else residual_quantiles(train, start, names, keys, target)
        resid = _with_pooled(grid, of(["series_id"]), of([]))
    tails = tails_at_folds(grid, folds, design.reach)
    known = grid.select("series_id", "ts", *design.exog) if design.exog else None
    preds = recursive_forecast(tails, betas, lags, windows, steps + gap, freq, calendar, encoding, interval, residuals=resid, exog=known, exog_names=design.exog, differentiation=differentiation)
    return scored(preds, grid, folds, gap)


# Recursive forecasts by trees


#: Estimators whose models are trees that tasks can walk.
WALKED = ("gbt", "spark_gbt", "random_forest", "decision_tree")


def fit_trees(matrix: DataFrame, features: list[str], ranges: list[tuple[int, int]] | None = None, kind: str = "gbt", params: dict | None = None, target: str = "y", weight: str | None = None, drop_null: bool = False, at: str = "pos") -> Ensemble:
    """One ensemble for each range of positions, or one of all rows. Boosted ones of all ranges grow in the same passes.

    ``gbt`` has a branch for missing features. Spark's own trees have none: a missing feature is below all
    values there. With ``drop_null`` rows that miss one are left out.
    """
    rows = matrix.where(F.col(f"`{target}`").isNotNull())
    if drop_null:
        rows = _complete(rows, features, True)
    if kind == "gbt":
        return boost(rows, features, target, ranges, at, weight, **(params or {}))
    learner, rows = make_estimator(kind, **(params or {})), _complete(rows, features, drop_null)
    inside = [F.lit(True)] if ranges is None else [(F.col(at) >= a) & (F.col(at) < b) for a, b in ranges]
    return joined([spark_ensemble(learner.fit(rows.where(c), features, target, weight)[1]) for c in inside])


def tree_residuals(matrix: DataFrame, trees: Ensemble, features: list[str], keys: list[str], target: str = "y", model: int = 0, bins: int = 0) -> DataFrame:
    """``keys…, resid``: residuals of one model of an ensemble on the rows of ``matrix``, as ``residual_quantiles`` gives them, or by level."""
    one = replace(trees, roots=[trees.roots[model]], base=trees.base[model : model + 1])
    kept = matrix.where(F.col(f"`{target}`").isNotNull()).select(*keys, F.col(f"`{target}`").cast("double").alias("_t"), *[F.col(f"`{n}`") for n in dict.fromkeys(features) if n not in keys])
    points = [i / (RESIDUAL_POINTS - 1) for i in range(RESIDUAL_POINTS)]
    if bins:
        return level_quantiles(one.transform(kept, features), keys, bins)
    seen = one.transform(kept, features).select(*keys, (F.col("_t") - F.col("pred")).alias("_e"))
    return seen.groupBy(*keys).agg(F.percentile("_e", F.array(*map(F.lit, points))).alias("resid"))


def backtest_trees(grid: DataFrame, folds: DataFrame, design: Design, freq: str, kind: str = "gbt", params: dict | None = None, steps: int | None = None, gap: int = 0, weight: str | None = None, interval: tuple[float, float] | None = None, drop_null: bool = False, residual_bins: int = 0) -> DataFrame:
    """Recursive predictions of every fold by the trees of its last fit: ``series_id, fold, step, ts, y, pred`` and bounds.

    One model for all series a fit. Bounds resample the residuals that the first fit has on its training
    rows, by series, or those of all series where one has none yet.
    """
    matrix, names, target = design_matrix(grid, design)
    fits = [tuple(r) for r in folds.select("fold", "model_from", "model_to").orderBy("fold").collect()]  # a row a fold
    ranges = sorted({r[1:] for r in fits})
    trees = fit_trees(matrix, names, ranges, kind, params, target, weight, drop_null)
    resid = None
    if interval:
        a, b = fits[0][1:]
        seen = matrix.where((F.col("pos") >= a) & (F.col("pos") < b))
        resid = _with_pooled(grid, *(tree_residuals(seen, trees, names, keys, target, ranges.index((a, b)), residual_bins) for keys in (["series_id"], [])))
    tails = tails_at_folds(grid, folds, design.reach, True)
    known = grid.select("series_id", "ts", *design.exog) if design.exog else None
    steps = longest_test(folds) if steps is None else steps
    preds = recursive_forecast(tails, trees, design.lags, design.windows, steps + gap, freq, design.calendar, design.encoding, interval, residuals=resid, exog=known, exog_names=design.exog, differentiation=design.differentiation, model_of={fold: ranges.index((a, b)) for fold, a, b in fits})
    return scored(preds, grid, folds, gap)


# Direct forecasts


def direct_rows(grid: DataFrame, design: Design, steps: int) -> tuple[DataFrame, list[str]]:
    """A row for each origin and step with its features: what was known before the origin, and what is known ahead of the target.

    Columns ``series_id, pos, step, target_pos, ts, target`` and the features; ``ts`` and calendar are the
    target's. One window for features and leads, then the steps unfold in place.
    """
    if design.differentiation:
        raise ValueError("direct forecasts are not differenced")
    w = Window.partitionBy("series_id").orderBy("pos")
    carried = ["y", "ts", *design.exog]
    leads = F.array(*[F.struct(F.lit(s).cast("long").alias("step"), *[F.lead(F.col(f"`{c}`"), s - 1).over(w).alias({"y": "target"}.get(c, c)) for c in carried]) for s in range(1, steps + 1)])
    past = feature_names(design.lags, design.windows)
    out = add_features(grid.withColumns({"_leads": leads, "_back": _row_back(design.reach)}), design.lags, design.windows)
    out = out.where("_back is not null").select("series_id", "pos", *[F.col(f"`{n}`") for n in past], F.inline("_leads")).withColumn("target_pos", F.col("pos") + F.col("step") - 1)
    before = set(out.columns)
    out = add_calendar(out, design.calendar, design.encoding)
    return out, [*past, *[c for c in out.columns if c not in before], *design.exog]


def extended(grid: DataFrame, steps: int, freq: str, exog: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """The grid with ``steps`` rows ahead of each series, their values null, their known columns from ``exog``."""
    last = grid.groupBy("series_id").agg(F.max("pos").alias("_pos"), F.max("ts").alias("_ts"))
    ahead = last.withColumn("_s", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    ahead = ahead.select("series_id", Freq.parse(freq).shift(F.col("_ts"), F.col("_s")).alias("ts"), (F.col("_pos") + F.col("_s")).alias("pos"), F.lit(None).cast("double").alias("y"))
    ahead = with_known(ahead, exog, names or [])
    return grid.unionByName(ahead, allowMissingColumns=True)


@dataclass(frozen=True)
class Estimator:
    """``fit(rows, features, target, weight)`` gives a model, ``predict(model, rows)`` the rows with ``pred``."""

    fit: Callable[..., object]
    predict: Callable[[object, DataFrame], DataFrame]


_ESTIMATORS: dict[str, Callable[..., Estimator]] = {}


def register_estimator(name: str, make: Callable[..., Estimator]) -> None:
    """An estimator for direct forecasts; ``make(**params)`` gives its fit and predict."""
    _ESTIMATORS[name] = make


def estimators() -> list[str]:
    return sorted(_ESTIMATORS)


def make_estimator(name: str, **params) -> Estimator:
    if name not in _ESTIMATORS:
        raise ValueError(f"unknown estimator {name!r}; known: ridge, seasonal_naive, holt_winters, {', '.join(estimators())}")
    return _ESTIMATORS[name](**params)


def _trees(kind: str) -> Callable[..., Estimator]:
    def make(seed: int = 123, **params) -> Estimator:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor

        regressor = {"spark_gbt": GBTRegressor, "random_forest": RandomForestRegressor, "decision_tree": DecisionTreeRegressor}[kind]

        def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
            numbered = {f"_f{i}": F.col(f"`{n}`") for i, n in enumerate(features)}  # names of features may have dots
            return VectorAssembler(inputCols=list(numbered), outputCol="_features", handleInvalid="keep").transform(rows.withColumns(numbered)).drop(*numbered)

        def fit(rows: DataFrame, features: list[str], target: str, weight: str | None = None):
            given = {"weightCol": weight} if weight else {}
            return features, regressor(featuresCol="_features", labelCol=target, predictionCol="pred", seed=seed, **given, **params).fit(assembled(rows, features))

        def predict(model, rows: DataFrame) -> DataFrame:
            features, fitted = model
            return fitted.transform(assembled(rows, features)).drop("_features")

        return Estimator(fit, predict)

    return make


for _kind in ("spark_gbt", "random_forest", "decision_tree"):
    register_estimator(_kind, _trees(_kind))


def _boosted(**params) -> Estimator:
    def fit(rows: DataFrame, features: list[str], target: str, weight: str | None = None):
        return features, boost(rows, features, target, None, "pos", weight, **params)

    return Estimator(fit, lambda model, rows: model[1].transform(rows, model[0]))


register_estimator("gbt", _boosted)

#: Stands for a missing feature where an estimator takes incomplete rows: below all values.
MISSING = -1e12


def _complete(rows: DataFrame, features: list[str], drop_null: bool) -> DataFrame:
    """Rows for a registered estimator, features as doubles; null ones are dropped or marked as missing."""
    double = {n: F.col(f"`{n}`").cast("double") for n in features}
    if drop_null:
        # one condition on an array: one a column would make the optimizer's constraint sets explode
        return rows.withColumns(double).where(~F.exists(F.array(*[F.col(f"`{n}`") for n in features]), lambda x: x.isNull()))
    return rows.withColumns({n: F.coalesce(c, F.lit(MISSING)) for n, c in double.items()})


def _bounds(preds: DataFrame, quantiles: DataFrame, keys: list[str], pooled: DataFrame | None = None) -> DataFrame:
    """Bounds ``pred`` plus the residual quantiles ``_lo`` and ``_hi`` of each key, or where it has none those of ``pooled`` by step."""
    if pooled is not None:
        steps = pooled.select("step", F.col("_lo").alias("_lo_all"), F.col("_hi").alias("_hi_all"))  # a row a step
        preds, at = preds.join(quantiles, keys, "left").join(F.broadcast(steps), "step", "left"), lambda c: F.coalesce(c, f"{c}_all")
        return preds.withColumns({"lower_bound": F.col("pred") + at("_lo"), "upper_bound": F.col("pred") + at("_hi")}).drop("_lo", "_hi", "_lo_all", "_hi_all")
    return preds.join(quantiles, keys, "left").withColumns({"lower_bound": F.col("pred") + F.col("_lo"), "upper_bound": F.col("pred") + F.col("_hi")}).drop("_lo", "_hi")


def _residuals(rows: DataFrame, keys: list[str], interval: tuple[float, float]) -> DataFrame:
    e = F.col("target") - F.col("pred")
    return rows.where("target is not null and pred is not null").groupBy(*keys).agg(F.percentile(e, interval[0]).alias("_lo"), F.percentile(e, interval[1]).alias("_hi"))


def predict_folds(rows: DataFrame, origins: DataFrame, names: list[str], folds: DataFrame, keys: list[str], estimator: str = "ridge", alpha: float = 1.0, params: dict | None = None, weight: str | None = None, drop_null: bool = True, interval: tuple[float, float] | None = None) -> DataFrame:
    """Direct predictions ``series_id, fold, step, ts, pred`` and bounds of ``folds(fold, model_from, model_to, train_to)``.

    Models learn from ``rows`` whose target is in their range; ``origins`` are rows of the same form, of
    which those at a fold's ``train_to`` are predicted. Ridge models of all folds and ``keys`` come from one
    pass, boosted trees of all folds grow in the same passes; another estimator is fitted for each fold that
    refits. These learn from all steps, with the step as a feature.
    Bounds add the quantiles of the first model's residuals of the same series and step, for a series that it
    has not seen those of the step.
    """
    rows = rows.where("target is not null")
    origins = origins.join(F.broadcast(folds.select("fold", "model_from", "model_to", F.col("train_to").alias("pos"))), "pos")
    ranges = [tuple(r) for r in folds.select("model_from", "model_to").distinct().orderBy("model_to", "model_from").collect()]  # a row a fit
    inside = lambda r: (F.col("target_pos") >= r[0]) & (F.col("target_pos") < r[1])
    of = lambda r: (F.col("model_from") == r[0]) & (F.col("model_to") == r[1])
    kept = ["series_id", "fold", "step", "ts", "pred"]
    if estimator == "ridge":
        models = fit_folds(rows, names, folds, keys, alpha, "target", "target_pos", weight)
        out = origins.join(models, [*keys, "model_from", "model_to"]).withColumn("pred", fitted_value(names)).select(*kept)
        if interval:
            first = models.where(of(ranges[0])).drop("model_from", "model_to")
            seen = rows.where(inside(ranges[0])).join(first, keys).withColumn("pred", fitted_value(names))
    elif estimator == "gbt":  # all folds' models grow in the same passes
        features = [*names, "step"]
        trees = fit_trees(rows, features, ranges, "gbt", params, "target", weight, drop_null, "target_pos")
        number = F.coalesce(*[F.when(of(r), F.lit(i)) for i, r in enumerate(ranges)])
        asked = _complete(origins, features, True) if drop_null else origins
        out = trees.transform(asked.withColumn("_model", number), features, "_model").select(*kept)
        if interval:
            seen = trees.transform((_complete(rows, features, True) if drop_null else rows).where(inside(ranges[0])).withColumn("_model", F.lit(0)), features, "_model")
    else:
        learner, features = make_estimator(estimator, **(params or {})), [*names, "step"]
        rows, origins = _complete(rows, features, drop_null), _complete(origins, features, drop_null)
        parts = []
        for i, r in enumerate(ranges):
            model = learner.fit(rows.where(inside(r)), features, "target", weight)
            parts.append(learner.predict(model, origins.where(of(r))).select(*kept))
            if interval and not i:
                seen = learner.predict(model, rows.where(inside(r)))
        out = reduce(DataFrame.unionByName, parts)
    return _bounds(out, _residuals(seen, ["series_id", "step"], interval), ["series_id", "step"], _residuals(seen, ["step"], interval)) if interval else out


def _weighed(rows: DataFrame, grid: DataFrame, weight: str | None) -> DataFrame:
    return rows.join(grid.select("series_id", F.col("pos").alias("target_pos"), weight), ["series_id", "target_pos"]) if weight else rows


def backtest_direct(grid: DataFrame, folds: DataFrame, design: Design, steps: int, gap: int = 0, per_series: bool = True, weight: str | None = None, **given) -> DataFrame:
    """Direct predictions of every fold: ``series_id, fold, step, ts, y, pred`` and bounds; ``given`` as for ``predict_folds``."""
    rows, names = direct_rows(grid, design, steps + gap)
    preds = predict_folds(_weighed(rows, grid, weight), rows, names, folds, (["series_id"] if per_series else []) + ["step"], weight=weight, **given)
    return scored(preds, grid, folds, gap)


def multivariate_rows(grid: DataFrame, series: list[str], lags: list[int], steps: int, freq: str) -> tuple[DataFrame, list[str]]:
    """Rows as of ``direct_rows`` for every named series, with the lags of all; the series share one grid."""
    wide = multivariate_lags(grid, series, lags, freq, steps)
    at = grid.where(F.col("series_id").isin(series)).groupBy("ts").agg(F.max("pos").alias("pos"))
    names = [f"{s}_lag_{k}" for s in series for k in lags]
    targets = F.array(*[F.struct(F.lit(level).alias("series_id"), F.lit(s).cast("long").alias("step"), F.col(f"`{level}_lead_{s}`").alias("target")) for level in series for s in range(1, steps + 1)])
    rows = wide.join(at, "ts").select(F.col("ts").alias("_ts"), "pos", *[F.col(f"`{n}`") for n in names], F.inline(targets))
    return rows.withColumns({"ts": Freq.parse(freq).shift(F.col("_ts"), (F.col("step") - 1).cast("int")), "target_pos": F.col("pos") + F.col("step") - 1}).drop("_ts"), names


def backtest_multivariate(grid: DataFrame, folds: DataFrame, series: list[str], lags: list[int], steps: int, freq: str, gap: int = 0, **given) -> DataFrame:
    """Direct multivariate predictions of every fold; ``given`` as for ``predict_folds``."""
    rows, names = multivariate_rows(grid, series, lags, steps + gap, freq)
    return scored(predict_folds(rows, rows, names, folds, ["series_id", "step"], **given), grid, folds, gap)


def one_fold(grid: DataFrame) -> DataFrame:
    """The fold of a plain forecast: trained on all rows of the longest series, from each series' end."""
    return grid.agg((F.max("pos") + 1).alias("n")).select(F.lit(0).cast("long").alias("fold"), F.lit(0).cast("long").alias("model_from"), F.col("n").alias("model_to"), F.col("n").alias("train_to"))


def direct_forecast(grid: DataFrame, lags: list[int], steps: int, per_series: bool = True, alpha: float = 1.0) -> DataFrame:
    """A ridge model for each step: ``series_id, step, pred``; predictions are built-in expressions over the last window."""
    from seriesloom.operators.features import direct_targets

    names = [f"lag_{k}" for k in lags]
    keys = (["series_id"] if per_series else []) + ["step"]
    betas = fit_ridge(direct_targets(grid, lags, steps), names, keys, alpha, "target")
    size = max(lags)
    tails = tails_at_end(grid, size).select("series_id", *[F.element_at("tail", F.lit(-k)).alias(f"lag_{k}") for k in lags])
    joined = tails.join(betas, "series_id") if per_series else tails.crossJoin(F.broadcast(betas))  # a row a step
    return joined.select("series_id", F.col("step").cast("int").alias("step"), fitted_value(names).alias("pred"))


def forecast_direct(grid: DataFrame, design: Design, steps: int, freq: str, exog: DataFrame | None = None, per_series: bool = True, weight: str | None = None, **given) -> DataFrame:
    """Direct predictions ``series_id, step, ts, pred`` and bounds from the end of each series; ``given`` as for ``predict_folds``.

    Positions are moved so that all series end at one, from which the extended grid's rows are the origins.
    """
    ends = grid.groupBy("series_id").agg((F.max("pos") + 1).alias("_end"))
    top = ends.agg(F.max("_end")).first()[0]
    moved = lambda df: df.join(ends, "series_id").withColumn("pos", F.col("pos") + F.lit(top) - F.col("_end")).drop("_end")
    train = moved(grid)
    rows, names = direct_rows(train, design, steps)
    origins, _ = direct_rows(moved(extended(grid, steps, freq, exog, design.exog)), design, steps)
    return predict_folds(_weighed(rows, train, weight), origins, names, one_fold(train), (["series_id"] if per_series else []) + ["step"], weight=weight, **given).drop("fold")


def multivariate_forecast(grid: DataFrame, levels: str | list[str], series: list[str], lags: list[int], steps: int, alpha: float = 1.0, freq: str = "D", interval: tuple[float, float] | None = None) -> DataFrame:
    """Direct forecasts of ``levels`` from the lags of all named series: ``series_id, step, pred`` and bounds.

    One matrix serves all levels and steps: each row unfolds to its targets in the task that sums it.
    """
    levels = [levels] if isinstance(levels, str) else levels
    wide = multivariate_lags(grid, series, lags, freq, steps)
    names = [f"{s}_lag_{k}" for s in series for k in lags]
    targets = F.array(*[F.struct(F.lit(level).alias("series_id"), F.lit(s).cast("int").alias("step"), F.col(f"`{level}_lead_{s}`").alias("target")) for level in levels for s in range(1, steps + 1)])
    matrix = wide.select(*[F.col(f"`{n}`") for n in names], F.inline(targets)).where("target is not null")
    betas = fit_ridge(matrix, names, ["series_id", "step"], alpha, "target")
    end = grid.where(F.col("series_id").isin(series)).agg(F.max("ts").alias("ts")).first()[0]
    back = F.array(*[Freq.parse(freq).shift(F.lit(end).cast("timestamp_ntz"), 1 - k) for k in lags])
    last = grid.where(F.col("series_id").isin(series) & F.array_contains(back, F.col("ts").cast("timestamp_ntz"))).select("series_id", F.array_position(back, F.col("ts").cast("timestamp_ntz")).alias("i"), "y")
    x = last.agg(*[F.max(F.when((F.col("series_id") == s) & (F.col("i") == i + 1), F.col("y"))).alias(f"{s}_lag_{k}") for s in series for i, k in enumerate(lags)])
    out = betas.crossJoin(F.broadcast(x)).select("series_id", "step", fitted_value(names).alias("pred"))  # one row
    if interval:
        seen = matrix.join(betas, ["series_id", "step"]).withColumn("pred", fitted_value(names))
        out = _bounds(out, _residuals(seen, ["series_id", "step"], interval), ["series_id", "step"])
    return out


def forest_forecast(grid: DataFrame, lags: list[int], steps: int, kind: str = "gbt", seed: int = 123, **params) -> DataFrame:
    """Direct forecasts by one global tree ensemble with the step as a feature: ``series_id, step, pred``."""
    from seriesloom.operators.features import direct_targets

    names, learner = [f"lag_{k}" for k in lags], make_estimator(kind, seed=seed, **params)
    model = learner.fit(direct_targets(grid, lags, steps).dropna(subset=names), [*names, "step"], "target", None)
    tails = tails_at_end(grid, max(lags))
    ahead = tails.select("series_id", *[F.element_at("tail", F.lit(-k)).alias(f"lag_{k}") for k in lags], F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    return learner.predict(model, ahead).select("series_id", "step", "pred")


# Statistical forecasts


def holt_winters(values: np.ndarray, season: int, steps: int, alpha: float, beta: float, gamma: float) -> tuple[np.ndarray, float]:
    """Additive Holt-Winters: forecasts, and the mean squared one-step error."""
    m = max(season, 1)
    level, trend = values[:m].mean(), (values[m : 2 * m].mean() - values[:m].mean()) / m if len(values) >= 2 * m else 0.0
    seasonal = list(values[:m] - level) if m > 1 else [0.0]
    errors = 0.0
    for t, y in enumerate(values):
        s = seasonal[t % m]
        e = y - (level + trend + s)
        errors += e * e
        new = alpha * (y - s) + (1 - alpha) * (level + trend)
        trend = beta * (new - level) + (1 - beta) * trend
        level = new
        if m > 1:
            seasonal[t % m] = gamma * (y - level) + (1 - gamma) * s
    ahead = np.array([level + (k + 1) * trend + seasonal[(len(values) + k) % m] for k in range(steps)])
    return ahead, errors / max(len(values), 1)


def holt_winters_widths(steps: int, season: int, alpha: float, beta: float, gamma: float) -> np.ndarray:
    """The forecast deviation of each step in units of the one-step deviation: the known formula of the additive model."""
    c = [alpha * (1 + j * beta) + (gamma * (1 - alpha) if season > 1 and j % season == 0 else 0.0) for j in range(1, steps)]
    return np.sqrt(1 + np.concatenate(([0.0], np.cumsum(np.square(c)))))


SMOOTHING = [(a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.0, 0.05, 0.2) for g in (0.1, 0.3)]


def statistical_forecast(grid: DataFrame, steps: int, season: int, folds: list[tuple[int, int, int, int]] | None = None, interval: tuple[float, float] | None = None, smoothing: list[tuple[float, float, float]] | None = None) -> DataFrame:
    """Holt-Winters for each series, smoothing chosen by the one-step error over a grid: ``series_id, fold, step, pred`` and bounds.

    ``folds`` has (fold, train_from, train_to, refit): each starts from its training rows; one that does
    not refit keeps the smoothing last chosen. Without folds all rows train one forecast, fold 0. Bounds
    are the model's own: its one-step deviation times the growth by step. The recursion is sequential
    within a series; series are grouped, one at a time in a task.
    """
    from statistics import NormalDist

    tried = smoothing or SMOOTHING
    z = [NormalDist().inv_cdf(q) for q in interval] if interval else [0.0, 0.0]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        out, chosen = [], None
        for fold, a, b, refit in folds or [(0, 0, int(frame["pos"].max()) + 1, 1)]:
            part = frame[(frame["pos"] >= a) & (frame["pos"] < b)]["y"].interpolate(limit_direction="both").to_numpy(float)
            if not len(part) or np.isnan(part).any():
                continue
            m = season if len(part) >= 2 * season else 1
            if refit or chosen is None:
                chosen = min(tried, key=lambda g: holt_winters(part, m, 1, *g)[1])
            pred, error = holt_winters(part, m, steps, *chosen)
            width = np.sqrt(error) * holt_winters_widths(steps, m, *chosen)
            out.append(pd.DataFrame({"series_id": frame["series_id"].iloc[0], "fold": fold, "step": range(1, steps + 1), "pred": pred, "lower_bound": pred + z[0] * width, "upper_bound": pred + z[1] * width}))
        return pd.concat(out) if out else pd.DataFrame(columns=["series_id", "fold", "step", "pred", "lower_bound", "upper_bound"])

    made = grid.select("series_id", "pos", "y").groupBy("series_id").applyInPandas(run, "series_id string, fold long, step int, pred double, lower_bound double, upper_bound double")
    return made if interval else made.drop("lower_bound", "upper_bound")
