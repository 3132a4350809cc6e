"""The forecasting interface: profile, plan, refine_plan, forecast, create_cv, backtest, compare.

Everything large stays in DataFrames; what comes to the driver is one row for the whole table, or a row for
each fold, lag or category.
"""

from __future__ import annotations

import traceback
import warnings
from dataclasses import dataclass, replace
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesloom.functions import scaling
from seriesloom.functions.frequency import Freq, seasonal_periods
from seriesloom.operators import autocorrelation, evaluation, features, profile as prof
from seriesloom.operators.features import window_size
from seriesloom.plans import arima, models, rules
from seriesloom.plans.records import AllCandidatesFailedError, CandidateFailure, CVParams, DataProfile, ForecastPlan
from seriesloom.sources.series import asfreq, canonical, dedupe_keep_first, forward_fill, interpolate
from seriesloom.sources.tables import detect_date

#: Most values of a categorical column, and most series side by side in a multivariate model.
MOST_CATEGORIES = 1000
MOST_COLUMNS = 200
CANDIDATE_KEYS = ("strategy", "estimator", "lags", "windows", "params", "alpha", "differentiation", "scale", "calendar", "encode_series")
REFINABLE = ("strategy", "estimator", "steps", "lags", "windows", "interval", "interval_method", "metric", "alpha", "params", "differentiation", "scale", "calendar", "encode_series", "residual_bins", "transform")


@dataclass
class Result:
    """Predictions and metrics as DataFrames, with the profile and plan that made them."""

    profile: DataProfile
    plan: ForecastPlan
    predictions: DataFrame
    metrics: DataFrame | None = None
    cv: CVParams | None = None

    def explain(self) -> str:
        lines = [self.plan.explanation, *(f"warning: {w}" for w in self.plan.warnings)]
        if self.cv:
            how = "each fold" if self.cv.refit is True else "the first fold only" if not self.cv.refit else f"every {self.cv.refit} folds"
            lines.append(f"backtest: {self.cv.initial} rows train first, folds of {self.cv.steps} steps, fitted for {how}.")
        return "\n".join(lines)


@dataclass
class Comparison:
    leaderboard: DataFrame
    results: dict[str, Result]
    failures: list[CandidateFailure]
    metric: str
    best_name: str

    def explain(self) -> str:
        return "\n".join([f"{self.best_name} is best of {len(self.results) + len(self.failures)} by {self.metric}.", *(f"{f.name} failed: {f.summary()}" for f in self.failures)])


class Assistant:
    """Decides by rules and runs plans on a table with the given roles."""

    def __init__(
        self,
        data: DataFrame,
        ts: str | None,
        target: str | list[str],
        series_id: str | None = None,
        exog: list[str] | None = None,
        freq: str | None = None,
        fill: str | None = None,
        order: str | None = None,
        weight: Column | None = None,
    ):
        """Roles of the columns. Without ``ts`` the first column of dates is taken; without ``exog`` all columns that have no role.

        ``fill`` says how the grid's missing values are met: interpolate, forward, zero, or None to leave
        rows out. ``order`` is the column that says which of repeated timestamps comes first; without it
        the row of the least values does. ``weight`` is a weight of each row in the fits.
        """
        if fill not in (None, "interpolate", "forward", "zero"):
            raise ValueError(f"unknown fill {fill!r}")
        if ts is None:
            data = detect_date(data)
            dates = [f.name for f in data.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
            if not dates:
                raise ValueError("no column of dates was found; name one")
            ts = dates[0]
        targets = [target] if isinstance(target, str) else target
        missing = [c for c in [ts, series_id, order, *targets, *(exog or [])] if c and c not in data.columns]
        if missing:
            raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(data.columns)}")
        usable = (T.NumericType, T.StringType, T.BooleanType)
        if exog is None:
            exog = [f.name for f in data.schema if f.name not in (ts, series_id, order, *targets) and isinstance(f.dataType, usable)]
        self.data, self.target, self.ts, self.series_id = data, target, ts, series_id
        self.format = "wide" if isinstance(target, list) else "long" if series_id else "single"
        self.exog, self.order, self.weight = exog, order, weight
        carried = [*exog, *([order] if order else [])]
        self.series = canonical(data, ts, target, series_id, carried)
        self.categorical = [f.name for f in self.series.schema if f.name in exog and isinstance(f.dataType, (T.StringType, T.BooleanType))]
        self.freq, self.fill = freq, fill
        self._profile: DataProfile | None = None
        self._grid: DataFrame | None = None
        self._categories: dict[str, list[str]] = {}

    # Profile

    def series_profile(self, freq: str | None = None) -> DataFrame:
        """A row for each series: range, counts, statistics, and with a frequency the length of its grid."""
        by_time = self.series.groupBy("series_id", "ts").agg(F.count(F.lit(1)).alias("n"), F.count("y").alias("v"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
        per = by_time.groupBy("series_id").agg(
            F.min("ts").alias("start"), F.max("ts").alias("end"), F.sum("n").alias("length"), F.count(F.lit(1)).alias("timestamps"), F.sum("v").alias("values"),
            F.min("lo").alias("min"), F.max("hi").alias("max"), F.try_divide(F.sum("s"), F.sum("v")).alias("mean"), F.sum("q").alias("_q"),
        )
        std = F.sqrt(F.greatest(F.col("_q") - F.col("values") * F.col("mean") ** 2, F.lit(0.0)) / (F.col("values") - 1))
        per = per.withColumn("std", F.when(F.col("values") > 1, std).when(F.col("values") == 1, 0.0)).withColumn("missing", F.col("length") - F.col("values"))
        size = F.size(Freq.parse(freq).grid(F.col("start"), F.col("end"))).cast("long") if freq else F.lit(None).cast("long")
        return per.withColumn("grid_length", size).drop("_q")

    def profile(self) -> DataProfile:
        """Ranges, frequency and quality: one row from one aggregate by series, and one by distance."""
        if self._profile:
            return self._profile
        freq = self.freq or prof.infer_frequency(self.series)
        near = F.col("min").isNull() | (F.least(F.abs("min"), F.abs("max")) <= 0.01) | ((F.col("min") <= 0) & (F.col("max") >= 0))
        r = self.series_profile(freq).agg(
            F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("start").alias("latest"), F.sum("length").alias("rows"), F.min("length").alias("shortest"), F.max("length").alias("longest"),
            F.sum("missing").alias("missing"), F.max(F.col("timestamps") < F.col("length")).alias("duplicates"), F.max(F.coalesce(F.col("grid_length") > F.col("timestamps"), F.lit(False))).alias("gaps"),
            F.max(near).alias("near"), F.min(F.col("min").isNull() | (F.col("min") == F.col("max"))).alias("constant"),
        ).first()
        if not r["n"]:
            raise ValueError("the table has no rows with a series and a timestamp")
        if r["constant"]:
            raise ValueError("the target is constant or empty")
        span = prof.span_length(self.series, freq).first()[0] if freq else r["longest"]
        notes = rules.warnings_of(r["shortest"], freq, r["missing"], r["n"])
        self._profile = DataProfile(
            self.format, r["n"], self.target, freq, span, r["rows"], r["gaps"], r["duplicates"], r["shortest"], r["longest"], r["missing"], r["start"], r["end"], r["latest"], r["near"], self.freq is not None, self.exog, self.categorical, notes
        )
        return self._profile

    def grid(self) -> DataFrame:
        """The series on their regular grid: one row a timestamp, missing values filled as asked, categories as text.

        Positions count from the panel's first timestamp, so that a fold is one stretch of time for all series.
        """
        if self._grid is None:
            p = self.profile()
            if not p.frequency:
                raise ValueError("no frequency was found; give one")
            first = F.col(self.order) if self.order else F.struct("y", *[F.col(c).cast("string") for c in self.exog])
            rows = dedupe_keep_first(self.series, first) if p.has_duplicates else self.series
            grid = asfreq(rows.drop(self.order) if self.order else rows, p.frequency, origin=p.start)
            if self.fill == "zero":
                grid = grid.withColumn("y", F.coalesce("y", F.lit(0.0)))
            elif self.fill:
                filled = interpolate(grid) if self.fill == "interpolate" else forward_fill(grid)
                grid = filled.withColumn("y", F.col("filled")).drop("filled")
            if self.fill and self.exog:
                w = Window.partitionBy("series_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
                grid = grid.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in self.exog})
            if self.weight is not None:
                grid = grid.withColumn("_weight", self.weight)
            self._grid = grid
        return self._grid

    # Exogenous columns

    def categories(self, column: str) -> list[str]:
        """The values of a categorical column in order."""
        if column not in self._categories:
            found = [r[0] for r in self.series.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().limit(MOST_CATEGORIES + 1).collect()]
            if len(found) > MOST_CATEGORIES:
                raise ValueError(f"{column} has more than {MOST_CATEGORIES} values; encode it before")
            self._categories[column] = sorted(found)
        return self._categories[column]

    def _encoded(self, df: DataFrame, plan: ForecastPlan) -> tuple[DataFrame, list[str]]:
        """``df`` with the plan's exogenous columns as numbers, and their names.

        Categories become a column each for linear models and their place in order for others; a value
        that training never had is 0 in all, or -1.
        """
        out: dict[str, Column] = {}
        for c in plan.exog:
            if c not in plan.categorical_exog:
                out[c] = F.col(f"`{c}`").cast("double")
            elif plan.estimator == "ridge":
                text = F.col(f"`{c}`").cast("string")
                out |= {f"{c}_{i}": (text == v).cast("double") for i, v in enumerate(self.categories(c))}
            else:
                values = F.array(*map(F.lit, self.categories(c)))
                out[f"{c}_code"] = (F.array_position(values, F.col(f"`{c}`").cast("string")) - 1).cast("double")
        names = list(out)
        df = df.withColumns(out) if out else df
        if plan.encode_series:
            df = df.join(features.series_encoding(self.series), "series_id", "left")
            names.append("series_code")
        return df, names

    def _prepared(self, plan: ForecastPlan) -> tuple[DataFrame, models.Design]:
        """The grid with encoded columns, and the design of the plan over it."""
        grid, names = self._encoded(self.grid(), plan)
        return grid, models.Design(plan.lags, plan.windows, plan.calendar, plan.calendar_encoding, names, plan.differentiation)

    def _ahead(self, exog: DataFrame | None, plan: ForecastPlan, train: DataFrame) -> DataFrame | None:
        """Known columns of the rows ahead, encoded; where only the series' code is known, for the steps of each series."""
        if exog is not None:
            at = self.ts if self.ts in exog.columns else next((f.name for f in detect_date(exog).schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))), None)
            if at is None:
                raise ValueError("the future rows need a column of dates")
            absent = [c for c in plan.exog if c not in exog.columns]
            if absent:
                raise ValueError(f"the future rows lack {', '.join(absent)}")
            by = [F.col(self.series_id).cast("string").alias("series_id")] if self.series_id and self.series_id in exog.columns else []
            rows = detect_date(exog).select(*by, F.col(at).cast("timestamp_ntz").alias("ts"), *plan.exog)
            if not by and plan.encode_series:
                rows = rows.crossJoin(train.select("series_id").distinct())  # a row a series and step, as the result has
            return self._encoded(rows, plan)[0]
        if plan.encode_series:
            rows = models.extended(train.select("series_id", "ts", "pos", "y"), plan.steps, plan.frequency).where("y is null").select("series_id", "ts")
            return self._encoded(rows, plan)[0].select("series_id", "ts", "series_code").dropDuplicates(["series_id", "ts"])
        return None

    # Plan

    def plan(
        self,
        steps: int,
        strategy: str | None = None,
        estimator: str | None = None,
        lags: int | list[int] | None = None,
        windows: list[tuple[str, int]] | None = None,
        interval: tuple[float, float] | None = None,
        metric: str | None = None,
        alpha: float = 1.0,
        interval_method: str | None = None,
        params: dict | None = None,
        differentiation: int = 0,
        scale: bool | None = None,
        calendar: list[str] | None = None,
        encode_series: bool | None = None,
        residual_bins: int = 0,
        transform: str | None = None,
    ) -> ForecastPlan:
        """Explicit choices win; the rest follows the rules."""
        if steps < 1:
            raise ValueError("steps is at least 1")
        if transform and transform not in scaling.METHODS:
            raise ValueError(f"a transform is one of {', '.join(scaling.METHODS)}")
        if interval and not 0 < interval[0] < interval[1] < 1:
            raise ValueError("an interval is two rising quantiles between 0 and 1")
        if metric and metric not in evaluation.known_metrics():
            raise ValueError(f"unknown metric {metric!r}; known: {', '.join(evaluation.known_metrics())}")
        p, notes = self.profile(), []
        suited = rules.select_strategy(p)
        strategy = strategy or suited[0]
        rules.check_shape(p, strategy)
        if strategy not in suited:
            notes.append(f"{strategy} is not among the recommended: {', '.join(suited)}")
        estimator = estimator or rules.select_estimator(p, strategy)
        if estimator not in (None, "ridge", "seasonal_naive", "holt_winters", "arima"):
            models.make_estimator(estimator, **(params or {}))
        if strategy == "recursive" and estimator not in ("ridge", "seasonal_naive", *models.WALKED):
            notes.append("recursive forecasts are linear or by trees here; other estimators run as direct forecasts")
            strategy = "direct"
        if strategy == "multivariate" and estimator != "ridge":
            notes.append("multivariate forecasts are linear here")
            estimator = "ridge"
        learns = strategy not in ("statistical", "foundation") and estimator != "seasonal_naive"
        featured = learns and strategy != "multivariate"
        recursive = featured and estimator in ("ridge", *models.WALKED) and strategy in ("recursive", "multi_series")
        if differentiation and not recursive:
            raise ValueError("only recursive forecasts are differenced")
        exog = self.exog if featured else []
        if self.exog and not featured:
            notes.append("exogenous columns are not used by this strategy: " + ", ".join(self.exog))
        seasons = seasonal_periods(Freq.parse(p.frequency)) if p.frequency else []
        season = seasons[0] if seasons else None
        n = p.shortest
        reserved = 0 if recursive else steps - 1
        for stat, size in windows or []:
            if stat not in features.statistics() or isinstance(size, bool) or not isinstance(size, int) or size < 1:
                raise ValueError(f"a window is one of {', '.join(features.statistics())} and a positive size")
        if lags is not None:
            lags = list(range(1, lags + 1)) if isinstance(lags, int) else sorted(set(lags))
            if learns and (not lags or lags[0] < 1):
                raise ValueError("lags are positive")
        if lags or windows:
            rules.check_budget(window_size(lags, windows), p.span)
        if not learns:
            lags, windows = [], []
        if lags is None:
            lags = rules.finalize_lags(self._found_lags(season, strategy), n, season, reserved)
        if windows is None:
            windows = rules.select_windows(n, seasons, strategy, rules.feature_budget(n, reserved)) if featured else []
        if calendar is None:
            calendar = rules.select_calendar(p.frequency, n, strategy) if featured else []
        chosen, metrics = rules.select_metric(p, strategy)
        method = (interval_method or ("bootstrap" if recursive and estimator == "ridge" else "native" if strategy == "statistical" else "conformal")) if interval else None
        allowed = ("bootstrap", "conformal") if recursive else ("native",) if strategy == "statistical" else ("conformal",)
        if method and method not in allowed:
            raise ValueError(f"intervals of this plan are {' or '.join(allowed)}")
        plan = ForecastPlan(
            strategy, estimator, lags, windows, calendar, rules.calendar_encoding(estimator, strategy), metric or chosen, sorted({*metrics, metric or chosen}),
            (estimator == "ridge" and featured) if scale is None else scale, rules.drops_null(p, estimator, strategy) or estimator == "ridge", season, steps, p.frequency, interval, None, alpha, rules.preprocessing(p), [*p.warnings, *notes],
            "", exog, [c for c in self.categorical if c in exog], differentiation, (featured and strategy == "multi_series") if encode_series is None else encode_series, method, params or {}, residual_bins, transform,
        )
        return replace(plan, explanation=self._explain(p, plan))

    def refine_plan(self, plan: ForecastPlan, **given) -> ForecastPlan:
        """A plan with some choices replaced; what follows from a replaced strategy or estimator is decided anew."""
        unknown = sorted(set(given) - set(REFINABLE))
        if unknown:
            raise ValueError(f"a plan cannot be refined by {', '.join(unknown)}; only by {', '.join(REFINABLE)}")
        kept = {k: getattr(plan, k) for k in ("steps", "interval", "interval_method", "metric", "alpha", "params", "differentiation", "residual_bins", "transform")}
        same_strategy = given.get("strategy", plan.strategy) == plan.strategy
        if same_strategy:
            kept |= {"strategy": plan.strategy, "estimator": plan.estimator, "lags": plan.lags or None, "windows": plan.windows if plan.lags else None, "scale": plan.scale, "calendar": plan.calendar, "encode_series": plan.encode_series}
        else:
            kept["interval_method"] = None
            kept["differentiation"] = 0
        if "estimator" in given and given["estimator"] != plan.estimator:
            kept |= {"interval_method": None, "params": {}, "scale": None}
        if "interval" in given and not given["interval"]:
            kept["interval_method"] = None
        return replace(self.plan(**{**kept, **given}), end_train=plan.end_train)

    def _found_lags(self, season: int | None, strategy: str) -> list[int]:
        p = self.profile()
        if p.shortest < 30:
            return []
        horizon = max(min(min(3 * season, 512) if season else 50, p.shortest // 2 - 1), 1)
        found = autocorrelation.significant_lags(self.grid(), horizon)
        if strategy == "multi_series":
            return [r["lag"] for r in autocorrelation.lag_consensus(found, p.n_series).collect()]
        if strategy == "multivariate":
            return [r["lag"] for r in autocorrelation.top_lags(found, 10).orderBy(F.desc("strength"), "lag").collect()]
        return [r["lag"] for r in found.orderBy(F.abs("pacf").desc(), "lag").collect()]

    @staticmethod
    def _explain(p: DataProfile, plan: ForecastPlan) -> str:
        what = f"{p.n_series} series" if p.n_series > 1 else "one series"
        reach = window_size(plan.lags, plan.windows, plan.differentiation)
        return (
            f"{what} of {p.n_observations} rows at frequency {p.frequency}: {plan.strategy} forecasting"
            + (f" with {plan.estimator}" if plan.estimator else "")
            + (f", {len(plan.lags)} lags and {len(plan.windows)} rolling statistics reaching back {reach} rows" if plan.lags else "")
            + (f", {len(plan.calendar)} calendar features" if plan.calendar else "")
            + (f", exogenous {', '.join(plan.exog)}" if plan.exog else "")
            + (f", differenced {plan.differentiation} times" if plan.differentiation else "")
            + (f", {plan.interval_method} intervals" if plan.interval else "")
            + f", judged by {plan.metric}."
        )

    # Forecast

    def forecast(self, plan: ForecastPlan | None = None, steps: int | None = None, test_size: int | float | None = None, end_train: datetime | None = None, exog: DataFrame | None = None, residuals: DataFrame | None = None) -> Result:
        """Predict ``steps`` beyond the data, or with a test size or date beyond the training rows and score them.

        A plan that uses exogenous columns needs their rows ahead in ``exog`` (by the columns of time and
        series of the data), at least ``steps`` of them; when scoring, they are the test rows' own. Intervals of
        recursive plans are drawn from the training rows' residuals, or from ``residuals`` that ``fold_residuals``
        took from a backtest.
        """
        if plan is None:
            if steps is None:
                raise ValueError("give a plan or steps")
            plan = self.plan(steps)
        elif steps is not None and steps != plan.steps:
            warnings.warn("steps is ignored beside a plan", stacklevel=2)
        scoring = test_size is not None or end_train is not None
        if scoring and exog is not None:
            raise ValueError("when scoring, exogenous rows are the test rows' own")
        if not scoring and plan.exog:
            if exog is None:
                raise ValueError(f"the plan uses {', '.join(plan.exog)}: give their rows ahead")
            if exog.limit(plan.steps).count() < plan.steps:
                raise ValueError(f"the plan needs {plan.steps} rows ahead")
        if exog is not None and not plan.exog:
            raise ValueError("the plan uses no exogenous columns")
        (grid, design), p = self._prepared(plan), self.profile()
        train, test = grid, None
        if test_size is not None:
            cut = p.span - rules.resolve_test_rows(test_size, p.span)  # one moment for all series
            train, test = grid.where(F.col("pos") < cut), grid.where(F.col("pos") >= cut)
        elif end_train is not None:
            rules.check_end_train(end_train, p.start, p.end)
            at = F.lit(end_train).cast("timestamp_ntz")
            train, test = grid.where(F.col("ts") <= at), grid.where(F.col("ts") > at)
            plan = replace(plan, end_train=end_train)
        ahead = test.select("series_id", "ts", *design.exog) if test is not None and design.exog else self._ahead(exog, plan, train)
        if residuals is not None and plan.transform:
            raise ValueError("residuals of folds are of the values, those of a transformed plan of their powers")
        if residuals is not None and not (plan.interval and plan.interval_method == "bootstrap"):
            raise ValueError("residuals are drawn by bootstrap intervals only")
        preds = self._predict(train, plan, design, ahead, residuals)
        metrics = None
        if test is not None:
            met = preds.join(test.select("series_id", "ts", "y"), ["series_id", "ts"]).where("y is not null and pred is not null")
            metrics = evaluation.evaluate(met, plan.metrics, evaluation.naive_scale(train), train=train)
        return Result(p, plan, preds, metrics)

    def _scaled(self, plan: ForecastPlan, train: DataFrame, *frames: DataFrame) -> tuple[DataFrame | None, list[DataFrame]]:
        """Each series' training power, mean and deviation, and the frames with values so transformed; None where the plan does neither."""
        if not plan.scale and not plan.transform:
            return None, list(frames)
        raised = lambda f: f
        if plan.transform:
            powers = scaling.fit_power(train, plan.transform).withColumnRenamed("exponent", "_power")
            raised = lambda f: f.join(powers, "series_id").withColumn("y", scaling.power(F.col("y"), F.col("_power"), plan.transform)).drop("_power")
        std = F.stddev_pop("y")
        mean = F.avg("y") if plan.scale else F.lit(0.0)
        fitted = raised(train).groupBy("series_id").agg((mean if plan.scale else F.max(mean)).alias("_mean"), (F.when(std > 0, std).otherwise(1.0) if plan.scale else F.max(F.lit(1.0))).alias("_std"))
        out = [raised(f).join(fitted, "series_id").withColumn("y", (F.col("y") - F.col("_mean")) / F.col("_std")).drop("_mean", "_std") for f in frames]
        return (fitted.join(powers, "series_id") if plan.transform else fitted), out

    @staticmethod
    def _unscaled(preds: DataFrame, fitted: DataFrame | None, transform: str | None = None) -> DataFrame:
        if fitted is None:
            return preds
        undone = lambda z: scaling.inverse_power(z, F.col("_power"), transform) if transform else z
        back = {c: undone(F.col(c) * F.col("_std") + F.col("_mean")) for c in ("y", "pred", "lower_bound", "upper_bound") if c in preds.columns}
        return preds.join(fitted, "series_id").withColumns(back).drop("_mean", "_std", "_power")

    def _series_names(self) -> list[str]:
        names = [r[0] for r in self.series.select("series_id").distinct().limit(MOST_COLUMNS + 1).collect()]
        if len(names) > MOST_COLUMNS:
            raise ValueError(f"multivariate takes at most {MOST_COLUMNS} series side by side")
        return sorted(names)

    def _weight(self) -> str | None:
        return "_weight" if self.weight is not None else None

    def _predict(self, train: DataFrame, plan: ForecastPlan, design: models.Design, ahead: DataFrame | None, residuals: DataFrame | None = None) -> DataFrame:
        season = plan.season or 1
        if plan.estimator == "seasonal_naive":
            return self._naive_bounds(self._dated(evaluation.seasonal_naive(train, plan.steps, season), train, plan), train, plan)
        if plan.estimator == "arima":
            return arima.arima_forecast(train, plan.steps, plan.frequency, interval=plan.interval, **self._arima(plan))
        if plan.strategy == "statistical":
            return self._dated(models.statistical_forecast(train, plan.steps, season, None, plan.interval, plan.params.get("smoothing")).drop("fold"), train, plan)
        if plan.strategy == "multivariate":
            names = self._series_names()
            return self._dated(models.multivariate_forecast(train, names, names, plan.lags, plan.steps, plan.alpha, plan.frequency, plan.interval), train, plan)
        if plan.strategy == "foundation":
            raise NotImplementedError("foundation models have no runner here")
        fitted, (scaled,) = self._scaled(plan, train, train)
        if plan.estimator == "ridge" and plan.strategy in ("recursive", "multi_series"):
            keys = ["series_id"] if plan.strategy == "recursive" else []
            matrix, names, target = models.design_matrix(scaled, design)
            betas = models.fit_ridge(matrix, names, keys, plan.alpha, target, self._weight())
            resid = None
            if plan.interval and residuals is None:
                resid = models.residuals_by_level(matrix, betas, names, ["series_id"], target, plan.residual_bins) if plan.residual_bins else models.residual_quantiles(matrix, betas, names, ["series_id"], target)
            resid = self._scaled_residuals(residuals, fitted) if residuals is not None else resid
            boot = plan.interval if plan.interval_method == "bootstrap" else None
            tails = models.tails_at_end(scaled, design.reach)
            preds = models.recursive_forecast(tails, betas, plan.lags, plan.windows, plan.steps, plan.frequency, plan.calendar, plan.calendar_encoding, boot, residuals=resid, exog=ahead, exog_names=design.exog, differentiation=design.differentiation)
            preds = self._conformal(preds, resid, plan)
            return self._unscaled(preds, fitted, plan.transform)
        if plan.estimator in models.WALKED and plan.strategy in ("recursive", "multi_series"):
            matrix, names, target = models.design_matrix(scaled, design)
            trees = models.fit_trees(matrix, names, None, plan.estimator, plan.params, target, self._weight(), plan.drop_null)
            resid = models.tree_residuals(matrix, trees, names, ["series_id"], target, bins=plan.residual_bins) if plan.interval and residuals is None else None
            resid = self._scaled_residuals(residuals, fitted) if residuals is not None else resid
            tails = models.tails_at_end(scaled, design.reach)
            boot = plan.interval if plan.interval_method == "bootstrap" else None
            preds = models.recursive_forecast(tails, trees, plan.lags, plan.windows, plan.steps, plan.frequency, plan.calendar, plan.calendar_encoding, boot, residuals=resid, exog=ahead, exog_names=design.exog, differentiation=design.differentiation)
            return self._unscaled(self._conformal(preds, resid, plan), fitted, plan.transform)
        out = models.forecast_direct(scaled, design, plan.steps, plan.frequency, ahead, plan.strategy == "direct", self._weight(), estimator=plan.estimator, alpha=plan.alpha, params=plan.params, drop_null=plan.drop_null, interval=plan.interval)
        return self._unscaled(out.withColumn("step", F.col("step").cast("int")), fitted, plan.transform)

    @staticmethod
    def _scaled_residuals(residuals: DataFrame, fitted: DataFrame | None) -> DataFrame:
        """Residuals and levels in the units of scaled series."""
        if fitted is None:
            return residuals
        shrunk = lambda c: F.transform(c, lambda e: e / F.col("_std"))
        out = {"resid": shrunk("resid"), "edges": F.transform("edges", lambda e: (e - F.col("_mean")) / F.col("_std")), "by_level": F.transform("by_level", shrunk)}
        return residuals.join(fitted, "series_id").withColumns(out).drop("_mean", "_std")

    def fold_residuals(self, plan: ForecastPlan, cv: CVParams | None = None, bins: int | None = None) -> DataFrame:
        """What a backtest of the plan misses on rows its models had not seen, by series and level: ``residuals`` of a forecast."""
        if plan.differentiation:
            raise ValueError("residuals of folds are of the values, those of a differenced plan of their differences")
        preds = self.backtest(replace(plan, interval=None, interval_method=None), cv).predictions
        return models.fold_residuals(preds.where("y is not null and pred is not null"), bins or plan.residual_bins or 1)

    @staticmethod
    def _arima(plan: ForecastPlan) -> dict:
        """The plan's choices; a short season adds its lags to the orders tried."""
        season = plan.season if plan.season and 1 < plan.season <= rules.MAX_STATISTICAL_SEASON else 0
        return {"season": season, **plan.params}

    @staticmethod
    def _conformal(preds: DataFrame, resid: DataFrame | None, plan: ForecastPlan) -> DataFrame:
        """Bounds by each series' residual quantiles, where the plan's are not those of paths."""
        if not plan.interval or plan.interval_method == "bootstrap":
            return preds
        at = [F.element_at("resid", int(round(q * (models.RESIDUAL_POINTS - 1))) + 1) for q in plan.interval]
        return preds.join(resid, "series_id").withColumns({"lower_bound": F.col("pred") + at[0], "upper_bound": F.col("pred") + at[1]}).drop("resid")

    @staticmethod
    def _dated(out: DataFrame, train: DataFrame, plan: ForecastPlan) -> DataFrame:
        last = train.groupBy("series_id").agg(F.max("ts").alias("_last"))
        return out.join(last, "series_id").withColumn("ts", Freq.parse(plan.frequency).shift(F.col("_last"), F.col("step").cast("int"))).drop("_last")

    @staticmethod
    def _naive_bounds(preds: DataFrame, train: DataFrame, plan: ForecastPlan) -> DataFrame:
        """Bounds by the quantiles of what the seasonal naive forecast misses on the training rows."""
        if not plan.interval:
            return preds
        e = F.col("y") - F.lag("y", plan.season or 1).over(Window.partitionBy("series_id").orderBy("pos"))
        seen = train.withColumn("_e", e).where("_e is not null")
        ends = lambda suffix: [F.percentile("_e", q).alias(n + suffix) for q, n in zip(plan.interval, ("_lo", "_hi"), strict=True)]
        by, pooled = seen.groupBy("series_id").agg(*ends("")), seen.agg(*ends("_all"))  # pooled is one row, for series without a season to compare
        met = preds.join(by, "series_id", "left").crossJoin(F.broadcast(pooled))
        return met.withColumns({c: F.col("pred") + F.coalesce(q, f"{q}_all") for c, q in (("lower_bound", "_lo"), ("upper_bound", "_hi"))}).drop("_lo", "_hi", "_lo_all", "_hi_all")

    # Backtest

    def create_cv(self, plan: ForecastPlan, **given) -> CVParams:
        """Walk-forward parameters; given values win over the defaults.

        ``initial`` is a count of rows of the panel's span, a share of it, or the last timestamp that trains first.
        """
        p = self.profile()
        cv = rules.cv_defaults(p.span, window_size(plan.lags, plan.windows, plan.differentiation), plan.steps)
        initial = given.pop("initial", None)
        if initial is not None:
            cv = replace(cv, initial=self._rows_until(initial) if isinstance(initial, date) else rules.resolve_test_rows(initial, p.span))
        cv = replace(cv, **given)
        if cv.steps != plan.steps:
            raise ValueError("the folds' steps are the plan's steps")
        rules.count_folds(p.span, cv)
        return cv

    def _rows_until(self, end: date) -> int:
        """Positions of the panel's grid up to and with a date or timestamp."""
        p = self.profile()
        end = end if isinstance(end, datetime) else datetime(end.year, end.month, end.day)
        rules.check_end_train(end, p.start, p.end)
        grid = Freq.parse(p.frequency).grid(F.lit(p.start), F.lit(end))
        return self.data.sparkSession.range(1).select(F.size(grid)).first()[0]

    def folds(self, cv: CVParams) -> DataFrame:
        return evaluation.cv_folds(self.data.sparkSession, self.profile().span, cv.initial, cv.steps, cv.stride, cv.gap, cv.fixed_train, cv.refit, cv.allow_incomplete, cv.skip)

    def backtest(self, plan: ForecastPlan, cv: CVParams | None = None) -> Result:
        """Predictions and metrics of every fold, by the model of the last fold that fitted.

        Folds are stretches of the panel's span, so that no model has seen a row after its cut, whichever series
        the row is of. A series that starts late is predicted from the first fold on before which it has the
        rows that the features reach back; a warning says how many never have them. Values are scaled, where
        the plan scales, by each series' first training range; bounds come from the residuals of the first fit.
        """
        cv = cv or self.create_cv(plan)
        folds, (grid, design) = self.folds(cv), self._prepared(plan)
        train = self._first_training(grid, folds, plan, cv)
        season = plan.season or 1
        if plan.estimator == "seasonal_naive":
            spans = folds.select("fold", "train_to", F.explode(F.sequence("test_from", F.col("test_to") - 1)).alias("pos"))
            back = F.ceil((F.col("pos") - F.col("train_to") + 1) / season) * season
            asked = spans.withColumn("source", F.col("pos") - back)
            source = grid.select("series_id", F.col("pos").alias("source"), F.col("y").alias("pred"))
            preds = asked.join(source, "source").join(grid.select("series_id", "pos", "ts", "y"), ["series_id", "pos"]).select("series_id", "fold", (F.col("pos") - F.col("train_to") + 1 - cv.gap).cast("int").alias("step"), "ts", "y", "pred")
            preds = self._naive_bounds(preds, train, plan)
        elif plan.estimator == "arima":
            made = arima.arima_forecast(grid, cv.steps + cv.gap, plan.frequency, interval=plan.interval, folds=folds, **self._arima(plan))
            preds = models.scored(made, grid, folds, cv.gap)
        elif plan.strategy == "statistical":
            spans = [(r["fold"], r["train_from"], r["train_to"], int(r["refit"])) for r in folds.orderBy("fold").collect()]
            made = models.statistical_forecast(grid, cv.steps + cv.gap, season, spans, plan.interval, plan.params.get("smoothing"))
            starts = grid.select("series_id", "pos", F.col("ts").alias("_first")).join(F.broadcast(folds.select("fold", F.col("train_to").alias("pos"))), "pos").drop("pos")
            dated = made.join(starts, ["series_id", "fold"]).withColumn("ts", Freq.parse(plan.frequency).shift(F.col("_first"), F.col("step") - 1))
            preds = models.scored(dated, grid, folds, cv.gap)
        elif plan.strategy == "multivariate":
            preds = models.backtest_multivariate(grid, folds, self._series_names(), plan.lags, cv.steps, plan.frequency, cv.gap, alpha=plan.alpha, interval=plan.interval)
        elif plan.strategy == "foundation":
            raise NotImplementedError("foundation models have no runner here")
        else:
            fitted, (scaled,) = self._scaled(plan, train, grid)
            if plan.estimator == "ridge" and plan.strategy in ("recursive", "multi_series"):
                preds = models.backtest_ridge(scaled, folds, plan.lags, plan.windows, plan.frequency, plan.calendar, plan.calendar_encoding, plan.alpha, plan.strategy == "recursive", cv.steps, cv.gap, design.exog, design.differentiation, self._weight(), plan.interval, plan.residual_bins)
            elif plan.estimator in models.WALKED and plan.strategy in ("recursive", "multi_series"):
                preds = models.backtest_trees(scaled, folds, design, plan.frequency, plan.estimator, plan.params, cv.steps, cv.gap, self._weight(), plan.interval, plan.drop_null, plan.residual_bins)
            else:
                preds = models.backtest_direct(scaled, folds, design, cv.steps, cv.gap, plan.strategy == "direct", self._weight(), estimator=plan.estimator, alpha=plan.alpha, params=plan.params, drop_null=plan.drop_null, interval=plan.interval)
            preds = self._unscaled(preds, fitted, plan.transform)
        met = preds.where("y is not null and pred is not null")
        metrics = evaluation.evaluate(met, plan.metrics, evaluation.naive_scale(train), train=train)
        return Result(self.profile(), plan, preds, metrics, cv)

    def _first_training(self, grid: DataFrame, folds: DataFrame, plan: ForecastPlan, cv: CVParams) -> DataFrame:
        """Each series' rows of the first fold that can predict it."""
        p = self.profile()
        if p.shortest == p.longest and p.latest_start == p.start:
            return grid.where(F.col("pos") < cv.initial)
        reach = max(window_size(plan.lags, plan.windows, plan.differentiation), (plan.season or 1) if plan.estimator == "seasonal_naive" else 1)
        cuts = models.first_cuts(grid, folds, reach)
        known = grid.where("y is not null").groupBy("series_id").agg(F.min("pos").alias("_first"))
        short = cuts.join(known, "series_id").where(F.col("cut") < F.col("_first") + reach).count()
        if short:
            warnings.warn(f"{short} of {p.n_series} series never have the {reach} rows before a fold that a prediction needs", stacklevel=3)
        return models.first_rows(grid, cuts)

    def candidates(self) -> list[tuple[str, dict]]:
        """What suits the data: the recommended strategies with their estimators, and the seasonal naive forecast."""
        p = self.profile()
        found = [(f"{s}_{rules.select_estimator(p, s)}", {"strategy": s}) for s in rules.select_strategy(p) if s != "foundation"]
        return [*found, ("seasonal_naive", {"estimator": "seasonal_naive"})]

    def compare(self, candidates: list[tuple[str, dict]] | None, steps: int, metric: str | None = None, cv: CVParams | None = None) -> Comparison:
        """Backtest each candidate over the same folds and rank them; one that fails ranks last with its error.

        A candidate is a name and choices for ``plan``; without candidates those that suit the data. Each
        one's metrics are computed at once, so that a failure is its own.
        """
        candidates = self.candidates() if candidates is None else candidates
        if not candidates or any(not isinstance(c, (tuple, list)) or len(c) != 2 or not isinstance(c[0], str) or not isinstance(c[1], dict) for c in candidates):
            raise ValueError("candidates are pairs of a name and its choices")
        names = [n for n, _ in candidates]
        if len(set(names)) < len(names):
            raise ValueError("candidates need distinct names")
        unknown = sorted({k for _, c in candidates for k in c} - set(CANDIDATE_KEYS))
        if unknown:
            raise ValueError(f"candidates choose {', '.join(CANDIDATE_KEYS)}, not {', '.join(unknown)}")
        spark = self.data.sparkSession
        results: dict[str, Result] = {}
        failures: list[CandidateFailure] = []
        rows: list[tuple[str, float | None]] = []
        for name, choices in candidates:
            try:
                plan = self.plan(steps, metric=metric, **choices)
                metric = metric or plan.metric
                cv = cv or self.create_cv(plan)
                result = self.backtest(plan, cv)
                value = result.metrics.agg(F.avg(metric)).first()[0]
                results[name] = result
                rows.append((name, value))
            except Exception as e:  # a candidate's failure is a row of the result
                failures.append(CandidateFailure(name, type(e).__name__, str(e), traceback.format_exc()))
                warnings.warn(f"{name} failed: {failures[-1].summary()}", stacklevel=2)
                rows.append((name, None))
        if not results:
            raise AllCandidatesFailedError(failures)
        scores = spark.createDataFrame([(n, v, i) for i, (n, v) in enumerate(rows)], "candidate string, value double, place int")
        board = evaluation.leaderboard(scores, order="place").drop("place")
        best = min((x for x in rows if x[1] is not None), key=lambda x: x[1])[0]
        return Comparison(board, results, failures, metric, best)
