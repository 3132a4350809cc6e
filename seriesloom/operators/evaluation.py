"""Splits, folds, metrics, leaderboards and calibrated intervals."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def split_by_time(df: DataFrame, end_train: Column) -> DataFrame:
    """``is_train`` for timestamps up to and with ``end_train``."""
    return df.withColumn("is_train", F.col("ts") <= end_train)


def split_by_share(grid: DataFrame, test_rows: int) -> DataFrame:
    """The last ``test_rows`` positions of each series are its test rows."""
    last = F.max("pos").over(Window.partitionBy("series_id"))
    return grid.withColumn("is_train", F.col("pos") <= last - test_rows)


def cv_folds(
    spark: SparkSession,
    n: int,
    initial: int,
    steps: int,
    stride: int | None = None,
    gap: int = 0,
    fixed_train: bool = False,
    refit: bool | int = True,
    allow_incomplete: bool = True,
    skip: int | list[int] | None = None,
) -> DataFrame:
    """Walk-forward folds as half-open position ranges: ``fold, train_from, train_to, test_from, test_to, refit, model_from, model_to``.

    Fold i trains up to ``initial + i * stride`` and tests ``steps`` positions after the gap. The first
    fold always fits; a whole number refits every so many folds; ``model_from`` and ``model_to`` are the
    range that the fold's model was fitted on.
    """
    stride = stride or steps
    if min(n, initial, steps, stride) < 1 or gap < 0:
        raise ValueError("n, initial, steps and stride are at least 1, gap at least 0")
    i = F.col("id")
    start = i * stride + initial + gap
    folds = spark.range(max(0, -(-(n - initial - gap) // stride)), numPartitions=1).select(
        i.alias("fold"),
        (i * stride if fixed_train else F.lit(0).cast("long")).alias("train_from"),
        (i * stride + initial).alias("train_to"),
        start.alias("test_from"),
        F.least(start + steps, F.lit(n)).cast("long").alias("test_to"),
    )
    every = 1 if refit is True else int(refit)
    folds = folds.withColumn("refit", (F.col("fold") == 0) if not every else F.col("fold") % every == 0)
    # the training range of the last fold that fitted, whether that fold is skipped or not
    last = F.col("fold") - F.col("fold") % every if every else F.lit(0).cast("long")
    folds = folds.withColumns({"model_from": last * stride if fixed_train else F.lit(0).cast("long"), "model_to": last * stride + initial})
    if not allow_incomplete:
        folds = folds.where(F.col("test_to") - F.col("test_from") == steps)
    if isinstance(skip, int):
        folds = folds.where(F.col("fold") % skip == 0)
    elif skip:
        folds = folds.where(~F.col("fold").isin(skip))
    return folds


def fold_rows(grid: DataFrame, folds: DataFrame, part: str = "test") -> DataFrame:
    """Rows of each fold's ``test`` or ``train`` range.

    Test ranges are short, so each fold unfolds its positions. Training ranges overlap: positions are
    numbered by the stretch between fold bounds that they lie in, and each fold unfolds its stretches. Both
    joins are equi-joins.
    """
    if part == "test":
        spans = folds.select("fold", F.explode(F.sequence("test_from", F.col("test_to") - 1)).alias("pos"))
        return grid.join(spans, "pos")
    bounds = sorted({r[c] for r in folds.select("train_from", "train_to").collect() for c in ("train_from", "train_to")})
    edges = F.array(*[F.lit(int(b)) for b in bounds])
    place = lambda c: F.size(F.filter(edges, lambda e: e <= c)) - 1
    spans = folds.select("*", F.explode(F.sequence(place(F.col("train_from")), place(F.col("train_to")) - 1)).alias("_stretch"))
    return grid.withColumn("_stretch", place(F.col("pos"))).join(spans, "_stretch").drop("_stretch")


def naive_scale(train: DataFrame, lag: int = 1) -> DataFrame:
    """In-sample errors of the naive forecast for each series: ``naive_mae, naive_mse``."""
    w = Window.partitionBy("series_id").orderBy("ts")
    e = F.col("y") - F.lag("y", lag).over(w)
    return train.withColumn("_e", e).groupBy("series_id").agg(F.avg(F.abs("_e")).alias("naive_mae"), F.avg(F.col("_e") * F.col("_e")).alias("naive_mse"))


_CUSTOM: dict[str, Callable[[Column, Column], Column]] = {}
_ARRAYS: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {}
_TRAINED: dict[str, Callable[[np.ndarray, np.ndarray, np.ndarray], float]] = {}
BUILT_IN = ("mae", "mse", "rmse", "mape", "smape", "medae", "msle", "mase", "rmsse")


def register_metric(name: str, build: Callable[[Column, Column], Column] | None = None, array: Callable[[np.ndarray, np.ndarray], float] | None = None, trained: Callable[[np.ndarray, np.ndarray, np.ndarray], float] | None = None) -> None:
    """A metric of the caller's own, the lower the better: an aggregate of the columns of values and predictions.

    Where no aggregate says it, ``array`` takes the values and predictions of a group as arrays; it runs
    as a grouped pandas aggregate, so a group's rows must fit in a task. ``trained`` takes the series' training
    values in order as well; these must fit in a task too.
    """
    if name in BUILT_IN:
        raise ValueError(f"{name} is built in")
    if sum(f is not None for f in (build, array, trained)) != 1:
        raise ValueError("give an aggregate or a function of arrays")
    for known, function in ((_CUSTOM, build), (_ARRAYS, array), (_TRAINED, trained)):
        known.pop(name, None)
        if function:
            known[name] = function


def known_metrics() -> list[str]:
    return [*BUILT_IN, *_CUSTOM, *_ARRAYS, *_TRAINED]


def _array_column(function: Callable[[np.ndarray, np.ndarray], float]) -> Column:
    @F.pandas_udf("double")
    def value(a: pd.Series, b: pd.Series) -> float:
        return float(function(a.to_numpy(), b.to_numpy()))

    return value(F.col("y"), F.col("pred"))


def classification_metrics(preds: DataFrame, keys: tuple[str, ...] = ("series_id",), average: str = "macro") -> DataFrame:
    """``accuracy, balanced_accuracy, precision, recall, f1`` of class labels ``y`` and ``pred`` by ``keys``.

    Counts by class come from one aggregate over (true, predicted) pairs. Precision, recall and F1 are
    means over the classes, of equal weight (``macro``) or by their true rows (``weighted``); a ratio
    without rows is 0. Balanced accuracy is the mean recall of the classes with true rows.
    """
    if average not in ("macro", "weighted"):
        raise ValueError("average is macro or weighted")
    cells = preds.where("y is not null and pred is not null").groupBy(*keys, F.col("y").cast("string").alias("y"), F.col("pred").cast("string").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.inline(F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("true")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("true"))))
    both = cells.select(*keys, "n", (F.col("y") == F.col("pred")).alias("hit"), sides)
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    by = both.groupBy(*keys, "label").agg(of((F.col("true") == 1) & F.col("hit")).alias("hits"), of(F.col("true") == 1).alias("real"), of(F.col("true") == 0).alias("said"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    by = by.withColumns({"p": ratio(F.col("hits"), F.col("said")), "r": ratio(F.col("hits"), F.col("real"))}).withColumn("f", ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))
    mean = F.avg if average == "macro" else lambda c: F.sum(F.col(c) * F.col("real")) / F.sum("real")
    return by.groupBy(*keys).agg(
        (F.sum("hits") / F.sum("real")).alias("accuracy"), F.avg(F.when(F.col("real") > 0, F.col("r"))).alias("balanced_accuracy"), mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1")
    )


def metric(name: str, y: Column, pred: Column) -> Column:
    """A point metric as an aggregate. MAPE is a share; SMAPE is in percent up to 200; zero values are left out of MAPE."""
    e = y - pred
    log1 = F.log1p(F.greatest(y, F.lit(0.0))) - F.log1p(F.greatest(pred, F.lit(0.0)))
    build = {
        "mae": lambda: F.avg(F.abs(e)),
        "mse": lambda: F.avg(e * e),
        "rmse": lambda: F.sqrt(F.avg(e * e)),
        "mape": lambda: F.avg(F.try_divide(F.abs(e), F.abs(y))),
        "smape": lambda: 100 * F.avg(F.coalesce(F.try_divide(2 * F.abs(e), F.abs(y) + F.abs(pred)), F.lit(0.0))),
        "medae": lambda: F.percentile(F.abs(e), 0.5),
        "msle": lambda: F.avg(log1 * log1),
        **{n: (lambda b=b: b(y, pred)) for n, b in _CUSTOM.items()},
    }
    if name not in build:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(build)}, mase, rmsse")
    return build[name]()


def _with_training(preds: DataFrame, train: DataFrame, names: list[str]) -> DataFrame:
    """``series_id`` and the metrics that take training values: each series' predictions meet its training rows."""
    functions = {n: _TRAINED[n] for n in names}

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty:
            return pd.DataFrame(columns=["series_id", *functions])
        past = b.sort_values("ts")["y"].dropna().to_numpy(float)
        return pd.DataFrame([(key[0], *[float(f(a["y"].to_numpy(float), a["pred"].to_numpy(float), past)) for f in functions.values()])], columns=["series_id", *functions])

    schema = "series_id string" + "".join(f", `{n}` double" for n in functions)
    return preds.select("series_id", "y", "pred").groupBy("series_id").cogroup(train.select("series_id", "ts", "y").groupBy("series_id")).applyInPandas(run, schema)


def evaluate(preds: DataFrame, metrics: list[str], scale: DataFrame | None = None, keys: tuple[str, ...] = ("series_id",), train: DataFrame | None = None) -> DataFrame:
    """Metrics by ``keys`` over ``preds(…, y, pred)``; mase and rmsse need ``scale`` from ``naive_scale``, the caller's own that take training values need ``train``."""
    arrays = [m for m in metrics if m in _ARRAYS]
    trained = [m for m in metrics if m in _TRAINED]
    if trained and (train is None or keys != ("series_id",)):
        raise ValueError(f"{', '.join(trained)} need the training rows, and are by series")
    plain = [m for m in metrics if m not in ("mase", "rmsse", *arrays, *trained)]
    scaled = [m for m in metrics if m in ("mase", "rmsse")]
    base = {m: metric(m, F.col("y"), F.col("pred")) for m in dict.fromkeys([*plain, *(["mae"] if "mase" in scaled else []), *(["mse"] if "rmsse" in scaled else [])])}
    out = preds.groupBy(*keys).agg(*[c.alias(m) for m, c in (base or {"_n": F.count(F.lit(1))}).items()])
    if arrays:  # Spark does not mix pandas aggregates with its own
        out = out.join(preds.groupBy(*keys).agg(*[_array_column(_ARRAYS[m]).alias(m) for m in arrays]), list(keys))
    if trained:
        out = out.join(_with_training(preds, train, trained), "series_id")
    if scaled:
        if scale is None:
            raise ValueError("mase and rmsse need the training scale")
        out = out.join(scale, "series_id", "left")
        out = out.withColumns({m: F.try_divide(F.col("mae"), F.col("naive_mae")) if m == "mase" else F.sqrt(F.try_divide(F.col("mse"), F.col("naive_mse"))) for m in scaled})
    return out.select(*keys, *metrics)


def metrics_by_level(preds: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics of each series and pooled over all, from one aggregate over grouping sets; level null is pooled."""
    level = F.col("series_id")
    out = preds.groupingSets([[level], []], level).agg(*[metric(m, F.col("y"), F.col("pred")).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"))
    return out.withColumnRenamed("series_id", "level")


def aggregate_levels(by_level: DataFrame, metrics: list[str]) -> DataFrame:
    """Rows ``average`` and ``weighted_average`` (by predictions) over the series' rows."""
    per = by_level.where("level is not null")
    plain = per.agg(*[F.avg(m).alias(m) for m in metrics], F.sum("n").alias("n")).select(F.lit("average").alias("level"), *metrics, "n")
    weighted = per.agg(*[(F.sum(F.col(m) * F.col("n")) / F.sum("n")).alias(m) for m in metrics], F.sum("n").alias("n"))
    return plain.unionByName(weighted.select(F.lit("weighted_average").alias("level"), *metrics, "n"))


def leaderboard(scores: DataFrame, value: str = "value", order: str = "candidate") -> DataFrame:
    """``rank`` 1..n by ascending value, null and NaN last, ties by ``order``. A row for each candidate is sorted."""
    clean = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    w = Window.orderBy(clean.asc_nulls_last(), order)
    return scores.withColumn("rank", F.row_number().over(w).cast("long"))


def coverage(preds: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Share of values within ``lower_bound`` and ``upper_bound``."""
    inside = F.col("y").between(F.col("lower_bound"), F.col("upper_bound"))
    return preds.groupBy(*keys).agg(F.avg(inside.cast("double")).alias("coverage"))


def pinball(y: Column, pred: Column, q: float) -> Column:
    e = y - pred
    return F.avg(F.greatest(e * q, e * (q - 1)))


def crps_from_quantiles(preds: DataFrame, quantiles: list[float], keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Twice the mean pinball loss over quantile columns ``q_*``, which approximates the ranked probability score."""
    losses = [pinball(F.col("y"), F.col(f"`q_{q}`"), q) for q in quantiles]
    return preds.groupBy(*keys).agg((sum(losses) * (2.0 / len(losses))).alias("crps"))


def sample_crps(y: Column, samples: Column) -> Column:
    """The ranked probability score of one value against an array of samples: mean distance less half the mean distance of pairs.

    The pairs' distances are a weighted sum over the ordered samples, so their number is not squared. Null
    samples are left out; without a sample or a value the score is null.
    """
    held = F.array_sort(F.filter(samples, lambda x: x.isNotNull()))
    n = F.size(held)
    zero = F.lit(0.0)
    near = F.aggregate(held, zero, lambda s, x: s + F.abs(x - y))
    pairs = F.aggregate(F.transform(held, lambda x, i: (2 * i + 1 - n) * x), zero, lambda s, x: s + x)
    return F.when(n > 0, near / n - pairs / (n * n))


def crps_from_samples(preds: DataFrame, samples: str = "paths", keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """The mean ``sample_crps`` of the rows' samples by ``keys``: the exact score, where quantiles approximate it."""
    return preds.groupBy(*keys).agg(F.avg(sample_crps(F.col("y"), F.col(samples))).alias("crps"))


def conformal_interval(preds: DataFrame, calibration: DataFrame, level: float = 0.8) -> DataFrame:
    """Bounds ``pred`` plus or minus the ``level`` quantile of each series' absolute calibration residuals."""
    width = calibration.groupBy("series_id").agg(F.percentile(F.abs(F.col("y") - F.col("pred")), level).alias("_width"))
    return preds.join(width, "series_id").withColumns({"lower_bound": F.col("pred") - F.col("_width"), "upper_bound": F.col("pred") + F.col("_width")}).drop("_width")


def seasonal_naive(grid: DataFrame, steps: int, season: int, n_offsets: int = 1) -> DataFrame:
    """The next ``steps`` values as the mean of the values ``season`` positions before, over ``n_offsets`` seasons.

    Only the last ``season * n_offsets`` rows of each series leave the scan's aggregate.
    """
    last = grid.groupBy("series_id").agg(F.max("pos").alias("_last"))
    tail = grid.join(last, "series_id").where(F.col("pos") > F.col("_last") - season * n_offsets)
    ahead = tail.withColumn("_phase", (F.col("pos") - F.col("_last") - 1 + season * n_offsets) % season)
    means = ahead.groupBy("series_id", "_phase").agg(F.avg("y").alias("pred"))
    return means.select("series_id", "pred", F.explode(F.sequence(F.col("_phase") + 1, F.lit(steps).cast("long"), F.lit(season).cast("long")) if steps >= season else F.filter(F.array(F.col("_phase") + 1), lambda s: s <= steps)).alias("step"))
