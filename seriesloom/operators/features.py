"""Lags, rolling statistics and training matrices over regular grids.

All of one matrix's features share a window specification, so that a series is shuffled and sorted
once however many features it gets.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriesloom.functions.frequency import Freq
from seriesloom.sources.scratch import Steps

STATS = ("mean", "std", "min", "max", "sum", "median", "ratio_min_max", "coef_variation", "ewm")
EWM_ALPHA = 0.3


def _weighted(v: np.ndarray, axis: int = 0, alpha: float = EWM_ALPHA) -> np.ndarray:
    weights = (1 - alpha) ** np.arange(v.shape[axis])[::-1]
    return np.tensordot(weights / weights.sum(), v, (0, axis))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full_like(np.asarray(a, float), np.nan), where=np.asarray(b) != 0)


#: The same statistics over arrays of past values, oldest first, for recursive predictions.
ARRAY_STATS: dict[str, Callable[..., np.ndarray]] = {
    "mean": np.mean, "min": np.min, "max": np.max, "sum": np.sum, "median": np.median,
    "std": lambda v, axis: np.std(v, axis=axis, ddof=1),
    "ratio_min_max": lambda v, axis: _ratio(np.min(v, axis=axis), np.max(v, axis=axis)),
    "coef_variation": lambda v, axis: _ratio(np.std(v, axis=axis, ddof=1), np.mean(v, axis=axis)),
    "ewm": _weighted,
}
_CUSTOM: dict[str, Callable[[Column, WindowSpec], Column]] = {}


def register_statistic(name: str, column: Callable[[Column, WindowSpec], Column], array: Callable[..., np.ndarray]) -> None:
    """A rolling statistic of the caller's own, usable wherever a built-in one is.

    ``column`` gives it of a column over a window; ``array`` gives the same over ``axis`` of an array of
    past values, oldest first, in recursive predictions, and travels to the workers.
    """
    if name in STATS:
        raise ValueError(f"{name} is built in")
    _CUSTOM[name], ARRAY_STATS[name] = column, array


def statistics() -> list[str]:
    return [*STATS, *_CUSTOM]


def _by_series() -> Window:
    return Window.partitionBy("series_id").orderBy("pos")


def lag_columns(lags: int | list[int], column: str = "y") -> dict[str, Column]:
    """``lag_k`` for lags 1..n or the listed ones."""
    lags = list(range(1, lags + 1)) if isinstance(lags, int) else lags
    return {f"lag_{k}": F.lag(column, k).over(_by_series()) for k in lags}


def rolling_column(stat: str, window: int, column: str = "y", alpha: float = EWM_ALPHA, min_periods: int | None = None) -> Column:
    """A statistic of the ``window`` values before the row; null unless ``min_periods`` (all by default) are there."""
    w = _by_series().rowsBetween(-window, -1)
    y = F.col(column)
    if stat == "ewm":
        terms = [(F.lag(y, i + 1).over(_by_series()), (1 - alpha) ** i) for i in range(window)]
        value = sum(t * k for t, k in terms) / F.lit(sum(k for _, k in terms))
        return value
    build = {
        "mean": lambda: F.avg(y).over(w),
        "std": lambda: F.stddev_samp(y).over(w),
        "min": lambda: F.min(y).over(w),
        "max": lambda: F.max(y).over(w),
        "sum": lambda: F.sum(y).over(w),
        "median": lambda: F.percentile(y, 0.5).over(w),
        "ratio_min_max": lambda: F.try_divide(F.min(y).over(w), F.max(y).over(w)),
        "coef_variation": lambda: F.try_divide(F.stddev_samp(y).over(w), F.avg(y).over(w)),
        **{name: (lambda build=build: build(y, w)) for name, build in _CUSTOM.items()},
    }
    if stat not in build:
        raise ValueError(f"unknown statistic {stat!r}; known: {', '.join(statistics())}")
    return F.when(F.count(y).over(w) >= (min_periods or window), build[stat]())


def rolling_name(stat: str, window: int, alpha: float = 0.3) -> str:
    return f"roll_{stat}_{window}" + (f"_alpha_{alpha}" if stat == "ewm" else "")


def add_features(grid: DataFrame, lags: int | list[int] | None = None, windows: list[tuple[str, int]] | None = None, column: str = "y") -> DataFrame:
    """Lags and rolling statistics of ``column`` as columns."""
    columns = lag_columns(lags, column) if lags else {}
    for stat, size in windows or []:
        columns[rolling_name(stat, size)] = rolling_column(stat, size, column)
    return grid.withColumns(columns) if columns else grid


FILLS = ("mean", "median", "ffill", "bfill")


def fill_features(matrix: DataFrame, names: list[str], method: str | float) -> DataFrame:
    """Features without their missing values: by the series' ``mean`` or ``median`` of the feature, the value before
    (``ffill``) or after (``bfill``), or a number. Where a series has no such value nulls stay.
    """
    if isinstance(method, (int, float)) and not isinstance(method, bool):
        return matrix.withColumns({n: F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(float(method))) for n in names})
    if method not in FILLS:
        raise ValueError(f"missing features are filled by {', '.join(FILLS)} or a number")
    if method in ("mean", "median"):
        of = F.avg if method == "mean" else lambda c: F.percentile(c, 0.5)
        centre = matrix.groupBy("series_id").agg(*[of(F.col(f"`{n}`").cast("double")).alias(f"_c{i}") for i, n in enumerate(names)])
        met = matrix.join(centre, "series_id")
        return met.withColumns({n: F.coalesce(F.col(f"`{n}`").cast("double"), F.col(f"_c{i}")) for i, n in enumerate(names)}).drop(*[f"_c{i}" for i in range(len(names))])
    w = _by_series().rowsBetween(Window.unboundedPreceding, 0) if method == "ffill" else _by_series().rowsBetween(0, Window.unboundedFollowing)
    pick = F.last if method == "ffill" else F.first
    return matrix.withColumns({n: pick(F.col(f"`{n}`").cast("double"), ignorenulls=True).over(w) for n in names})


def series_onehot(df: DataFrame, ids: list[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with a column of 0 and 1 for each of ``ids``, and the columns' names; another series has zeros in all."""
    names = {f"series_is_{i}": (F.col("series_id") == v).cast("double") for i, v in enumerate(ids)}
    return df.withColumns(names), list(names)


def difference(grid: DataFrame, order: int = 1, column: str = "y", out: str = "diff") -> DataFrame:
    """The ``order``-th difference by position, from binomial coefficients over lags: one window."""
    value, c = F.col(column), 1
    for k in range(1, order + 1):
        c = -c * (order - k + 1) // k
        value = value + c * F.lag(column, k).over(_by_series())
    return grid.withColumn(out, value)


def undifference(diffs: DataFrame, anchor: str, column: str = "diff", out: str = "y") -> DataFrame:
    """Invert a first difference: the anchor plus the running sum."""
    w = _by_series().rowsBetween(Window.unboundedPreceding, 0)
    return diffs.withColumn(out, F.col(anchor) + F.sum(F.coalesce(column, F.lit(0.0))).over(w))


def integrate(steps: np.ndarray, past: np.ndarray, order: int) -> np.ndarray:
    """Values of consecutive steps from their ``order``-th differences and the values before, along the first axis."""
    for k in reversed(range(order)):
        steps = np.diff(past, k, axis=0)[-1] + np.cumsum(steps, axis=0)
    return steps


def window_size(lags: int | list[int] | None, windows: list[tuple[str, int]] | None, differentiation: int = 0) -> int:
    """Rows that the features of a row reach back."""
    longest = max([0, lags if isinstance(lags, int) else max(lags or [0]), *(n for _, n in windows or [])])
    return longest + differentiation


def train_matrix(grid: DataFrame, lags: int | list[int], windows: list[tuple[str, int]] | None = None, drop_null: bool = True) -> DataFrame:
    """Features and target of the rows with a full history; rows with a null among them are left out if asked."""
    out = add_features(grid, lags, windows).where(F.col("pos") >= window_size(lags, windows))
    return out.dropna() if drop_null else out


def direct_targets(grid: DataFrame, lags: int | list[int], steps: int) -> DataFrame:
    """A row for each origin and step: the features before the origin and the value ``step`` rows on.

    One window for features and leads, then the steps unfold in place.
    """
    leads = F.array(*[F.struct(F.lit(s).cast("long").alias("step"), F.lead("y", s - 1).over(_by_series()).alias("target")) for s in range(1, steps + 1)])
    names = list(lag_columns(lags))
    out = grid.withColumns({**lag_columns(lags), "_leads": leads}).where(F.col("pos") >= window_size(lags, None))
    return out.select("series_id", "ts", "pos", *names, F.inline("_leads")).where("target is not null")


def multivariate_lags(grid: DataFrame, series: list[str], lags: int | list[int], freq: str = "D", leads: int = 0) -> DataFrame:
    """Every named series beside each other by timestamp, with lags ``s_lag_k`` and leads ``s_lead_k`` (1 is the row itself).

    Each value is sent to the timestamps that look at it, and one grouped aggregate puts them side by
    side: work spreads over timestamps, and no task orders them all.
    """
    lags = list(range(1, lags + 1)) if isinstance(lags, int) else lags
    step = Freq.parse(freq)
    shifts = F.explode(F.array(*[F.lit(k) for k in [0, *lags, *[1 - s for s in range(2, leads + 1)]]]))
    sent = grid.where(F.col("series_id").isin(series)).select("series_id", "ts", "y", shifts.alias("_k"))
    sent = sent.select("series_id", step.shift(F.col("ts"), F.col("_k")).alias("ts"), "y", "_k")
    pick = lambda s, k: F.max(F.when((F.col("series_id") == s) & (F.col("_k") == k), F.col("y")))
    columns = [pick(s, 0).alias(s) for s in series] + [pick(s, k).alias(f"{s}_lag_{k}") for s in series for k in lags]
    columns += [pick(s, 1 - k).alias(f"{s}_lead_{k}") for s in series for k in range(1, leads + 1)]
    out = sent.groupBy("ts").agg(*columns, F.max((F.col("_k") == 0).cast("int")).alias("_here"))
    return out.where("_here = 1").drop("_here")


def series_encoding(df: DataFrame) -> DataFrame:
    """Each series id with its 0-based place in order.

    Ids are sorted by range over the partitions, which is written once; a count a partition then says where
    each partition's places begin. No task sees the ids of another.
    """
    ids = df.select("series_id").distinct().sort("series_id").withColumn("_id", F.monotonically_increasing_id())
    ids = Steps(df.sparkSession, "series").written(ids)
    part = F.shiftright("_id", 33)
    sizes = {r["p"]: r["n"] for r in ids.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    starts, total = [], 0
    for p in sorted(sizes):
        starts += [F.lit(p).cast("long"), F.lit(total).cast("long")]
        total += sizes[p]
    begin = F.try_element_at(F.create_map(*starts), part) if starts else F.lit(0).cast("long")
    within = F.col("_id") - F.shiftleft(part, 33)
    return ids.select("series_id", (begin + within).cast("long").alias("series_code"))


def event_distance(grid: DataFrame, event: Column, fill: int) -> DataFrame:
    """Periods since the last and until the next event, ``fill`` where there is none."""
    back = _by_series().rowsBetween(Window.unboundedPreceding, 0)
    ahead = _by_series().rowsBetween(0, Window.unboundedFollowing)
    at = F.when(event, F.col("pos"))
    return grid.withColumns({
        "since": F.coalesce(F.col("pos") - F.last(at, ignorenulls=True).over(back), F.lit(fill).cast("long")),
        "until": F.coalesce(F.first(at, ignorenulls=True).over(ahead) - F.col("pos"), F.lit(fill).cast("long")),
    })
