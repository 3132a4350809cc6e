"""ARIMA by two regressions: a long autoregression gives the shocks, a second one the coefficients of every order at once.

Both are fitted from sums of products, so no task holds a series' rows. The second matrix has all lags of
values and shocks; each order of the grid is a choice of its rows and columns, judged over the same rows.
The criterion is BIC by default: the shocks are estimates, over which AICc, the other choice, keeps lags
that only mend them. Per series only this matrix is looked at by a task.
"""

from __future__ import annotations

from itertools import product
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.frequency import Freq
from seriesloom.operators.features import difference, integrate
from seriesloom.plans import models

#: Penalty that keeps collinear lags solvable; too small to be seen.
TINY = 1e-9


def differenced(grid: DataFrame, d: int, season: int = 0) -> DataFrame:
    """``_z``: the ``d``-th difference of ``y``, of its seasonal difference first where ``season`` is given."""
    w = Window.partitionBy("series_id").orderBy("pos")
    if season:
        grid = grid.withColumn("_s", F.col("y") - F.lag("y", season).over(w))
    base = "_s" if season else "y"
    return difference(grid, d, base, "_z") if d else grid.withColumn("_z", F.col(base))


def choose_difference(grid: DataFrame, most: int = 2) -> int:
    """The order of differencing of least spread, by the mean log deviation over the series: one aggregate."""
    tried = grid
    for d in range(1, most + 1):
        tried = difference(tried, d, "y", f"_d{d}")
    names = ["y", *[f"_d{d}" for d in range(1, most + 1)]]
    by = tried.groupBy("series_id").agg(*[F.stddev_samp(n).alias(n) for n in names])
    spread = by.agg(*[F.avg(F.log(F.greatest(n, F.lit(1e-12)))).alias(n) for n in names]).first()
    found = [(spread[n], d) for d, n in enumerate(names) if spread[n] is not None]
    return min(found)[1] if found else 0


def orders(max_p: int, max_q: int, season: int = 0) -> list[tuple[int, int, int, int]]:
    """All (p, q, P, Q), fewest coefficients first; seasonal terms are the single lags of one season."""
    every = product(range(max_p + 1), range(max_q + 1), *[range(2 if season else 1)] * 2)
    return sorted(every, key=lambda o: (sum(o), o))


def _columns(order: tuple[int, int, int, int], z_lags: list[int], e_lags: list[int], season: int) -> list[int]:
    p, q, sp, sq = order
    z = [i for i, k in enumerate(z_lags) if k <= p or (sp and k == season)]
    return z + [len(z_lags) + i for i, k in enumerate(e_lags) if k <= q or (sq and k == season)]


def growth(beta: np.ndarray, z_lags: list[int]) -> float:
    """The factor by which values grow in the long run: the largest root of the autoregression."""
    reach = max(z_lags, default=0)
    phi = np.zeros(reach)
    for b, k in zip(beta[: len(z_lags)], z_lags, strict=True):
        phi[k - 1] = b
    return float(np.abs(np.roots([1.0, *-phi])).max(initial=0.0)) if phi.any() else 0.0


def best_order(sums: np.ndarray, tried: list[tuple[int, int, int, int]], z_lags: list[int], e_lags: list[int], season: int, criterion: str = "bic") -> tuple | None:
    """Of packed sums of (lags of values, lags of shocks, value, 1) the order of least BIC or AICc.

    Orders whose values would grow without bound are left out, unless no other is tried. Gives p, q, P, Q, the coefficients of all lags with those left out zero and the intercept last, the
    shocks' deviation and the criterion; None where there are too few rows. Ties go to the fewest coefficients.
    """
    width = len(z_lags) + len(e_lags) + 2
    g = sums.reshape(width, width)
    n, best = g[-1, -1], None
    for order in tried:
        held = _columns(order, z_lags, e_lags, season)
        k = len(held) + 2  # with intercept and variance
        if n - k - 1 <= 0:
            continue
        at = [*held, width - 2, width - 1]
        beta, _ = models.solve_ridge(g[np.ix_(at, at)].ravel(), TINY)
        full = np.zeros(width - 1)
        full[[*held, width - 2]] = beta
        inner = np.append(full[:-1], [-1.0, full[-1]])
        rss = max(float(inner @ g @ inner), 1e-12 * max(g[-2, -2], 1e-300))
        if len(tried) > 1 and growth(full, z_lags) > 1 + 1e-3:
            continue
        score = n * np.log(rss / n) + (k * np.log(n) if criterion == "bic" else 2 * k + 2 * k * (k + 1) / (n - k - 1))
        if best is None or score < best[-1] - 1e-9:
            best = (*order, full.tolist(), float(np.sqrt(rss / max(n - len(held) - 1, 1))), float(score))
    return best


def shocks(z: DataFrame, long: int, until: int | None = None) -> DataFrame:
    """``_e``: what an autoregression on ``long`` lags of ``_z``, fitted by series on positions before ``until``, leaves."""
    w = Window.partitionBy("series_id").orderBy("pos")
    names = [f"_l{k}" for k in range(1, long + 1)]
    lagged = z.withColumns({n: F.lag("_z", k).over(w) for k, n in enumerate(names, 1)})
    train = lagged if until is None else lagged.where(F.col("pos") < until)
    betas = models.fit_ridge(train, names, ["series_id"], TINY, "_z").select("series_id", "beta")
    return lagged.join(betas, "series_id").withColumn("_e", F.col("_z") - models.fitted_value(names)).drop(*names, "beta")


def fit_arima(grid: DataFrame, d: int = 0, season: int = 0, max_p: int = 3, max_q: int = 3, seasonal_difference: bool = False, long: int | None = None, until: int | None = None, tried: list[tuple[int, int, int, int]] | None = None, criterion: str = "bic") -> tuple[DataFrame, DataFrame]:
    """``series_id, p, q, sp, sq, beta, sigma, criterion`` of the best order of each series, and the rows with values ``_z`` and shocks ``_e``.

    ``season`` adds the lags of one season to the orders tried; positions from ``until`` on are not learned from.
    Rows with a null among their lags are left out. Series with too few rows have no model.
    """
    if criterion not in ("bic", "aicc"):
        raise ValueError("the criterion is bic or aicc")
    tried = tried or orders(max_p, max_q, season)
    max_p, max_q = max(o[0] for o in tried), max(o[1] for o in tried)
    z_lags = [*range(1, max_p + 1), *([season] if season > max_p and any(o[2] for o in tried) else [])]
    e_lags = [*range(1, max_q + 1), *([season] if season > max_q and any(o[3] for o in tried) else [])]
    long = long or max(12, season + 2 if season else 0, 2 * max(max_p, max_q))
    rows = shocks(differenced(grid, d, season if seasonal_difference else 0), long, until)
    w = Window.partitionBy("series_id").orderBy("pos")
    lags = {f"_z{k}": F.lag("_z", k).over(w) for k in z_lags} | {f"_e{k}": F.lag("_e", k).over(w) for k in e_lags}
    matrix = rows.withColumns(lags) if lags else rows
    sums = models.gram_sums((matrix if until is None else matrix.where(F.col("pos") < until)).where("_e is not null"), list(lags), ["series_id"], "_z")
    packed = sums.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("cells"))

    def run(frames):
        for frame in frames:
            found = [(s, best_order(np.array([c["value"] for c in cells]), tried, z_lags, e_lags, season, criterion)) for s, cells in zip(frame["series_id"], frame["cells"], strict=True)]
            yield pd.DataFrame([(s, *b) for s, b in found if b], columns=["series_id", "p", "q", "sp", "sq", "beta", "sigma", "criterion"])

    fits = packed.mapInPandas(run, "series_id string, p int, q int, sp int, sq int, beta array<double>, sigma double, criterion double")
    return fits, rows


def response(beta: np.ndarray, z_lags: list[int], e_lags: list[int], d: int, season: int, steps: int) -> np.ndarray:
    """What a shock of one adds to the value so many steps later: the model's expansion, differences undone."""
    reach = max([0, *z_lags, *e_lags]) + steps
    phi, theta = np.zeros(reach + 1), np.zeros(reach + 1)
    phi[0] = theta[0] = 1.0
    for b, k in zip(beta[: len(z_lags)], z_lags, strict=True):
        phi[k] -= b
    for b, k in zip(beta[len(z_lags) : -1], e_lags, strict=True):
        theta[k] += b
    for _ in range(d):
        phi = np.convolve(phi, [1.0, -1.0])
    if season:
        phi = np.convolve(phi, [1.0, *[0.0] * (season - 1), -1.0])
    out = np.zeros(steps)
    for s in range(steps):
        out[s] = (theta[s] if s < len(theta) else 0.0) - sum(phi[k] * out[s - k] for k in range(1, min(s, len(phi) - 1) + 1))
    return out


def arima_forecast(grid: DataFrame, steps: int, freq: str, d: int | None = None, season: int = 0, max_p: int = 3, max_q: int = 3, seasonal_difference: bool = False, long: int | None = None, interval: tuple[float, float] | None = None, folds: DataFrame | None = None, tried: list[tuple[int, int, int, int]] | None = None, criterion: str = "bic") -> DataFrame:
    """``series_id, step, ts, pred`` and bounds by the best order of each series, with ``folds`` also ``fold``.

    Without ``d`` the order of differencing of least spread is taken, one for all series. With folds the model
    of the first training range predicts from the end of each, its parameters frozen. Bounds are the model's
    own: its shocks' deviation times the growth of their responses. Known shocks are those of the long
    autoregression, shocks ahead are zero. A series whose last values hold a null is not predicted.
    """
    until = folds.agg(F.min("train_to")).first()[0] if folds is not None else None
    d = choose_difference(grid if until is None else grid.where(F.col("pos") < until)) if d is None else d
    tried = tried or orders(max_p, max_q, season)
    p, q = max(o[0] for o in tried), max(o[1] for o in tried)
    z_lags = [*range(1, p + 1), *([season] if season > p and any(o[2] for o in tried) else [])]
    e_lags = [*range(1, q + 1), *([season] if season > q and any(o[3] for o in tried) else [])]
    fits, rows = fit_arima(grid, d, season, seasonal_difference=seasonal_difference, long=long, until=until, tried=tried, criterion=criterion)
    size = max([1, d + (season if seasonal_difference else 0), *z_lags, *e_lags])
    if folds is None:
        last = rows.where("y is not null").groupBy("series_id").agg(F.max("pos").alias("_last")).withColumn("fold", F.lit(0).cast("long"))
        near = rows.join(last, "series_id").where((F.col("pos") > F.col("_last") - size) & (F.col("pos") <= F.col("_last")))
    else:
        spans = folds.select("fold", F.explode(F.sequence(F.col("train_to") - size, F.col("train_to") - 1)).alias("pos"))
        near = rows.join(spans, "pos")
    cells = F.array_sort(F.collect_list(F.struct("pos", "y", "_z", "_e")))
    tails = near.groupBy("series_id", "fold").agg(F.max("ts").alias("last_ts"), cells.alias("cells")).where(F.size("cells") == size)
    z = [NormalDist().inv_cdf(a) for a in interval] if interval else [0.0, 0.0]
    apart = season if seasonal_difference else 0

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                value = lambda name, r=r: np.array([np.nan if c[name] is None else c[name] for c in r["cells"]], float)
                y, held, known, beta = value("y"), value("_z"), value("_e"), np.array(r["beta"], float)
                for _ in range(steps):
                    x = [held[-k] for k in z_lags] + [known[-k] for k in e_lags] + [1.0]
                    used = beta != 0
                    held, known = np.append(held, beta[used] @ np.array(x)[used]), np.append(known, 0.0)
                ahead = held[-steps:]
                if apart:
                    seasonal = y[apart:] - y[:-apart]
                    ahead = integrate(ahead, seasonal, d) if d else ahead
                    whole = y
                    for v in ahead:
                        whole = np.append(whole, whole[-apart] + v)
                    pred = whole[-steps:]
                else:
                    pred = integrate(ahead, y, d)
                width = r["sigma"] * np.sqrt(np.cumsum(response(beta, z_lags, e_lags, d, apart, steps) ** 2))
                out += [(r["series_id"], r["fold"], s + 1, r["last_ts"], float(v), float(v + z[0] * e), float(v + z[1] * e)) for s, (v, e) in enumerate(zip(pred, width, strict=True)) if not np.isnan(v)]
            yield pd.DataFrame(out, columns=["series_id", "fold", "step", "last_ts", "pred", "lower_bound", "upper_bound"])

    made = tails.join(fits, "series_id").mapInPandas(run, "series_id string, fold long, step int, last_ts timestamp_ntz, pred double, lower_bound double, upper_bound double")
    made = made.withColumn("ts", Freq.parse(freq).shift(F.col("last_ts"), F.col("step"))).drop("last_ts")
    made = made if interval else made.drop("lower_bound", "upper_bound")
    return made.drop("fold") if folds is None else made
