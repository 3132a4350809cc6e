"""Searching a plan's choices by backtests, and selecting features from one pass of sums."""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.plans import models
from seriesloom.plans.assistant import Assistant
from seriesloom.plans.records import CVParams, ForecastPlan


@dataclass
class Search:
    """The scores of all tries, and the plan of the best."""

    scores: DataFrame
    best: ForecastPlan
    value: float


def tries(space: dict[str, list], n: int | None = None, seed: int = 123) -> list[dict]:
    """All combinations of ``space``, or ``n`` distinct ones drawn by ``seed``."""
    if not space or any(not v for v in space.values()):
        raise ValueError("every choice of the space has at least one value")
    sizes = [len(v) for v in space.values()]
    total = int(np.prod(sizes, dtype=object))
    places = range(total) if n is None or n >= total else sorted(random.Random(seed).sample(range(total), n))
    out = []
    for place in places:
        at = []
        for size in reversed(sizes):
            place, i = divmod(place, size)
            at.append(i)
        out.append({k: v[i] for (k, v), i in zip(space.items(), reversed(at), strict=True)})
    return out


def search(assistant: Assistant, plan: ForecastPlan, space: dict[str, list], n: int | None = None, seed: int = 123, metric: str | None = None, cv: CVParams | None = None) -> Search:
    """Backtest the plan with every combination of ``space`` (choices of ``refine_plan``), or ``n`` drawn ones, over the same folds.

    The best has the lowest mean of ``metric`` over the series; ties go to the first tried. Tries are
    distributed plans, run one after another.
    """
    metric = metric or plan.metric
    rows, best, value = [], None, float("inf")
    for i, choices in enumerate(tries(space, n, seed)):
        refined = assistant.refine_plan(plan, metric=metric, **choices)
        cv = cv or assistant.create_cv(refined)
        got = assistant.backtest(refined, cv).metrics.agg(F.avg(metric)).first()[0]
        rows.append((i, repr(choices), got))
        if got is not None and got < value:
            best, value = refined, got
    if best is None:
        raise ValueError("no try gave a score")
    return Search(assistant.data.sparkSession.createDataFrame(rows, "place int, choices string, value double"), best, value)


def _packed(cells: list, key: str) -> dict:
    """Packed sums by the value of a key, from collected rows ``key, i, value``."""
    out: dict = {}
    for r in sorted(cells, key=lambda r: r["i"]):
        out.setdefault(r[key], []).append(r["value"])
    return {k: np.array(v, float) for k, v in out.items()}


def squared_error(sums: np.ndarray, held: list[int], beta: np.ndarray) -> float:
    """The mean squared error of a linear model on the rows that packed sums of (features, target, 1) stand for."""
    width = int(round(len(sums) ** 0.5))
    g = sums.reshape(width, width)
    full = np.zeros(width)
    full[[*held, width - 1]], full[width - 2] = beta, -1.0
    return float(max(full @ g @ full, 0.0) / g[-1, -1])


@dataclass(frozen=True)
class OneStep:
    """The scores of all tries and the best: its features and penalty."""

    scores: list[dict]
    features: list[str]
    alpha: float
    value: float


def one_step_search(matrix: DataFrame, names: list[str], tries: list[list[str]], alphas: list[float], initial: int, target: str = "y", metric: str = "rmse") -> OneStep:
    """Every choice of features and penalty, scored by one-step-ahead predictions of the rows from ``initial`` on.

    The rows before ``initial`` train, those after it test. Two matrices of sums, of one job, stand for both: a
    try is a choice of their rows and columns, fitted and scored without another look at the data. All tries
    see the same rows, those with every feature of ``names``. ``metric`` is mse or rmse; ties go to the first.
    """
    if metric not in ("mse", "rmse"):
        raise ValueError("one-step scores are mse or rmse: sums of products know no other")
    unknown = sorted({n for t in tries for n in t} - set(names))
    if unknown or not tries or not alphas:
        raise ValueError(f"tries are of the matrix's features; unknown: {', '.join(unknown)}" if unknown else "give tries and penalties")
    split = matrix.withColumn("_split", (F.col("pos") >= initial).cast("int"))
    sums = _packed(models.gram_sums(split, names, ["_split"], target).collect(), "_split")  # features squared, twice
    if set(sums) != {0, 1}:
        raise ValueError("both sides of the split need rows with all features")
    width, scores = len(names) + 2, []
    g = sums[0].reshape(width, width)
    for features in tries:
        held = [names.index(n) for n in features]
        at = [*held, width - 2, width - 1]
        for alpha in alphas:
            beta, _ = models.solve_ridge(g[np.ix_(at, at)].ravel(), alpha)
            mse = squared_error(sums[1], held, beta)
            scores.append({"features": features, "alpha": alpha, metric: mse if metric == "mse" else mse**0.5})
    best = min(scores, key=lambda r: r[metric])
    return OneStep(scores, best["features"], best["alpha"], best[metric])


def lag_search(grid: DataFrame, lag_sets: list[list[int]], alphas: list[float], initial: int, windows: list[tuple[str, int]] | None = None, metric: str = "rmse") -> OneStep:
    """``one_step_search`` over sets of lags of one model of all series, beside fixed windows."""
    every = sorted({k for lags in lag_sets for k in lags})
    matrix, names, target = models.design_matrix(grid, models.Design(every, windows or []))
    fixed = names[len(every) :]
    return one_step_search(matrix, names, [[*(f"lag_{k}" for k in lags), *fixed] for lags in lag_sets], alphas, initial, target, metric)


def select_features_cv(matrix: DataFrame, names: list[str], fold: str, least: int = 1, target: str = "y", alpha: float = 1.0, force: list[str] | None = None) -> tuple[list[str], list[dict]]:
    """Recursive elimination whose number of features is cross-validated: the features, and ``features, mse`` of each number.

    Sums of products by fold, of one pass, are all that is needed: a fold's model comes from the sums of the
    others, its error from its own. Features go one at a time within each fold; the number of least mean error,
    the smallest of those alike, is then kept of all rows. ``force`` stays in. Rows without a fold are left out.
    """
    sums = _packed(models.gram_sums(matrix.where(F.col(fold).isNotNull()), names, [fold], target).collect(), fold)  # features squared a fold
    if len(sums) < 2:
        raise ValueError("cross-validation needs two folds with rows")
    whole, width = sum(sums.values()), len(names) + 2
    errors: dict[int, list[float]] = {}
    for own in sums.values():
        rest = whole - own
        for keep in range(len(names), max(least, len(force or [])) - 1, -1):
            held = sorted(names.index(n) for n in eliminate(rest, names, keep, alpha, force))
            at = [*held, width - 2, width - 1]
            beta, _ = models.solve_ridge(rest.reshape(width, width)[np.ix_(at, at)].ravel(), alpha)
            errors.setdefault(keep, []).append(squared_error(own, held, beta))
    scores = [{"features": k, "mse": float(np.mean(e))} for k, e in sorted(errors.items())]
    best = min(scores, key=lambda r: (round(r["mse"], 12), r["features"]))["features"]
    return eliminate(whole, names, best, alpha, force), scores


def eliminate(sums: np.ndarray, names: list[str], keep: int, alpha: float = 1.0, force: list[str] | None = None) -> list[str]:
    """Recursive elimination from packed sums of products: the feature of least standardised coefficient goes first.

    The sums are all that is needed: leaving a feature out leaves out its row and column.
    """
    width = len(names) + 2
    g = np.asarray(sums, float).reshape(width, width)
    held, forced = list(range(len(names))), {names.index(f) for f in force or []}
    if not 1 <= keep <= len(names):
        raise ValueError(f"keep is within 1 and {len(names)}")
    while len(held) > max(keep, len(forced)):
        at = [*held, width - 2, width - 1]
        beta, _ = models.solve_ridge(g[np.ix_(at, at)].ravel(), alpha)
        n = g[-1, -1]
        spread = np.sqrt(np.maximum(g.diagonal()[held] / n - (g[-1, held] / n) ** 2, 0))
        weight = np.abs(beta[:-1]) * spread
        weight[[i for i, h in enumerate(held) if h in forced]] = np.inf
        held.pop(int(weight.argmin()))
    return [names[i] for i in held]


def select_features(matrix: DataFrame, names: list[str], keep: int, target: str = "y", alpha: float = 1.0, force: list[str] | None = None) -> list[str]:
    """The ``keep`` features left by recursive elimination of a ridge model of all rows, from one pass over ``matrix``."""
    cells = models.gram_sums(matrix, names, [], target).orderBy("i").collect()  # features squared
    if not cells:
        raise ValueError("no row has all features")
    return eliminate(np.array([c["value"] for c in cells]), names, keep, alpha, force)
