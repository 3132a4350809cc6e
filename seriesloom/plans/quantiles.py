"""Quantile regression from reweighted sums of products: all quantiles of all keys from one pass an iteration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.plans import models
from seriesloom.sources.scratch import Steps

#: Keeps the normal equations solvable where features are collinear.
TINY = 1e-9


def _sums(rows: DataFrame, keys: list[str], width: int, quantiles: list[float], slack: float) -> DataFrame:
    """``keys…, q, sums``: for each quantile the sums of (features, 1, target) weighted by the inverse distance from its fit, and the plain sums last."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: dict[str, list] = {k: [] for k in keys} | {"q": [], "sums": []}
            for key, part in frame.groupby(keys, dropna=False, sort=False) if keys else [((), frame)]:
                x = np.stack(part["_x"]).astype(float)
                betas = np.stack([np.asarray(b, float) for b in part["_b"].iloc[0]])
                for i in range(len(quantiles)):
                    w = 1.0 / (slack + np.abs(x[:, -1] - x[:, :-1] @ betas[i]))
                    for k, v in zip(keys, key if isinstance(key, tuple) else (key,), strict=True):
                        out[k].append(v)
                    out["q"].append(i)
                    out["sums"].append(np.concatenate([((x * w[:, None]).T @ x).ravel(), x.sum(0)]))
            if out["q"]:
                yield pd.DataFrame(out)

    kinds = "".join(f"`{k}` {rows.schema[k].dataType.simpleString()}, " for k in keys)
    parts = rows.mapInPandas(partial, kinds + "q int, sums array<double>").select(*keys, "q", F.posexplode("sums").alias("i", "v"))
    cells = parts.groupBy(*keys, "q", "i").agg(F.sum("v").alias("v"))
    return cells.groupBy(*keys, "q").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("sums"))


def fit_quantiles(matrix: DataFrame, features: list[str], quantiles: list[float], keys: list[str] | None = None, target: str = "y", iterations: int = 30, slack: float = 1e-4) -> DataFrame:
    """``keys…, betas``: for each quantile the coefficients, intercept last, of a linear model of least pinball loss.

    Each iteration minimises a quadratic that touches the loss at the last fit (Hunter and Lange 2000); its normal
    equations need the sums of products of the rows weighted by the inverse of their distance. All quantiles
    and keys share the pass. ``slack``, in units of the target's deviation, rounds the loss at zero. Rows with a
    null are left out. Iterations stop when no coefficient moves any more.
    """
    keys = keys or []
    columns = [F.col(f"`{n}`").cast("double") for n in features]
    rows = matrix.select(*keys, F.array(*columns, F.lit(1.0), F.col(f"`{target}`").cast("double")).alias("_x")).where(~F.exists("_x", lambda v: v.isNull() | F.isnan(v)))
    y = F.col(f"`{target}`").cast("double")
    stats = matrix.agg(F.stddev_samp(F.when(~F.isnan(y), y))).first()[0] or 1.0
    width, count = len(features) + 2, len(quantiles)
    first = models.fit_ridge(matrix, features, keys, TINY, target).select(*keys, "beta")
    betas = first.select(*keys, F.array(*[F.col("beta")] * count).alias("_b"))
    rows = rows.persist()

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, packed in zip(frame["q"], frame["sums"], strict=True):
                packed = np.asarray(packed, float)
                g, plain = packed[: width * width].reshape(width, width), packed[width * width :]
                left = g[:-1, :-1] + TINY * np.trace(g[:-1, :-1]) / width * np.eye(width - 1)
                out.append(np.linalg.lstsq(left, g[:-1, -1] + (2 * quantiles[i] - 1) * plain[:-1], rcond=None)[0].tolist())
            yield frame[[*keys, "q"]].assign(b=out)

    kinds = "".join(f"`{k}` {matrix.schema[k].dataType.simpleString()}, " for k in keys)
    steps = Steps(matrix.sparkSession, "quantiles")
    state = steps.written(betas)
    for _ in range(iterations):
        met = rows.join(state, keys) if keys else rows.crossJoin(F.broadcast(state))  # one row
        solved = _sums(met, keys, width, quantiles, slack * stats).mapInPandas(solve, kinds + "q int, b array<double>")
        new = steps.written(solved.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "b"))), lambda c: c["b"]).alias("_b")).where(F.size("_b") > 0))
        old = state.withColumnRenamed("_b", "_old")
        both = new.join(old, keys) if keys else new.crossJoin(F.broadcast(old))
        apart = F.aggregate(F.zip_with(F.flatten("_b"), F.flatten("_old"), lambda u, v: F.abs(u - v)), F.lit(0.0), lambda s, d: F.greatest(s, d))
        moved, state = both.agg(F.max(apart)).first()[0], new
        if moved is None or moved < 1e-4 * stats:
            break
    rows.unpersist()
    return state.withColumnRenamed("_b", "betas")


def quantile_columns(features: list[str], quantiles: list[float]) -> dict[str, Column]:
    """``q_<quantile>``: the predictions of a row from its ``betas``, put in order so that they do not cross."""
    x = F.array(*[F.col(f"`{n}`").cast("double") for n in features], F.lit(1.0))
    of = F.transform("betas", lambda b: F.aggregate(F.zip_with(x, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v))
    ordered = F.array_sort(of)
    places = np.argsort(np.argsort(quantiles))
    return {f"q_{q}": F.element_at(ordered, int(i) + 1) for q, i in zip(quantiles, places, strict=True)}


def quantile_forecast(grid: DataFrame, design: models.Design, steps: int, freq: str, quantiles: list[float], per_series: bool = True, exog: DataFrame | None = None, iterations: int = 30) -> DataFrame:
    """Direct forecasts ``series_id, step, ts, q_…`` from the end of each series, a model a quantile and step."""
    rows, names = models.direct_rows(grid, design, steps)
    ahead = models.extended(grid, steps, freq, exog, design.exog)
    origins, _ = models.direct_rows(ahead, design, steps)
    last = grid.groupBy("series_id").agg((F.max("pos") + 1).alias("pos"))
    keys = [*(["series_id"] if per_series else []), "step"]
    betas = fit_quantiles(rows.where("target is not null"), names, quantiles, keys, "target", iterations)
    out = origins.join(last, ["series_id", "pos"]).join(betas, keys)
    return out.select("series_id", F.col("step").cast("int").alias("step"), "ts", *[c.alias(n) for n, c in quantile_columns(names, quantiles).items()])
