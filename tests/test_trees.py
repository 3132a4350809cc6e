"""Boosting against a plain booster, walks against plain recursion, recursive forecasts against a plain loop."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.plans import models, trees
from seriesloom.plans.assistant import Assistant
from seriesloom.operators import evaluation
from seriesloom.sources.series import asfreq

DAY = datetime(2024, 1, 1)
PARAMS = {"maxIter": 10, "maxDepth": 3, "stepSize": 0.3, "maxBins": 64, "l2": 1.0, "minRows": 3}


def plain_boost(x, y, w, maxIter, maxDepth, stepSize, maxBins, l2, minRows):
    """Exact greedy boosting over all thresholds, missing values to either side."""
    base = float((y * w).sum() / w.sum())
    values = [np.unique(v[~np.isnan(v)]) for v in x.T]
    pred, grown = np.full(len(y), base), []

    def grow(rows, depth):
        g, h = float(((pred - y) * w)[rows].sum()), float(w[rows].sum())
        leaf = {"value": -stepSize * g / (h + l2)}
        if depth == maxDepth:
            return leaf
        best = None
        for f in range(x.shape[1]):
            v = x[rows, f]
            for t in values[f]:
                for side in (True, False):
                    left = np.where(np.isnan(v), side, v <= t)
                    a, b = rows[left], rows[~left]
                    ha, hb = w[a].sum(), w[b].sum()
                    if ha < minRows or hb < minRows:
                        continue
                    ga, gb = ((pred - y) * w)[a].sum(), ((pred - y) * w)[b].sum()
                    gain = round(float(ga**2 / (ha + l2) + gb**2 / (hb + l2) - g**2 / (h + l2)), 9)
                    if best is None or gain > best[0]:
                        best = (gain, f, t, side, a, b)
        if best is None or best[0] <= 1e-9:
            return leaf
        _, f, t, side, a, b = best
        return leaf | {"f": f, "t": t, "side": side, "left": grow(a, depth + 1), "right": grow(b, depth + 1)}

    for _ in range(maxIter):
        grown.append(grow(np.arange(len(y)), 0))
        pred = pred + np.array([plain_walk(grown[-1], r) for r in x])
    return base, grown, pred


def plain_walk(node, row):
    while "f" in node:
        v = row[node["f"]]
        node = node["left"] if (node["side"] if v is None or math.isnan(v) else v <= node["t"]) else node["right"]
    return node["value"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 30, 400), rng.integers(0, 4, 400), rng.integers(0, 50, 400)], 1).astype(float)
    y = np.where(x[:, 0] > 12, 5.0, 0.0) + x[:, 1] ** 2 + rng.normal(size=400)
    x[rng.random(x.shape) < 0.15] = np.nan
    y += np.where(np.isnan(x[:, 2]), 4.0, 0.0)  # what is missing says something
    return x, y, rng.integers(0, 4, 400).astype(float)


def frame(spark, x, y, w):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], float(t), float(k)) for i, (r, t, k) in enumerate(zip(x, y, w, strict=True))]
    return spark.createDataFrame(rows, "pos long, a double, bc double, d double, y double, w double").withColumnRenamed("bc", "b.c").repartition(3)


@pytest.mark.parametrize("weighted", [False, True])
def test_boosting_equals_a_plain_booster(spark, data, weighted):
    x, y, w = data
    w = w if weighted else np.ones(len(y))
    df = frame(spark, x, y, w)
    got = trees.boost(df, ["a", "b.c", "d"], weight="w" if weighted else None, **PARAMS)
    base, grown, pred = plain_boost(x, y, w, **PARAMS)
    assert got.base[0] == pytest.approx(base) and len(got.roots[0]) == len(grown)
    assert np.allclose(got.predict(x), pred)
    out = got.transform(df, ["a", "b.c", "d"]).orderBy("pos").toPandas()
    assert np.allclose(out["pred"], pred)
    assert got.table(spark).where("feature >= 0 and not missing_left").count() > 0
    assert np.mean((pred - y) ** 2) < 0.2 * np.var(y)


def test_models_of_ranges_grow_side_by_side(spark, data, monkeypatch):
    x, y, w = data
    df = frame(spark, x, y, w)
    ranges = [(0, 150), (0, 300), (100, 400)]
    params = PARAMS | {"maxIter": 3}
    together = trees.boost(df, ["a", "b.c", "d"], ranges=ranges, **params)
    monkeypatch.setattr(trees, "MODELS_AT_ONCE", 2)
    monkeypatch.setattr(trees, "TREES_A_STATE", 2)
    chunked = trees.boost(df, ["a", "b.c", "d"], ranges=ranges, **params)
    for m, (a, b) in enumerate(ranges):
        want = plain_boost(x[a:b], y[a:b], np.ones(b - a), **params)
        plain = np.array([want[0] + sum(plain_walk(t, r) for t in want[1]) for r in x])
        assert np.allclose(together.predict(x, m), plain) and np.allclose(chunked.predict(x, m), plain)


def test_few_bins_and_degenerate_rows(spark):
    rng = np.random.default_rng(1)
    x = np.stack([rng.normal(size=3000), np.full(3000, np.nan), np.full(3000, 2.0)], 1)
    y = np.sin(x[:, 0])
    df = frame(spark, x, y, np.ones(3000))
    got = trees.boost(df, ["a", "b.c", "d"], maxBins=16, maxIter=15, maxDepth=3, stepSize=0.3)
    assert np.mean((got.predict(x) - y) ** 2) < 0.01
    assert set(got.feature[got.feature >= 0]) == {0}
    empty = trees.boost(df.limit(0), ["a"], maxIter=2)
    assert empty.predict(np.zeros((2, 1))).tolist() == [0, 0]
    lone = trees.boost(df.withColumn("y", F.lit(3.0)), ["a"], maxIter=2)
    assert np.allclose(lone.predict(np.zeros((1, 1))), 3)


@pytest.mark.parametrize("kind", ["spark_gbt", "random_forest", "decision_tree"])
def test_trees_of_spark_as_arrays(spark, data, kind):
    x, y, w = data
    df = frame(spark, x, y, w)
    params = {"maxDepth": 3} | ({"maxIter": 4} if kind == "spark_gbt" else {"numTrees": 5} if kind == "random_forest" else {})
    learner = models.make_estimator(kind, **params)
    rows = models._complete(df, ["a", "b.c", "d"], False)
    model = learner.fit(rows, ["a", "b.c", "d"], "y", None)
    want = learner.predict(model, rows).orderBy("pos").toPandas()["pred"]
    assert np.allclose(trees.spark_ensemble(model[1]).predict(x), want)
    assert np.allclose(models.fit_trees(df, ["a", "b.c", "d"], kind=kind, params=params).predict(x), want)


def panel(spark, gaps=False, n=150):
    rng = np.random.default_rng(3)
    rows = [(s, DAY + timedelta(days=i), float(round(20 + 6 * math.sin(2 * math.pi * i / 7) + (5 if s == "b" else 0) + rng.normal(), 2))) for s in "ab" for i in range(n)]
    if gaps:
        rows = [r for i, r in enumerate(rows) if i % 11 != 5 or i > 290]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")


@pytest.mark.parametrize("gaps", [False, True])
def test_recursion_equals_a_plain_loop(spark, gaps):
    grid = asfreq(panel(spark, gaps), "D")
    design = models.Design([1, 2, 7], [("mean", 3)], ["day_of_week"])
    matrix, names, target = models.design_matrix(grid, design)
    fitted = models.fit_trees(matrix, names, params=PARAMS)
    got = models.recursive_forecast(models.tails_at_end(grid, design.reach), fitted, design.lags, design.windows, 9, "D", ["day_of_week"])
    pdf = grid.orderBy("pos").toPandas()
    for s, part in pdf.groupby("series_id"):
        past, at = part["y"].tolist(), part["ts"].max()
        for r in got.where(F.col("series_id") == s).orderBy("step").collect():
            at += timedelta(days=1)
            last = np.array(past[-3:], float)
            x = [past[-1], past[-2], past[-7], np.nan if np.isnan(last).any() else last.mean(), float(at.weekday())]
            past.append(fitted.predict(np.array([x], float))[0])
            assert r.ts == at and r.pred == pytest.approx(past[-1])


@pytest.mark.parametrize("choice", [{"params": {"maxIter": 5}}, {"params": {"maxIter": 5}, "interval": (0.1, 0.9)}, {"interval": (0.1, 0.9), "interval_method": "bootstrap", "params": {"maxIter": 3}, "differentiation": 1}, {"estimator": "decision_tree", "params": {"maxDepth": 3}}])
def test_the_assistant_forecasts_recursively_by_trees(spark, choice):
    a = Assistant(panel(spark, gaps=True), "ts", "y", "series_id", freq="D")
    plan = a.plan(5, lags=[1, 7], windows=[("mean", 7)], calendar=[], **choice)
    assert plan.strategy == "multi_series" and plan.estimator == choice.get("estimator", "gbt")
    assert not any("direct" in w for w in plan.warnings)
    out = a.forecast(plan, test_size=10)
    got = out.predictions.toPandas()
    assert len(got) == 10 and got["pred"].notna().all()
    if plan.interval:
        assert (got["lower_bound"] <= got["upper_bound"]).all()
    assert out.metrics.where(f"mae < {8 if plan.differentiation else 4}").count() == 2  # three small trees hardly move a difference


def test_backtests_refit_and_predict_every_fold(spark):
    grid = asfreq(panel(spark), "D")
    folds = evaluation.cv_folds(spark, 150, 120, 7, refit=2)
    design = models.Design([1, 7])
    got = models.backtest_trees(grid, folds, design, "D", params=PARAMS, interval=(0.1, 0.9)).toPandas()
    assert sorted(got["fold"].unique()) == [0, 1, 2, 3, 4] and len(got) == 60 and got["lower_bound"].notna().all()
    matrix, names, _ = models.design_matrix(grid, design)
    for fold, cut in ((1, 120), (2, 134)):
        fitted = models.fit_trees(matrix.where(F.col("pos") < cut), names, params=PARAMS)
        at = 120 + 7 * fold
        past = [r.y for r in grid.where((F.col("series_id") == "b") & (F.col("pos") < at)).orderBy("pos").collect()]
        for r in got[(got["series_id"] == "b") & (got["fold"] == fold)].sort_values("step").itertuples():
            past.append(fitted.predict(np.array([[past[-1], past[-7]]]))[0])
            assert r.pred == pytest.approx(past[-1])


def test_direct_boosting_of_all_folds(spark):
    grid = asfreq(panel(spark, gaps=True), "D")
    folds = evaluation.cv_folds(spark, 150, 120, 3, stride=10)
    got = models.backtest_direct(grid, folds, models.Design([1, 7]), 3, per_series=False, estimator="gbt", params=PARAMS, drop_null=False, interval=(0.1, 0.9)).toPandas()
    assert sorted(got["fold"].unique()) == [0, 1, 2] and got["pred"].notna().all() and got["upper_bound"].notna().all()
    rows, names = models.direct_rows(grid, models.Design([1, 7]), 3)
    one = models.fit_trees(rows.where("target is not null and target_pos < 130"), [*names, "step"], params=PARAMS, target="target")
    want = one.transform(rows.where("pos = 130"), [*names, "step"]).toPandas().set_index(["series_id", "step"])["pred"]
    mine = got[got["fold"] == 1].set_index(["series_id", "step"])["pred"]
    assert np.allclose(mine.sort_index(), want.sort_index()[mine.sort_index().index])
