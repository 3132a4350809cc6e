"""Residuals by predicted level and from folds: drawing, coverage where spread follows the level, and out of sample."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.plans import models
from seriesloom.plans.assistant import Assistant

DAY = datetime(2022, 1, 1)
RIDGE = {"strategy": "multi_series", "estimator": "ridge", "lags": [1, 7], "windows": [], "calendar": [], "encode_series": False}


def wavy(seed, n=560):
    """A weekly wave whose noise is as wide as its level."""
    rng = np.random.default_rng(seed)
    level = 20 + 15 * np.sin(2 * np.pi * np.arange(n) / 7)
    return level + rng.normal(size=n) * level / 8


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(f"s{i}", DAY + timedelta(days=t), float(v)) for i in range(6) for t, v in enumerate(wavy(i))]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")


def test_grids_of_levels(spark):
    rng = np.random.default_rng(0)
    pred, noise = rng.uniform(0, 10, 2000), rng.normal(size=2000)
    df = spark.createDataFrame([("a", float(p + e * p), float(p)) for p, e in zip(pred, noise, strict=True)] + [("b", 1.0, 2.0), ("b", None, 2.0), ("b", 3.0, None)], "series_id string, y double, pred double")
    got = {r.series_id: r for r in models.fold_residuals(df, 4).collect()}
    edges = np.quantile(pred, [0.25, 0.5, 0.75])
    assert np.allclose(got["a"].edges, edges) and len(got["a"].by_level) == 4
    for b in range(4):
        e = (noise * pred)[np.digitize(pred, edges) == b]
        assert np.allclose(got["a"].by_level[b], np.quantile(e, np.linspace(0, 1, models.RESIDUAL_POINTS)))
    assert got["b"].by_level == [[-1.0] * models.RESIDUAL_POINTS] * 4
    assert models.fold_residuals(df.limit(0), 4).count() == 0
    flat = models.level_quantiles(df.withColumn("_t", F.col("y")), [], 1).first()
    assert flat.edges == [] and len(flat.by_level) == 1


def test_each_path_draws_by_its_own_level():
    edges, grids = np.array([0.0, 10.0]), np.array([[1.0, 1.0], [2.0, 2.0], [3.0, 3.0]])
    draw = models.drawn_by_level(edges, grids, "x", 2, 4)
    assert draw(0, np.array([-5.0, 0.0, 5.0, 11.0])).tolist() == [1, 1, 2, 3]
    out = models.roll_forward(np.array([12.0]), np.array([1.0, 0.0]), [1], [], np.zeros((2, 0)), draw, paths=4)
    assert out.tolist() == [[15.0] * 4, [18.0] * 4]


def share(preds, low):
    """Coverage of the rows on the low or high half of the wave."""
    level = F.dayofyear("ts") * 0 + F.datediff("ts", F.lit(DAY)) % 7
    rows = preds.where("lower_bound is not null").where(level.isin(4, 5, 6) if low else level.isin(1, 2, 3))
    return rows.agg(F.avg(F.col("y").between(F.col("lower_bound"), F.col("upper_bound")).cast("double"))).first()[0]


def test_bounds_follow_the_level(panel):
    a = Assistant(panel, "ts", "y", "series_id", freq="D")
    plain = a.plan(1, interval=(0.1, 0.9), **RIDGE)
    cv = a.create_cv(plain, initial=500)
    by_level = a.refine_plan(plain, residual_bins=5)
    assert by_level.residual_bins == 5
    one, many = (a.backtest(p, cv).predictions.cache() for p in (plain, by_level))
    gap = lambda preds: share(preds, True) - share(preds, False)
    assert gap(one) > 0.25  # one width for all is too wide below and too narrow above
    assert abs(gap(many)) < 0.15 and 0.7 < share(many, True) < 0.92 and 0.68 < share(many, False) < 0.9


def test_forecasts_take_residuals_of_folds(panel):
    a = Assistant(panel, "ts", "y", "series_id", freq="D")
    plan = a.plan(7, interval=(0.1, 0.9), residual_bins=4, **RIDGE)
    resid = a.fold_residuals(plan, a.create_cv(plan, initial=450))
    assert resid.count() == 6 and resid.where(F.size("by_level") == 4).count() == 6
    seen, unseen = (a.forecast(plan, residuals=r).predictions.orderBy("series_id", "step").toPandas() for r in (None, resid))
    assert np.allclose(seen["pred"], unseen["pred"]) and not np.allclose(seen["upper_bound"], unseen["upper_bound"])
    assert (unseen["lower_bound"] < unseen["pred"]).all() and (unseen["pred"] < unseen["upper_bound"]).all()
    wide = a.forecast(plan, residuals=resid.withColumns({c: F.transform(c, lambda e: e * 3) for c in ("resid",)}).withColumn("by_level", F.transform("by_level", lambda g: F.transform(g, lambda e: e * 3)))).predictions.orderBy("series_id", "step").toPandas()
    ratio = (wide["upper_bound"] - wide["lower_bound"])[wide["step"] == 1] / (unseen["upper_bound"] - unseen["lower_bound"])[unseen["step"] == 1]
    assert np.allclose(ratio, 3)
    with pytest.raises(ValueError, match="bootstrap"):
        a.forecast(a.plan(7, **RIDGE), residuals=resid)
    with pytest.raises(ValueError, match="differenced"):
        a.fold_residuals(a.plan(7, differentiation=1, **RIDGE))


def test_an_overfitted_model_misses_more_on_folds(spark):
    """As many lags as the rows can hardly bear: what the model misses on its own training rows is too small."""
    rng = np.random.default_rng(3)
    rows = [(DAY + timedelta(days=t), float(v)) for t, v in enumerate(rng.normal(size=150) * 5 + 50)]
    a = Assistant(spark.createDataFrame(rows, "ts timestamp_ntz, y double"), "ts", "y", freq="D")
    plan = a.plan(2, strategy="recursive", estimator="ridge", lags=40, windows=[], calendar=[], alpha=1e-6, interval=(0.1, 0.9), interval_method="bootstrap")
    resid = a.fold_residuals(plan, a.create_cv(plan, initial=110, refit=False))
    width = [a.forecast(plan, residuals=r).predictions.agg(F.avg(F.col("upper_bound") - F.col("lower_bound"))).first()[0] for r in (None, resid)]
    assert width[1] > 1.15 * width[0]


def test_residuals_of_trees_by_level(panel):
    a = Assistant(panel.where("series_id < 's2'"), "ts", "y", "series_id", freq="D")
    plan = a.plan(3, interval=(0.1, 0.9), **{**RIDGE, "estimator": "gbt", "interval_method": "bootstrap", "params": {"maxIter": 8, "maxDepth": 3, "stepSize": 0.5}, "residual_bins": 3})
    assert a.forecast(plan).predictions.where("lower_bound < pred and pred < upper_bound").count() == 6
    assert a.backtest(plan, a.create_cv(plan, initial=540)).predictions.where("lower_bound is null").count() == 0
