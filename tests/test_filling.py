"""Filling missing features, one column a series, metrics that take training values."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from seriesloom.operators import evaluation, features
from seriesloom.plans.assistant import Assistant

DAY = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def matrix(spark):
    rows = [(s, i, None if i in (0, 3, 4, 9) or s == "none" else float(i * k), float(i)) for k, s in enumerate(("a", "b", "none"), 1) for i in range(10)]
    return spark.createDataFrame(rows, "series_id string, pos long, x double, y double").withColumnRenamed("x", "roll.x")


@pytest.mark.parametrize("method", ["mean", "median", "ffill", "bfill", 7, -1.5])
def test_fills_equal_pandas(matrix, method):
    got = features.fill_features(matrix, ["roll.x"], method).toPandas().sort_values(["series_id", "pos"]).reset_index(drop=True)
    plain = matrix.toPandas().sort_values(["series_id", "pos"]).reset_index(drop=True)
    by = plain.groupby("series_id")["roll.x"]
    want = {"mean": lambda: plain["roll.x"].fillna(by.transform("mean")), "median": lambda: plain["roll.x"].fillna(by.transform("median")), "ffill": by.ffill, "bfill": by.bfill}.get(method, lambda: plain["roll.x"].fillna(method))()
    assert np.allclose(got["roll.x"].astype(float), want.astype(float), equal_nan=True) and (got["y"] == plain["y"]).all()


def test_unknown_fills_are_refused(matrix):
    for bad in ("zero", True, None):
        with pytest.raises(ValueError):
            features.fill_features(matrix, ["roll.x"], bad)


def test_one_column_a_series(matrix):
    out, names = features.series_onehot(matrix, ["a", "b"])
    got = out.toPandas()
    assert names == ["series_is_0", "series_is_1"]
    assert (got[names].to_numpy() == pd.get_dummies(got["series_id"])[["a", "b"]].to_numpy()).all()


def test_metrics_take_training_values(spark):
    evaluation.register_metric("against_mean", trained=lambda y, pred, past: np.abs(y - pred).mean() / np.abs(y - past.mean()).mean())
    rng = np.random.default_rng(0)
    y = {s: 10 + k + rng.normal(size=120) for k, s in enumerate("ab")}
    df = spark.createDataFrame([(s, DAY + timedelta(days=i), float(v)) for s, values in y.items() for i, v in enumerate(values)], "series_id string, ts timestamp_ntz, y double")
    a = Assistant(df, "ts", "y", "series_id", freq="D")
    plan = a.plan(5, estimator="ridge", lags=[1], windows=[], calendar=[], metric="against_mean", encode_series=False)
    out = a.forecast(plan, test_size=5)
    preds = out.predictions.toPandas()
    for r in out.metrics.collect():
        part = preds[preds["series_id"] == r.series_id].sort_values("step")
        truth = y[r.series_id]
        assert r.against_mean == pytest.approx(np.abs(truth[115:] - part["pred"].to_numpy()).mean() / np.abs(truth[115:] - truth[:115].mean()).mean())
    assert a.backtest(plan, a.create_cv(plan, initial=100)).metrics.where("against_mean is not null").count() == 2
    with pytest.raises(ValueError, match="training rows"):
        evaluation.evaluate(out.predictions.withColumn("y", out.predictions.pred), ["against_mean"])
    with pytest.raises(ValueError):
        evaluation.register_metric("two", lambda y, p: y, trained=lambda y, p, t: 0)
