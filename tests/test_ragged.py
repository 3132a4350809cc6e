"""Panels whose series start and end at different times: folds are stretches of time, and nothing after a cut is learned."""

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest

from seriesloom.operators import evaluation
from seriesloom.plans import models
from seriesloom.plans.assistant import Assistant
from seriesloom.sources.series import asfreq

DAY = datetime(2024, 1, 1)
RIDGE = {"strategy": "multi_series", "estimator": "ridge", "lags": [1, 7], "windows": [], "calendar": [], "encode_series": False}


def rows(series, first, n, bump=None):
    y = lambda t: 20 + 5 * math.sin(2 * math.pi * t / 7) + (t % 5) + (3.0 if series == "b" else 0.0)
    return [(series, DAY + timedelta(days=t), y(t) + (bump[1] if bump and t >= bump[0] else 0.0)) for t in range(first, first + n)]


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(rows("a", 0, 200) + rows("b", 100, 100) + rows("c", 0, 150), "series_id string, ts timestamp_ntz, y double")


@pytest.mark.parametrize("freq", ["D", "MS", "B"])
def test_positions_count_from_the_origin(spark, freq):
    starts = {"D": [DAY, DAY + timedelta(days=9)], "MS": [DAY, datetime(2024, 10, 1)], "B": [DAY, datetime(2024, 1, 12)]}[freq]
    ends = {"D": 14, "MS": 420, "B": 25}[freq]
    df = spark.createDataFrame([(s, t, 1.0) for s, first in zip("ab", starts) for t in (first, DAY + timedelta(days=ends))], "series_id string, ts timestamp_ntz, y double")
    if freq == "MS":
        df = df.withColumn("ts", df.ts.cast("date")).selectExpr("series_id", "trunc(ts, 'month')::timestamp_ntz AS ts", "y")
    grid = asfreq(df, freq, origin=DAY).toPandas()
    by_ts = grid.groupby("ts")["pos"].nunique()
    assert (by_ts == 1).all() and grid["pos"].min() == 0
    b = grid[grid["series_id"] == "b"].sort_values("ts")
    assert b["pos"].iloc[0] == 9 and b["pos"].tolist() == list(range(9, 9 + len(b)))


@pytest.mark.parametrize("choice", [RIDGE, RIDGE | {"scale": True}, {"estimator": "seasonal_naive"}, RIDGE | {"estimator": "decision_tree"}])
def test_late_series_are_predicted(panel, choice):
    a = Assistant(panel, "ts", "y", "series_id", freq="D")
    plan = a.plan(7, interval=(0.1, 0.9), **choice)
    cv = a.create_cv(plan, initial=100)
    result = a.backtest(plan, cv)
    got = result.predictions.toPandas()
    count = got.groupby("series_id")["fold"].nunique()
    assert count["a"] == 15 and count["b"] in (13, 14) and count["c"] == 8
    assert got["pred"].notna().all() and got["lower_bound"].notna().all() and (got["lower_bound"] <= got["upper_bound"]).all()
    first = DAY + timedelta(days=100)
    assert all(t == first + timedelta(days=7 * f + s - 1) for t, f, s in zip(got["ts"], got["fold"], got["step"], strict=True))
    scores = result.metrics.toPandas().set_index("series_id")
    assert set(scores.index) == {"a", "b", "c"} and scores["mase"].notna().all()


@pytest.mark.parametrize("choice", [RIDGE | {"scale": True}, RIDGE | {"estimator": "decision_tree", "scale": True}])
def test_nothing_after_the_cut_is_learned(spark, panel, choice):
    """A jump in the late series after day 140 changes no prediction made before."""
    jump = spark.createDataFrame(rows("a", 0, 200) + rows("b", 100, 100, (140, 500.0)) + rows("c", 0, 150), "series_id string, ts timestamp_ntz, y double")
    out = []
    for df in (panel, jump):
        a = Assistant(df, "ts", "y", "series_id", freq="D")
        plan = a.plan(7, **choice)
        preds = a.backtest(plan, a.create_cv(plan, initial=126)).predictions
        out.append({(r.series_id, r.fold, r.step): round(r.pred, 9) for r in preds.collect()})
    early = [k for k in out[0] if k[1] < 3]  # folds that train on less than 141 days
    assert ("b", 2, 1) in early and all(out[0][k] == out[1][k] for k in early)
    assert any(out[0][k] != out[1].get(k) for k in out[0] if k[1] >= 3)


def test_series_without_enough_rows_are_named(spark):
    df = spark.createDataFrame(rows("a", 0, 120) + rows("b", 117, 3), "series_id string, ts timestamp_ntz, y double")
    a = Assistant(df, "ts", "y", "series_id", freq="D")
    plan = a.plan(5, **RIDGE)
    with pytest.warns(UserWarning, match="1 of 2 series"):
        a.backtest(plan)


def test_one_moment_splits_all_series(panel):
    a = Assistant(panel, "ts", "y", "series_id", freq="D")
    plan = a.plan(7, **RIDGE)
    got = a.forecast(plan, test_size=0.1).predictions.toPandas()
    starts = got.groupby("series_id")["ts"].min()
    assert starts["a"] == starts["b"] == DAY + timedelta(days=180)


def test_training_until_a_date(panel):
    a = Assistant(panel, "ts", "y", "series_id", freq="D")
    plan = a.plan(7, **RIDGE)
    assert a.create_cv(plan, initial=date(2024, 4, 29)).initial == a.create_cv(plan, initial=datetime(2024, 4, 29)).initial == 120
    with pytest.raises(ValueError, match="training ends"):
        a.create_cv(plan, initial=date(2023, 4, 29))


def test_multivariate_needs_one_start(spark):
    df = spark.createDataFrame(rows("a", 0, 100) + rows("b", 20, 100), "series_id string, ts timestamp_ntz, y double")
    with pytest.raises(ValueError, match="start together"):
        Assistant(df, "ts", "y", "series_id", freq="D").plan(3, strategy="multivariate")


def test_cuts_of_late_series(spark):
    grid = asfreq(spark.createDataFrame(rows("a", 0, 50) + rows("b", 31, 19), "series_id string, ts timestamp_ntz, y double"), "D", origin=DAY)
    folds = evaluation.cv_folds(spark, 50, 20, 5)
    assert {r.series_id: r.cut for r in models.first_cuts(grid, folds, 4).collect()} == {"a": 20, "b": 35}
    assert models.first_rows(grid, models.first_cuts(grid, folds, 4)).where("series_id = 'b'").count() == 4
    assert np.isclose(models.first_cuts(grid, folds, 90).agg({"cut": "min"}).first()[0], 45)
