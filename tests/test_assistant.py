from datetime import datetime, timedelta

import numpy as np
import pytest

from seriesloom.plans.assistant import Assistant
from seriesloom.plans.records import AllCandidatesFailedError

START = datetime(2023, 1, 2)


@pytest.fixture(scope="module")
def weekly(spark):
    rng = np.random.default_rng(42)
    rows = [(START + timedelta(days=i), float(100 + 0.1 * i + 5 * np.sin(2 * np.pi * i / 7) + rng.normal(scale=0.5))) for i in range(200)]
    return spark.createDataFrame(rows, "day timestamp_ntz, sales double")


def test_profile_plan_forecast_backtest(weekly):
    a = Assistant(weekly, "day", "sales")
    p = a.profile()
    assert (p.format, p.frequency, p.span, p.has_gaps, p.has_duplicates) == ("single", "D", 200, False, False)
    plan = a.plan(7, interval=(0.1, 0.9))
    assert plan.strategy == "recursive" and plan.estimator == "ridge" and 7 in plan.lags and "mape" in plan.metrics
    out = a.forecast(plan, test_size=14)
    assert out.predictions.count() == 7
    assert out.metrics.first()["mase"] < 0.6
    bt = a.backtest(plan)
    assert bt.predictions.count() > 14 and bt.metrics.first()["mae"] < 3
    assert plan.metric in plan.explanation


def test_compare_ranks_and_isolates(weekly):
    a = Assistant(weekly, "day", "sales", freq="D")
    found = a.compare([("naive", {"strategy": "recursive", "estimator": "seasonal_naive"}), ("ridge", {"estimator": "ridge", "lags": [1, 7]}), ("broken", {"lags": [190]})], 7)
    board = [r["candidate"] for r in found.leaderboard.orderBy("rank").collect()]
    assert board[-1] == "broken" and set(board) == {"naive", "ridge", "broken"} and found.best_name == board[0]
    assert found.failures[0].error_type == "ValueError"
    with pytest.raises(AllCandidatesFailedError):
        a.compare([("broken", {"lags": [190]})], 7)
    with pytest.raises(ValueError):
        a.compare([("x", {}), ("x", {})], 7)


def test_errors(spark, weekly):
    with pytest.raises(ValueError):
        Assistant(weekly, "day", "price")
    flat = spark.createDataFrame([(START + timedelta(days=i), 42.0) for i in range(60)], "day timestamp_ntz, y double")
    with pytest.raises(ValueError):
        Assistant(flat, "day", "y").profile()
    a = Assistant(weekly, "day", "sales", freq="D")
    for bad in ({"steps": 0}, {"steps": 3, "strategy": "multivariate2"}, {"steps": 3, "interval": (0.9, 0.1)}, {"steps": 3, "lags": [0]}, {"steps": 3, "windows": [("mode", 3)]}):
        with pytest.raises(ValueError):
            a.plan(**bad)


def test_panels(spark, weekly):
    long = weekly.selectExpr("day", "'a' as store", "sales").unionByName(weekly.selectExpr("day", "'b' as store", "sales * 2 as sales"))
    a = Assistant(long, "day", "sales", "store", freq="D")
    plan = a.plan(3, estimator="ridge", lags=[1, 7], windows=[])
    assert plan.strategy == "multi_series" and plan.metric == "mase"
    assert a.forecast(plan).predictions.count() == 6
    both = a.forecast(a.plan(2, strategy="multivariate", lags=2), test_size=2)
    assert both.predictions.count() == 4 and both.metrics.count() == 2
