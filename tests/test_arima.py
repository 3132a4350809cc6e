"""Orders and coefficients of simulated series, forecasts against plain recursion, bounds against coverage."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import evaluation
from seriesloom.plans import arima
from seriesloom.plans.assistant import Assistant

DAY = datetime(2020, 1, 1)


def simulate(phi, theta, n=2500, seed=0, d=0, scale=1.0):
    rng = np.random.default_rng(seed)
    e = rng.normal(scale=scale, size=n + 100)
    z = np.zeros(n + 100)
    for t in range(len(z)):
        z[t] = e[t] + sum(p * z[t - k] for k, p in phi.items() if t >= k) + sum(q * e[t - k] for k, q in theta.items() if t >= k)
    z = z[100:] + 3
    for _ in range(d):
        z = np.cumsum(z)
    return z


def frame(spark, **series):
    rows = [(s, DAY + timedelta(days=i), i, float(v)) for s, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, pos long, y double").repartition(4)


def test_orders_and_coefficients_of_simulated_series(spark):
    df = frame(spark, ar2=simulate({1: 0.5, 2: 0.3}, {}, seed=1), ma1=simulate({}, {1: 0.7}, seed=2), arma=simulate({1: 0.7}, {1: 0.4}, seed=3), noise=simulate({}, {}, seed=4))
    fits, _ = arima.fit_arima(df, max_p=3, max_q=2)
    got = {r.series_id: r for r in fits.collect()}
    assert (got["ar2"].p, got["ar2"].q) == (2, 0) and np.allclose(got["ar2"].beta[:2], [0.5, 0.3], atol=0.05)
    assert (got["ma1"].p, got["ma1"].q) == (0, 1) and abs(got["ma1"].beta[3] - 0.7) < 0.06
    assert (got["arma"].p, got["arma"].q) == (1, 1) and abs(got["arma"].beta[0] - 0.7) < 0.06 and abs(got["arma"].beta[3] - 0.4) < 0.08
    assert got["noise"].p + got["noise"].q == 0 and abs(got["noise"].beta[-1] - 3) < 0.1
    assert all(abs(r.sigma - 1) < 0.06 for r in got.values())


def test_seasonal_terms_are_found(spark):
    df = frame(spark, a=simulate({7: 0.8}, {}, seed=5), b=simulate({1: 0.5}, {}, seed=6))
    got = {r.series_id: r for r in arima.fit_arima(df, season=7, max_p=1, max_q=1)[0].collect()}
    assert got["a"].sp == 1 and abs(got["a"].beta[1] - 0.8) < 0.05 and got["b"].sp == 0 and got["b"].p == 1


def test_differencing_of_least_spread(spark):
    assert arima.choose_difference(frame(spark, a=simulate({1: 0.3}, {}))) == 0
    assert arima.choose_difference(frame(spark, a=simulate({1: 0.3}, {}, d=1), b=simulate({}, {}, d=1, seed=9))) == 1


@pytest.mark.parametrize("d, seasonal", [(0, False), (1, False), (2, False), (0, True), (1, True)])
def test_forecasts_equal_a_plain_recursion(spark, d, seasonal):
    y = simulate({1: 0.6}, {1: 0.3}, n=300, seed=7, d=d)
    y = y + 10 * np.sin(2 * np.pi * np.arange(300) / 7) if seasonal else y
    df = frame(spark, a=y)
    tried = [(1, 1, 0, 0)]
    season = 7 if seasonal else 0
    got = [r.pred for r in arima.arima_forecast(df, 9, "D", d, season, seasonal_difference=seasonal, tried=tried).orderBy("step").collect()]
    fits, rows = arima.fit_arima(df, d, season, seasonal_difference=seasonal, tried=tried)
    beta, last = fits.first().beta, rows.orderBy(F.desc("pos")).first()
    z, e, ahead = last["_z"], last["_e"], []
    for _ in range(9):
        z, e = beta[0] * z + beta[1] * e + beta[2], 0.0
        ahead.append(z)
    values = list(y)
    for v in ahead:  # z = (1 - B)^d (1 - B^7) y, solved for the newest y
        poly = np.array([1.0])
        for _ in range(d):
            poly = np.convolve(poly, [1, -1])
        if seasonal:
            poly = np.convolve(poly, [1, 0, 0, 0, 0, 0, 0, -1])
        values.append(v - sum(c * values[-k] for k, c in enumerate(poly) if k))
    assert np.allclose(got, values[-9:])


def test_bounds_cover_what_comes(spark):
    truth, series = {}, {}
    for i in range(60):
        y = simulate({1: 0.6}, {}, n=460, seed=100 + i, d=1, scale=2.0)
        series[f"s{i}"], truth[f"s{i}"] = y[:450], y[450:]
    out = arima.arima_forecast(frame(spark, **series), 10, "D", 1, max_p=2, max_q=1, interval=(0.1, 0.9)).collect()
    inside = [r.lower_bound <= truth[r.series_id][r.step - 1] <= r.upper_bound for r in out]
    assert len(out) == 600 and 0.72 < np.mean(inside) < 0.88
    first = next(r for r in out if r.step == 1)
    assert first.ts == DAY + timedelta(days=450)


def test_response_of_known_models():
    assert np.allclose(arima.response(np.array([0.5, 0.0]), [1], [], 0, 0, 4), [1, 0.5, 0.25, 0.125])
    assert np.allclose(arima.response(np.array([0.4, 0.0]), [], [1], 0, 0, 3), [1, 0.4, 0])
    assert np.allclose(arima.response(np.array([0.0]), [], [], 1, 0, 3), [1, 1, 1])
    assert np.allclose(arima.response(np.array([0.0]), [], [], 0, 2, 5), [1, 0, 1, 0, 1])


def test_nothing_after_the_first_range_is_learned(spark):
    y = simulate({1: 0.6}, {1: 0.3}, n=300, seed=8)
    jump = y.copy()
    jump[240:] += 100
    folds = evaluation.cv_folds(spark, 300, 200, 10)
    got = [{(r.fold, r.step): r.pred for r in arima.arima_forecast(frame(spark, a=v), 10, "D", 0, folds=folds, tried=[(1, 1, 0, 0)]).collect()} for v in (y, jump)]
    assert len(got[0]) == 100 and all(np.isclose(got[0][k], got[1][k]) for k in got[0] if k[0] <= 4)


def test_short_constant_and_gappy_series(spark):
    df = frame(spark, short=[1.0, 2.0, 3.0], flat=[5.0] * 80, ok=simulate({1: 0.5}, {}, n=200))
    df = df.withColumn("y", F.when((F.col("series_id") != "ok") | (F.col("pos") % 50 != 20), F.col("y")))
    out = {r.series_id: r.pred for r in arima.arima_forecast(df, 1, "D", 0, max_p=1, max_q=1).collect()}
    assert "short" not in out and abs(out["flat"] - 5) < 1e-6 and "ok" in out


def test_the_assistant_runs_it(spark):
    y = simulate({1: 0.6}, {}, n=200, seed=11, d=1)
    a = Assistant(frame(spark, a=y).drop("series_id", "pos"), "ts", "y", freq="D")
    plan = a.plan(6, strategy="statistical", estimator="arima", interval=(0.1, 0.9), params={"max_p": 2, "max_q": 1})
    out = a.forecast(plan, test_size=6)
    assert out.predictions.where("lower_bound < pred and pred < upper_bound").count() == 6 and out.metrics.count() == 1
    back = a.backtest(plan, a.create_cv(plan, initial=140))
    assert back.predictions.count() == 60 and back.metrics.first()["mae"] < 60
    board = a.compare([("arima", {"strategy": "statistical", "estimator": "arima"}), ("hw", {"strategy": "statistical"})], 6)
    assert board.leaderboard.where("value is not null").count() == 2


def test_orders_that_grow_without_bound_are_left_out():
    assert arima.growth(np.array([1.1, 0.0]), [1]) == pytest.approx(1.1) and arima.growth(np.array([0.0]), []) == 0
    assert arima.growth(np.array([0.0, 0.81, 0.0]), [1, 2]) == pytest.approx(0.9)
    y = 1.05 ** np.arange(200.0)
    x = np.stack([y[:-1], y[1:], np.ones(199)], 1)
    found = arima.best_order((x.T @ x).ravel(), arima.orders(1, 0), [1], [], 0)
    assert found[0] == 0 and arima.best_order((x.T @ x).ravel(), [(1, 0, 0, 0)], [1], [], 0)[0] == 1
