"""Exogenous columns, differencing, refits, intervals, estimators: against numpy and against each other."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom import cli
from seriesloom.operators import evaluation, features
from seriesloom.plans import models, search
from seriesloom.plans.assistant import Assistant
from seriesloom.plans.records import DataProfile, Explainable, ForecastPlan

START = datetime(2023, 1, 2)


def day(i):
    return START + timedelta(days=i)


@pytest.fixture(scope="module")
def shop(spark):
    """Sales that follow a promotion and a kind of day, on 160 days; and 10 days ahead."""
    rng = np.random.default_rng(0)
    rows, y = [], 50.0
    for i in range(170):
        promo, kind = float(rng.integers(0, 2)), "abc"[i % 3]
        y = 0.5 * y + 20 + 8 * promo + {"a": 0, "b": 3, "c": -2}[kind] + rng.normal(scale=0.1)
        rows.append((day(i), y, promo, kind))
    df = spark.createDataFrame(rows, "day timestamp_ntz, sales double, promo double, kind string")
    return df.where(F.col("day") < day(160)), df.where(F.col("day") >= day(160))


def test_exogenous_columns_reach_the_forecast(shop):
    past, ahead = shop
    a = Assistant(past, "day", "sales")
    assert a.exog == ["promo", "kind"] and a.categorical == ["kind"]
    plan = a.plan(10, estimator="ridge", lags=[1], windows=[], calendar=[])
    with pytest.raises(ValueError, match="rows ahead"):
        a.forecast(plan)
    with pytest.raises(ValueError, match="10 rows"):
        a.forecast(plan, exog=ahead.limit(3))
    with pytest.raises(ValueError, match="lack"):
        a.forecast(plan, exog=ahead.drop("promo"))
    truth = [r["sales"] for r in ahead.orderBy("day").collect()]
    got = [r["pred"] for r in a.forecast(plan, exog=ahead).predictions.orderBy("step").collect()]
    assert np.abs(np.array(got) - truth).max() < 1.5
    other = [r["pred"] for r in a.forecast(plan, exog=ahead.withColumn("promo", 1 - F.col("promo"))).predictions.orderBy("step").collect()]
    assert abs(other[0] - got[0]) > 6  # later steps carry earlier promotions on
    bare = Assistant(past, "day", "sales", exog=[])
    with pytest.raises(ValueError, match="no exogenous"):
        bare.forecast(bare.plan(3, estimator="ridge", lags=[1]), exog=ahead)
    with pytest.raises(ValueError, match="own"):
        a.forecast(plan, test_size=10, exog=ahead)


@pytest.mark.parametrize("estimator", ["ridge", "decision_tree", "seasonal_naive"])  # gbt: the README's example
def test_every_estimator_forecasts_scores_and_backtests(shop, estimator):
    past, ahead = shop
    a = Assistant(past, "day", "sales")
    plan = a.plan(5, strategy="direct", estimator=estimator, lags=[1, 2], windows=[("ewm", 3)], calendar=[], interval=(0.1, 0.9), params={"maxDepth": 2} if estimator == "decision_tree" else None)
    preds = a.forecast(plan, exog=ahead if plan.exog else None).predictions
    rows = preds.collect()
    assert len(rows) == 5 and all(r["lower_bound"] <= r["upper_bound"] for r in rows) and {r["ts"] for r in rows} == {day(160 + i) for i in range(5)}
    if estimator != "ridge":  # scored elsewhere
        assert a.forecast(plan, test_size=10).metrics.first()["mae"] > 0
    back = a.backtest(plan, a.create_cv(plan, refit=False))
    found = back.predictions.toPandas()
    assert found["fold"].nunique() >= 2 and found["lower_bound"].notna().all() and (found["lower_bound"] <= found["upper_bound"]).all()
    assert (found["y"] - found["pred"]).abs().mean() < (2.5 if estimator == "ridge" else 20)
    assert isinstance(back, Explainable) and "backtest" in back.explain()


def test_statistical_multivariate_and_panel_backtests(spark):
    rng = np.random.default_rng(1)
    rows = [(s, day(i), float(10 * k + 3 * np.sin(2 * np.pi * i / 7) + rng.normal(scale=0.2))) for k, s in enumerate("xyz", 1) for i in range(120)]
    long = spark.createDataFrame(rows, "store string, day timestamp_ntz, sales double")
    a = Assistant(long, "day", "sales", "store")
    multi = a.plan(4, strategy="multivariate", lags=[1, 7], interval=(0.1, 0.9))
    got = a.backtest(multi)
    assert got.metrics.count() == 3 and got.metrics.agg(F.max("mae")).first()[0] < 1
    assert a.forecast(multi).predictions.where("lower_bound <= pred and pred <= upper_bound").count() == 12
    panel = a.plan(4, estimator="ridge", lags=[1, 7], windows=[], interval=(0.1, 0.9))
    assert panel.encode_series and panel.scale and panel.interval_method == "bootstrap"
    assert a.backtest(panel).metrics.agg(F.max("mae")).first()[0] < 1
    assert a.forecast(panel).predictions.where("lower_bound <= upper_bound").count() == 12
    one = Assistant(long.where("store = 'x'"), "day", "sales", exog=[])
    stat = one.plan(4, strategy="statistical", interval=(0.1, 0.9))
    back = one.backtest(stat, one.create_cv(stat, refit=2))
    assert back.metrics.first()["mae"] < 1 and stat.interval_method == "native"
    widths = [r["w"] for r in one.forecast(stat).predictions.orderBy("step").select((F.col("upper_bound") - F.col("lower_bound")).alias("w")).collect()]
    assert widths == sorted(widths)
    assert [n for n, _ in one.candidates()] == ["recursive_ridge", "direct_ridge", "statistical_holt_winters", "seasonal_naive"]
    board = one.compare(one.candidates()[2:], 4)
    assert board.leaderboard.count() == 2 and not board.failures


def test_the_readme_example(spark):
    rng = np.random.default_rng(2)
    rows = [(s, day(i), float(100 + i / 10 + 5 * np.sin(2 * np.pi * i / 7) + rng.normal())) for s in "ab" for i in range(400)]
    a = Assistant(spark.createDataFrame(rows, "store string, day timestamp_ntz, sales double"), ts="day", target="sales", series_id="store", fill="interpolate")
    plan = a.plan(steps=14, interval=(0.1, 0.9), params={"maxIter": 2, "maxDepth": 2})
    assert plan.estimator == "gbt" and plan.interval_method == "conformal"
    assert a.forecast(plan, test_size=0.2).metrics.count() == 2
    assert a.backtest(plan, a.create_cv(plan, refit=False)).metrics.count() == 2


def _simulated(n=80, seed=5):
    rng = np.random.default_rng(seed)
    return np.cumsum(rng.normal(size=n)) + 30


def test_refit_keeps_the_last_model(spark):
    y = _simulated()
    grid = spark.createDataFrame([("s", day(i), i, float(v)) for i, v in enumerate(y)], "series_id string, ts timestamp_ntz, pos long, y double")

    def by_hand(train_to, model_to, steps):
        x, t = y[: model_to - 1], y[1:model_to]
        k = ((x - x.mean()) @ (t - t.mean())) / (((x - x.mean()) ** 2).sum() + 1)
        out, last = [], y[train_to - 1]
        for _ in range(steps):
            last = k * last + t.mean() - k * x.mean()
            out.append(last)
        return out

    for refit, fits in ((True, [50, 55, 60, 65, 70, 75]), (False, [50] * 6), (2, [50, 50, 60, 60, 70, 70])):
        folds = evaluation.cv_folds(spark, 80, 50, 5, refit=refit)
        got = models.backtest_ridge(grid, folds, [1], [], "D").orderBy("fold", "step").toPandas()
        want = [v for i, m in enumerate(fits) for v in by_hand(50 + 5 * i, m, 5)]
        np.testing.assert_allclose(got["pred"], want, rtol=1e-8)


def test_differencing_and_weights(spark):
    y = 5 + 2.0 * np.arange(60)
    grid = spark.createDataFrame([("s", day(i), i, float(v), 1.0 if i < 30 else 0.0) for i, v in enumerate(y)], "series_id string, ts timestamp_ntz, pos long, y double, w double")
    matrix, names, target = models.design_matrix(grid, models.Design([1], differentiation=1))
    betas = models.fit_ridge(matrix, names, ["series_id"], target=target)
    out = models.recursive_forecast(models.tails_at_end(grid, 2), betas, [1], [], 4, "D", differentiation=1).orderBy("step").toPandas()
    np.testing.assert_allclose(out["pred"], 5 + 2.0 * np.arange(60, 64))
    np.testing.assert_allclose(features.integrate(np.diff(y, 2)[-3:], y[:-3], 2), y[-3:])
    bent = grid.withColumn("y", F.when(F.col("pos") < 30, F.col("pos")).otherwise(100.0))
    half = models.fit_ridge(features.train_matrix(bent.where("pos < 30"), [1]), ["lag_1"], ["series_id"]).first()["beta"]
    weighted = models.fit_ridge(features.train_matrix(bent, [1]), ["lag_1"], ["series_id"], weight="w").first()["beta"]
    np.testing.assert_allclose(weighted, half)


def test_bootstrap_draws_the_residuals():
    resid = np.array([-1.0, 0.0, 5.0])
    noise = models.drawn(resid, "1|s", 4, 3000)
    assert set(np.unique(noise)) == set(resid) and abs(noise.mean() - resid.mean()) < 0.1
    assert (noise == models.drawn(resid, "1|s", 4, 3000)).all() and (noise != models.drawn(resid, "1|t", 4, 3000)).any()


def test_intervals_cover(spark):
    rng = np.random.default_rng(9)
    y = [0.0]
    for _ in range(500):
        y.append(0.7 * y[-1] + rng.exponential() - 1)
    a = Assistant(spark.createDataFrame([(day(i), float(v)) for i, v in enumerate(y)], "day timestamp_ntz, y double"), "day", "y")
    for method in ("bootstrap", "conformal"):
        plan = a.plan(1, estimator="ridge", lags=[1], windows=[], calendar=[], interval=(0.1, 0.9), interval_method=method)
        back = a.backtest(plan, a.create_cv(plan, initial=300, refit=False)) if method == "bootstrap" else None
        if back:
            share = evaluation.coverage(back.predictions).first()["coverage"]
            assert 0.7 < share < 0.9
        row = a.forecast(plan).predictions.first()
        # the noise is skewed to the right, and so are the bounds
        assert row["upper_bound"] - row["pred"] > row["pred"] - row["lower_bound"] > 0


def test_own_windows_metrics_and_estimators(spark, shop):
    past, _ = shop
    features.register_statistic("spread", lambda y, w: F.max(y).over(w) - F.min(y).over(w), lambda v, axis: v.max(axis) - v.min(axis))
    evaluation.register_metric("worst", array=lambda y, pred: float(np.abs(y - pred).max()))
    evaluation.register_metric("bias", lambda y, pred: F.abs(F.avg(y - pred)))

    class Mean:
        def fit(self, rows, names, target, weight):
            return rows.agg(F.avg(target)).first()[0]

        def predict(self, model, rows):
            return rows.withColumn("pred", F.lit(model))

    models.register_estimator("mean", lambda **_: models.Estimator(Mean().fit, Mean().predict))
    a = Assistant(past, "day", "sales", exog=[])
    plan = a.plan(3, estimator="ridge", lags=[1], windows=[("spread", 3)], metric="worst")
    got = a.forecast(plan, test_size=6).metrics.first()
    assert got["worst"] >= got["mae"]
    out = a.backtest(a.plan(3, estimator="mean", lags=[1], metric="bias"))
    assert out.plan.strategy == "direct" and out.metrics.first()["bias"] > 0
    with pytest.raises(ValueError):
        a.plan(3, estimator="nothing")
    with pytest.raises(ValueError):
        features.register_statistic("mean", None, None)
    with pytest.raises(ValueError):
        evaluation.register_metric("mae", lambda y, p: y)


def test_refine_plan(shop):
    past, _ = shop
    a = Assistant(past, "day", "sales", exog=[])
    plan = a.plan(5, estimator="ridge", lags=[1, 7], windows=[("mean", 3)])
    longer = a.refine_plan(plan, steps=8, lags=[1, 2, 3])
    assert (longer.steps, longer.lags, longer.windows, longer.estimator) == (8, [1, 2, 3], [("mean", 3)], "ridge")
    stat = a.refine_plan(plan, strategy="statistical")
    assert stat.estimator == "holt_winters" and stat.lags == [] and a.refine_plan(stat, strategy="recursive", estimator="ridge").lags
    assert a.refine_plan(plan, interval=(0.2, 0.8)).interval_method == "bootstrap"
    with pytest.raises(ValueError, match="refined"):
        a.refine_plan(plan, colour="red")
    back = ForecastPlan.from_dict(json.loads(json.dumps(plan.to_dict())))
    assert back == plan
    profile = a.profile()
    assert DataProfile.from_dict(json.loads(json.dumps(profile.to_dict()))) == profile
    with pytest.raises(ValueError, match="no colour"):
        ForecastPlan.from_dict({**plan.to_dict(), "colour": 1})


def test_search_and_selection(spark, shop):
    past, _ = shop
    a = Assistant(past, "day", "sales")
    plan = a.plan(3, estimator="ridge", lags=[1], windows=[], calendar=[])
    found = search.search(a, plan, {"alpha": [1.0, 1e6], "lags": [[1], [1, 2]]})
    assert found.scores.count() == 4 and found.best.alpha == 1.0
    assert found.value == pytest.approx(found.scores.agg(F.min("value")).first()[0])
    drawn = search.tries({"a": [1, 2, 3], "b": [4, 5]}, 4)
    assert len(drawn) == 4 and len({tuple(d.items()) for d in drawn}) == 4 and drawn == search.tries({"a": [1, 2, 3], "b": [4, 5]}, 4)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    rows = [(*map(float, r), float(3 * r[1] - 2 * r[3] + rng.normal(scale=0.1))) for r in x]
    matrix = spark.createDataFrame(rows, "a double, b double, c double, d double, y double")
    assert search.select_features(matrix, list("abcd"), 2) == ["b", "d"]
    assert search.select_features(matrix, list("abcd"), 2, force=["c"]) == ["b", "c"]


def test_chunks_of_autocorrelation(spark):
    from seriesloom.operators import autocorrelation

    y = _simulated(300)
    grid = spark.createDataFrame([("s", i, float(v) if i % 50 else None) for i, v in enumerate(y)], "series_id string, pos long, y double")
    e = np.where(np.arange(300) % 50 == 0, 0.0, y - y[np.arange(300) % 50 != 0].mean())
    for lags in (20, 50):
        got = autocorrelation.acf(grid, lags, chunk=32).orderBy("lag").toPandas()
        np.testing.assert_allclose(got["acf"], [e[k:] @ e[:-k] / (e @ e) for k in range(1, lags + 1)])


def test_grids_do_not_depend_on_the_zone(spark):
    from seriesloom.sources.series import asfreq

    rows = [("s", datetime(2024, 3, 31, h), float(h)) for h in (0, 1, 2, 3, 6)] + [("s", datetime(2024, 3, 31, 4, 30), 9.0), ("s", datetime(2024, 3, 31, 6), 7.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = [tuple(r) for r in asfreq(df, "h").select("pos", "ts", "y").orderBy("pos", "y").collect()]
            assert [g[0] for g in got] == [0, 1, 2, 3, 4, 5, 6, 6] and [g[2] for g in got] == [0, 1, 2, 3, None, None, 6, 7]
            assert [g[1].hour for g in got] == [0, 1, 2, 3, 4, 5, 6, 6]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_command_line(spark, shop, tmp_path, capsys):
    past, ahead = shop
    data, future = str(tmp_path / "sales"), str(tmp_path / "future")
    past.write.parquet(data)
    ahead.write.parquet(future)
    base = ["--target", "sales", "--ts", "day"]
    assert cli.main(["profile", data, *base], spark) == 0
    assert json.loads(capsys.readouterr().out)["profile"]["frequency"] == "D"
    plan = str(tmp_path / "plan.json")
    assert cli.main(["plan", data, *base, "--steps", "4", "--estimator", "ridge", "--lags", "1,2", "--windows", "mean:3", "--interval", "0.1,0.9", "--out", plan], spark) == 0
    assert cli.main(["refine-plan", data, *base, "--from-plan", plan, "--lags", "3"], spark) == 0
    assert json.loads(capsys.readouterr().out)["plan"]["lags"] == [1, 2, 3]
    assert cli.main(["forecast", data, *base, "--from-plan", plan, "--future", future, "--predictions", str(tmp_path / "p"), "--format", "csv"], spark) == 0
    capsys.readouterr()
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).count() == 4
    assert cli.main(["backtest", data, *base, "--from-plan", plan, "--refit", "0"], spark) == 0
    assert json.loads(capsys.readouterr().out)["metrics"]["mae"] > 0
    (tmp_path / "c.json").write_text(json.dumps([["naive", {"estimator": "seasonal_naive"}], ["ridge", {"estimator": "ridge", "lags": [1], "windows": [["mean", 3]]}]]))
    assert cli.main(["compare", data, *base, "--steps", "4", "--candidates", str(tmp_path / "c.json")], spark) == 0
    assert json.loads(capsys.readouterr().out)["best"] == "ridge"
    assert cli.main(["plan", data, *base], spark) == 2 and "steps" in capsys.readouterr().err
