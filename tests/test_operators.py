"""Operators over small frames with known answers: gaps, repeats, nulls and leaks."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions.calendar import add_calendar
from seriesloom.functions.frequency import Freq
from seriesloom.operators import autocorrelation, drift, evaluation, features, profile
from seriesloom.plans import models
from seriesloom.sources import series, tables

START = datetime(2024, 1, 1)


def frame(spark, values, sid="a", step=timedelta(days=1), start=START):
    return spark.createDataFrame([(sid, start + i * step, None if v is None else float(v)) for i, v in enumerate(values)], "series_id string, ts timestamp_ntz, y double")


@pytest.mark.parametrize(
    ("alias", "first", "last", "want"),
    [
        ("D", "2024-02-27", "2024-03-01", ["2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01"]),
        ("ME", "2024-01-31", "2024-04-30", ["2024-01-31", "2024-02-29", "2024-03-31", "2024-04-30"]),
        ("MS", "2024-01-01", "2024-03-01", ["2024-01-01", "2024-02-01", "2024-03-01"]),
        ("QE", "2023-12-31", "2024-06-30", ["2023-12-31", "2024-03-31", "2024-06-30"]),
        ("B", "2024-01-04", "2024-01-09", ["2024-01-04", "2024-01-05", "2024-01-08", "2024-01-09"]),
        ("W-MON", "2024-01-01", "2024-01-15", ["2024-01-01", "2024-01-08", "2024-01-15"]),
    ],
)
def test_grids_and_shifts(spark, alias, first, last, want):
    freq = Freq.parse(alias)
    row = spark.range(1).select(freq.grid(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")).alias("g"), *[freq.shift(F.lit(first).cast("timestamp_ntz"), k).alias(f"s{k}") for k in range(len(want))]).first()
    assert [str(t.date()) for t in row["g"]] == want
    assert [str(row[f"s{k}"].date()) for k in range(len(want))] == want


@pytest.mark.parametrize(
    ("dates", "alias"),
    [
        (pd.date_range("2024-01-01", periods=20, freq="D"), "D"), (pd.date_range("2024-01-01", periods=20, freq="h"), "h"), (pd.date_range("2024-01-01", periods=20, freq="15min"), "15min"),
        (pd.date_range("2024-01-01", periods=20, freq="MS"), "MS"), (pd.date_range("2024-01-31", periods=20, freq="ME"), "ME"), (pd.date_range("2024-01-01", periods=20, freq="QS"), "QS"),
        (pd.date_range("2024-01-01", periods=20, freq="B"), "B"), (pd.date_range("2024-01-07", periods=20, freq="W-SUN"), "W-SUN"), (pd.date_range("2000-12-31", periods=12, freq="YE"), "YE"),
        (pd.date_range("2024-01-01", periods=2, freq="D"), None), (pd.date_range("2024-01-01", periods=20, freq="D").delete([4, 9]), "D"),
    ],
)
def test_frequencies_are_inferred(spark, dates, alias):
    df = spark.createDataFrame([("a", d.to_pydatetime(), 1.0) for d in dates], "series_id string, ts timestamp_ntz, y double")
    assert profile.infer_frequency(df) == alias


def test_grid_fills_gaps_and_keeps_first_of_repeats(spark):
    rows = [("a", START, 1.0, 2), ("a", START, 5.0, 1), ("a", START + timedelta(days=3), 4.0, 3)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double, n int")
    first = series.dedupe_keep_first(df, F.col("n"))
    assert sorted(r["y"] for r in first.collect()) == [4.0, 5.0]
    grid = series.asfreq(first, "D")
    assert [r["y"] for r in grid.orderBy("pos").collect()] == [5.0, None, None, 4.0]
    assert [r["filled"] for r in series.forward_fill(grid).orderBy("pos").collect()] == [5.0, 5.0, 5.0, 4.0]
    assert [round(r["filled"], 6) for r in series.interpolate(grid).orderBy("pos").collect()] == [5.0, 4.666667, 4.333333, 4.0]
    flags = profile.duplicate_timestamps(df).first()
    assert flags["has_duplicates"] and flags["rows"] == 3
    assert {r["series_id"]: r["is_monotonic"] for r in profile.is_monotonic(df, "n").collect()} == {"a": True}


def test_canonical_forms_agree(spark):
    long = frame(spark, [1, 2, 3]).unionByName(frame(spark, [4, float("nan"), 6], "b"))
    wide = series.long_to_wide(long, ["a", "b"])
    again = series.canonical(wide, "ts", ["a", "b"])
    direct = series.canonical(long, "ts", "y", "series_id")
    key = lambda df: sorted((r["series_id"], r["ts"], str(r["y"])) for r in df.collect())
    assert key(again) == key(direct) and sum(r["y"] is None for r in direct.collect()) == 1


def test_features_do_not_see_the_present(spark):
    rng = np.random.default_rng(0)
    values = rng.normal(size=40)
    changed = values.copy()
    changed[25] += 100
    stats = [(s, 5) for s in features.STATS]
    out = [features.add_features(series.asfreq(frame(spark, v), "D"), [1, 3], stats).orderBy("pos").toPandas() for v in (values, changed)]
    names = [c for c in out[0].columns if c.startswith(("lag_", "roll_"))]
    assert out[0].loc[:25, names].equals(out[1].loc[:25, names]) and not out[0].loc[26, names].equals(out[1].loc[26, names])
    want = pd.Series(values).shift(1).rolling(5)
    for name, w in (("mean", want.mean()), ("std", want.std()), ("min", want.min()), ("max", want.max()), ("median", want.median())):
        np.testing.assert_allclose(out[0][f"roll_{name}_5"].to_numpy(), w.to_numpy(), rtol=1e-9)


def test_differences_invert(spark):
    values = [3.0, 5.0, 4.0, 9.0, 1.0]
    grid = features.difference(series.asfreq(frame(spark, values), "D"))
    back = features.undifference(grid.drop("y").withColumn("anchor", F.lit(3.0)), "anchor")
    assert [r["y"] for r in back.orderBy("pos").collect()] == values
    second = features.difference(series.asfreq(frame(spark, values), "D"), 2).orderBy("pos").toPandas()["diff"]
    np.testing.assert_allclose(second[2:], np.diff(values, 2))


def test_partial_autocorrelation_finds_an_ar2(spark):
    rng = np.random.default_rng(123)
    y = np.zeros(500)
    for t in range(2, 500):
        y[t] = 0.7 * y[t - 1] + 0.2 * y[t - 2] + rng.normal(scale=0.1)
    grid = series.asfreq(frame(spark, y), "D")
    found = {r["lag"]: r["pacf"] for r in autocorrelation.significant_lags(grid, 50).collect()}
    assert {1, 2} <= set(found) and found[1] > 0.8
    r = autocorrelation.acf(grid, 5).orderBy("lag").toPandas()["acf"].to_numpy()
    e = y - y.mean()
    np.testing.assert_allclose(r, [(e[k:] * e[:-k]).sum() / (e * e).sum() for k in range(1, 6)], rtol=1e-9)


def test_two_sided_tail(spark):
    import math

    z = [0.0, 0.5, 1.0, 1.96, 3.0, 6.0]
    got = spark.createDataFrame([(float(v),) for v in z], "z double").select(autocorrelation.two_sided(F.col("z")).alias("p")).toPandas()["p"]
    np.testing.assert_allclose(got, [math.erfc(v / math.sqrt(2)) for v in z], rtol=2e-6)


def test_folds_and_rows(spark):
    folds = evaluation.cv_folds(spark, 30, 10, 4, stride=4, gap=2, fixed_train=True, refit=2, allow_incomplete=False, skip=[1]).orderBy("fold").collect()
    assert [(r["fold"], r["train_from"], r["train_to"], r["test_from"], r["test_to"]) for r in folds] == [(0, 0, 10, 12, 16), (2, 8, 18, 20, 24), (3, 12, 22, 24, 28)]
    assert [r["refit"] for r in folds] == [True, True, False]
    with pytest.raises(ValueError):
        evaluation.cv_folds(spark, 30, 0, 4)
    grid = series.asfreq(frame(spark, range(30)), "D")
    df = evaluation.cv_folds(spark, 30, 10, 4)
    test, train = evaluation.fold_rows(grid, df), evaluation.fold_rows(grid, df, "train")
    assert test.count() == 20 and test.select("pos").distinct().count() == 20
    assert train.groupBy("fold").count().orderBy("fold").collect()[1]["count"] == 14


def test_metrics(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 4.0, 2.0), ("b", 1.0, 1.0)], "series_id string, y double, pred double")
    out = {r["level"]: r for r in evaluation.metrics_by_level(df, ["mae", "mape", "smape"]).collect()}
    assert out["a"]["mae"] == 1.5 and out["a"]["mape"] == 0.5 and out["b"]["smape"] == 0 and out[None]["n"] == 3
    with pytest.raises(ValueError):
        evaluation.metric("other", F.col("y"), F.col("pred"))
    with pytest.raises(ValueError):
        evaluation.evaluate(df, ["mase"])


def test_leaderboard_puts_failures_last(spark):
    df = spark.createDataFrame([("x", 2.0), ("y", None), ("z", float("nan")), ("w", 2.0)], "candidate string, value double")
    assert [r["candidate"] for r in evaluation.leaderboard(df).orderBy("rank").collect()] == ["w", "x", "y", "z"]


def test_drift(spark):
    rows = [("a", float(i % 10), False) for i in range(100)] + [("a", float(i % 10 + 5), True) for i in range(100)]
    df = spark.createDataFrame(rows, "series_id string, y double, is_new boolean")
    assert drift.ks_statistic(df, "y", "is_new").first()["ks"] == pytest.approx(0.5)
    out = drift.range_drift(df.where("not is_new"), df.where("is_new")).first()
    assert out["share"] == 0.5 and out["drifted"]
    same = df.withColumn("is_new", F.rand(1) < 0.5)
    assert drift.js_divergence(df, "y", "is_new").first()["js"] > 2 * drift.js_divergence(same, "y", "is_new").first()["js"]
    assert drift.chi_square(df, "y", "is_new").first()["chi2"] > 90


def test_calendar_encodings(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 6, 13, 30),)], "ts timestamp_ntz")
    r = add_calendar(df, ["weekend", "day_of_week", "hour", "week"]).first()
    assert (r["weekend"], r["day_of_week"], r["hour"], r["week"]) == (1, 5, 13, 1)
    r = add_calendar(df, ["hour", "year"], "cyclical").first()
    assert r["hour_sin"] ** 2 + r["hour_cos"] ** 2 == pytest.approx(1) and r["year"] == 2024
    r = add_calendar(df, ["hour"], "spline").first()
    assert sum(r[f"hour_spline_{i}"] for i in range(6)) == pytest.approx(1)
    assert sum(add_calendar(df, ["month"], "onehot").first()[1:]) == 1
    with pytest.raises(ValueError):
        add_calendar(df, ["age"])


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,when,value\nx,2024-01-01 00:00:00,1\ny,2024-01-02 00:00:00,2\n")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.where("value = 2").count() == 1 and "timestamp" in dict(df.dtypes)["when"]
    text = spark.createDataFrame([("a", "2024-01-05"), ("b", None)], "k string, d string")
    assert dict(tables.detect_date(text).dtypes)["d"] == "timestamp_ntz"
    s = pd.Series([1.0, 2.0], index=pd.date_range("2024-01-01", periods=2), name="sales")
    assert tables.from_pandas(spark, s).columns == ["ts", "sales"]
    tables.write(df, str(tmp_path / "out"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_ridge_recovers_a_recursion(spark):
    y = [1.0, 2.0]
    for _ in range(60):
        y.append(0.6 * y[-1] + 0.3 * y[-2] + 1)
    grid = series.asfreq(frame(spark, y), "D")
    betas = models.fit_ridge(features.train_matrix(grid, [1, 2]), ["lag_1", "lag_2"], ["series_id"], alpha=1e-9)
    np.testing.assert_allclose(betas.first()["beta"], [0.6, 0.3, 1.0], rtol=1e-3)
    resid = models.residual_quantiles(features.train_matrix(grid, [1, 2]), betas, ["lag_1", "lag_2"], ["series_id"])
    out = models.recursive_forecast(models.tails_at_end(grid, 2), betas, [1, 2], [], 3, "D", interval=(0.1, 0.9), residuals=resid).orderBy("step").toPandas()
    want = list(y[-2:])
    for _ in range(3):
        want.append(0.6 * want[-1] + 0.3 * want[-2] + 1)
    np.testing.assert_allclose(out["pred"], want[2:], rtol=1e-5)
    assert (out["lower_bound"] <= out["pred"] + 1e-6).all() and (out["pred"] <= out["upper_bound"] + 1e-6).all()
    assert str(out["ts"][0].date()) == str((START + timedelta(days=len(y))).date())


def test_backtest_refits_match_separate_fits(spark):
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=60)) + 20
    grid = series.asfreq(frame(spark, y), "D")
    folds = evaluation.cv_folds(spark, 60, 40, 5)
    got = models.backtest_ridge(grid, folds, [1, 2], [("mean", 3)], "D").orderBy("fold", "step").toPandas()
    assert len(got) == 20
    part = grid.where("pos < 45")
    matrix, names, _ = models.matrix_of(part, [1, 2], [("mean", 3)])
    betas = models.fit_ridge(matrix.where("pos >= 3"), names, ["series_id"])
    want = models.recursive_forecast(models.tails_at_end(part, 3), betas, [1, 2], [("mean", 3)], 5, "D").orderBy("step").toPandas()
    np.testing.assert_allclose(got[got["fold"] == 1]["pred"], want["pred"], rtol=1e-6)


def test_holt_winters_follows_a_season():
    t = np.arange(120)
    ahead, error = models.holt_winters(10 + 0.1 * t + np.sin(2 * np.pi * t / 12), 12, 12, 0.3, 0.05, 0.3)
    want = 10 + 0.1 * np.arange(120, 132) + np.sin(2 * np.pi * np.arange(120, 132) / 12)
    assert np.abs(ahead - want).max() < 0.5 and error < 0.5
