"""Power transformations: round trips, the likelihood against plain numpy, and plans that use them."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import scaling
from seriesloom.plans.assistant import Assistant

DAY = datetime(2022, 1, 1)


def yeo_johnson(y, k):
    up = lambda x, k: np.log(x) if abs(k) < 1e-9 else (x**k - 1) / k
    return np.where(y >= 0, up(np.maximum(y, 0) + 1, k), -up(1 - np.minimum(y, 0), 2 - k))


@pytest.mark.parametrize("k", [-2.0, -0.5, 0.0, 0.3, 1.0, 1.7, 2.0])
def test_round_trips_keep_order(spark, k):
    values = [-50.0, -3.2, -0.5, 0.0, 1e-6, 0.7, 4.0, 900.0]
    df = spark.createDataFrame([(v,) for v in values], "y double")
    z = scaling.power(F.col("y"), F.lit(k))
    got = df.select("y", z.alias("z"), scaling.inverse_power(z, F.lit(k)).alias("back")).orderBy("y").toPandas()
    assert np.allclose(got["z"], yeo_johnson(got["y"].to_numpy(), k)) and (np.diff(got["z"]) > 0).all() and np.allclose(got["back"], got["y"], rtol=1e-5)
    z = scaling.power(F.col("y"), F.lit(k), "box_cox")
    got = df.where("y > 0.1").select("y", scaling.inverse_power(z, F.lit(k), "box_cox").alias("back")).toPandas()
    assert np.allclose(got["back"], got["y"])
    ends = spark.createDataFrame([(v,) for v in (-40.0, -2.0, 0.0, 2.0, 40.0)], "z double").select(scaling.inverse_power(F.col("z"), F.lit(k)).alias("y")).toPandas()["y"]
    assert ends.notna().all() and (np.diff(ends) >= 0).all()


def test_the_exponent_of_greatest_likelihood(spark):
    rng = np.random.default_rng(0)
    series = {"log": np.exp(rng.normal(size=500)), "plain": rng.normal(size=500) * 3 + 20, "square": np.sqrt(rng.uniform(1, 50, 500)), "both": rng.normal(size=500) ** 3}
    df = spark.createDataFrame([(s, float(v)) for s, y in series.items() for v in y] + [("flat", 3.0)] * 4 + [("none", None), ("neg", -1.0), ("neg", 2.0), ("neg", 5.0)], "series_id string, y double").repartition(4)
    got = {r.series_id: r.exponent for r in scaling.fit_power(df).collect()}
    for s, y in series.items():
        score = [-len(y) / 2 * np.log(np.var(yeo_johnson(y, k))) + (k - 1) * np.sum(np.sign(y) * np.log(np.abs(y) + 1)) for k in scaling.POWERS]
        assert got[s] == scaling.POWERS[int(np.argmax(score))]
    assert got["flat"] == 1.0 and "none" not in got
    cox = {r.series_id: r.exponent for r in scaling.fit_power(df, "box_cox").collect()}
    assert abs(cox["log"]) <= 0.1 and cox["neg"] == cox["both"] == 1.0
    with pytest.raises(ValueError):
        scaling.fit_power(df, "root")


@pytest.mark.parametrize("choice", [{"estimator": "ridge", "transform": "box_cox"}, {"estimator": "ridge", "transform": "yeo_johnson", "scale": False}, {"estimator": "decision_tree", "transform": "yeo_johnson"}])
def test_plans_transform_and_undo(spark, choice):
    rng = np.random.default_rng(1)
    wave = lambda: np.exp(2 + np.sin(2 * np.pi * np.arange(260) / 7) + 0.05 * rng.normal(size=260))
    rows = [(s, DAY + timedelta(days=i), float(v)) for s in "ab" for i, v in enumerate(wave())]
    a = Assistant(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double"), "ts", "y", "series_id", freq="D")
    plan = a.plan(7, lags=[1, 7], windows=[], calendar=[], interval=(0.1, 0.9), encode_series=False, **choice)
    assert plan.transform == choice["transform"]
    out = a.forecast(plan, test_size=7)
    got = out.predictions.toPandas()
    assert (got["lower_bound"] <= got["pred"]).all() and (got["pred"] <= got["upper_bound"]).all() and got["pred"].between(1, 40).all()
    assert out.metrics.where("mape < 0.25").count() == 2
    back = a.backtest(plan, a.create_cv(plan, initial=240)).predictions.toPandas()
    assert back["y"].round(6).isin({round(r[2], 6) for r in rows}).all() and back["pred"].notna().all()
    with pytest.raises(ValueError, match="transform"):
        a.plan(7, transform="root")
