"""Quantile regression against the exact optimum, scores of samples, drift by chunk, and searches against separate fits."""

from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import drift, evaluation, features
from seriesloom.plans import models, quantiles, search
from seriesloom.sources.series import asfreq

DAY = datetime(2023, 1, 1)


def loss(e, q):
    return np.maximum(q * e, (q - 1) * e).sum()


def exact(x, y, q):
    """The least pinball loss of a line: some best line passes through two points, as linear programming says."""
    best = np.inf
    for i, j in combinations(range(len(y)), 2):
        if x[i] != x[j]:
            b = (y[j] - y[i]) / (x[j] - x[i])
            best = min(best, loss(y - (y[i] + b * (x - x[i])), q))
    return best


def test_fits_reach_the_optimum_of_linear_programming(spark):
    rng = np.random.default_rng(0)
    qs, rows = [0.9, 0.1, 0.5], []
    for s in "ab":
        x = rng.normal(size=60)
        rows += [(s, float(a), float(b)) for a, b in zip(x, 2 + (3 if s == "a" else -1) * x + rng.exponential(size=60), strict=True)]
    rows.append(("a", None, 1.0))
    df = spark.createDataFrame(rows, "series_id string, `x` double, y double").repartition(3)
    for r in quantiles.fit_quantiles(df, ["x"], qs, ["series_id"], iterations=50).collect():
        part = np.array([t[1:] for t in rows if t[0] == r.series_id and t[1] is not None])
        for q, (slope, level) in zip(qs, r.betas, strict=True):
            got = loss(part[:, 1] - level - slope * part[:, 0], q)
            assert got <= exact(part[:, 0], part[:, 1], q) * 1.004
    one = quantiles.fit_quantiles(df, ["x"], [0.5]).first()
    assert len(one.betas) == 1 and len(one.betas[0]) == 2
    assert quantiles.fit_quantiles(df.limit(0), ["x"], [0.5], ["series_id"]).count() == 0


def test_quantiles_do_not_cross_and_cover(spark):
    rng = np.random.default_rng(1)
    rows = []
    for s in range(8):
        y = 20 + 5 * np.sin(2 * np.pi * np.arange(420) / 7) + rng.gumbel(size=420) * 2
        rows += [(f"s{s}", DAY + timedelta(days=i), float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double")
    grid = asfreq(df, "D")
    train = grid.where("pos < 413")
    qs = [0.1, 0.5, 0.9]
    out = quantiles.quantile_forecast(train, models.Design([1, 7]), 7, "D", qs, per_series=False)
    met = out.join(df, ["series_id", "ts"]).toPandas()
    assert len(met) == 56 and (met["q_0.1"] <= met["q_0.5"]).all() and (met["q_0.5"] <= met["q_0.9"]).all()
    inside = ((met["q_0.1"] <= met["y"]) & (met["y"] <= met["q_0.9"])).mean()
    assert 0.65 < inside < 0.95 and met["step"].tolist().count(3) == 8
    crps = evaluation.crps_from_quantiles(out.join(df, ["series_id", "ts"]), qs, ())
    assert 0 < crps.first()["crps"] < 3


def test_crossing_fits_are_put_in_order(spark):
    row = spark.createDataFrame([(1.0, [[0.0, 5.0], [0.0, 3.0]])], "x double, betas array<array<double>>")
    got = row.select(*[c.alias(n) for n, c in quantiles.quantile_columns(["x"], [0.2, 0.8]).items()]).first()
    assert tuple(got) == (3.0, 5.0)


def test_scores_of_samples(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(rng.normal()), [float(v) for v in rng.normal(size=rng.integers(1, 9))]) for _ in range(40)] + [("b", 1.0, [3.0]), ("b", None, [1.0]), ("b", 2.0, []), ("b", 2.0, [2.0, None, 4.0])]
    df = spark.createDataFrame(rows, "series_id string, y double, paths array<double>")
    plain = lambda y, x: np.mean(np.abs(x - y)) - np.abs(x[:, None] - x).mean() / 2
    got = {r.series_id: r.crps for r in evaluation.crps_from_samples(df).collect()}
    assert got["a"] == pytest.approx(np.mean([plain(y, np.array(x)) for s, y, x in rows if s == "a"]))
    assert got["b"] == pytest.approx(np.mean([2.0, plain(2.0, np.array([2.0, 4.0]))]))


def test_paths_give_quantiles_and_distributions(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("a", DAY + timedelta(days=i), float(v)) for i, v in enumerate(np.cumsum(rng.normal(size=200)))], "series_id string, ts timestamp_ntz, y double")
    grid = asfreq(df, "D")
    matrix, names, target = models.design_matrix(grid, models.Design([1]))
    betas = models.fit_ridge(matrix, names, ["series_id"], target=target)
    resid = models.residual_quantiles(matrix, betas, names, ["series_id"], target)
    out = models.recursive_forecast(models.tails_at_end(grid, 1), betas, [1], [], 5, "D", interval=(0.1, 0.9), residuals=resid, keep_paths=True, paths=120)
    for r in models.path_distribution(models.path_quantiles(out, [0.1, 0.37, 0.9])).collect():
        assert len(r.paths) == 120 and r["q_0.1"] == pytest.approx(r.lower_bound) and r["q_0.9"] == pytest.approx(r.upper_bound)
        assert r["q_0.37"] == pytest.approx(np.quantile(r.paths, 0.37)) and r.loc == pytest.approx(np.mean(r.paths)) and r.scale == pytest.approx(np.std(r.paths, ddof=1))


def test_drift_by_chunk_equals_plain_statistics(spark):
    rng = np.random.default_rng(4)
    old = [("a", int(c), float(v), str(int(v) % 4)) for c in range(6) for v in rng.integers(0, 30, 40)]
    new = [("a", 10, float(v), str(int(v) % 4)) for v in rng.integers(0, 30, 35)] + [("a", 11, float(v), "zz") for v in rng.integers(20, 40, 50)] + [("a", 12, 5.0, None), ("a", 12, None, "1"), ("b", 1, 2.0, "1")]
    kinds = "series_id string, chunk long, y double, kind string"
    reference, other = spark.createDataFrame(old, kinds).repartition(3), spark.createDataFrame(new, kinds).repartition(3)
    got = {(r.series_id, r.chunk): r for r in drift.chunk_ks(reference, other).collect()}
    base = np.array([r[2] for r in old])
    for c in (10, 11, 12):
        own = np.array([r[2] for r in new if r[:2] == ("a", c) and r[2] is not None])
        at = np.union1d(base, own)
        want = max(abs((own <= v).mean() - (base <= v).mean()) for v in at)
        assert got["a", c].ks == pytest.approx(want) and got["a", c].n == len(own)
    assert got["b", 1].ks is None
    kinds_of = lambda rows: [r[3] for r in rows]
    found = {(r.series_id, r.chunk): r for r in drift.chunk_categories(reference, other, "kind").collect()}
    for c in (10, 11, 12):
        own = kinds_of([r for r in new if r[:2] == ("a", c)])
        ref, every = kinds_of(old), sorted({*kinds_of(old), *own}, key=str)
        a, b = (np.array([x.count(k) for k in every], float) for x in (own, ref))
        p, q = b / b.sum(), a / a.sum()
        js = sum(x * np.log2(x / ((u + v) / 2)) for u, v in zip(p, q) for x in (u, v) if x > 0) / 2
        expected = np.outer([a.sum(), b.sum()], (a + b) / (a + b).sum())
        assert found["a", c].js == pytest.approx(np.sqrt(js)) and found["a", c].df == len(every) - 1
        assert found["a", c].chi2 == pytest.approx((((np.stack([a, b]) - expected) ** 2) / expected).sum())
    trained = drift.chunk_ks(reference, reference)
    for given, want in (({}, lambda v: v.mean() + 3 * v.std(ddof=1)), ({"quantile": 0.9}, lambda v: np.quantile(v, 0.9))):
        limit = drift.learned_thresholds(trained, ["ks"], **given).first()["ks_limit"]
        assert limit == pytest.approx(want(np.array([r.ks for r in trained.collect()])))
    flagged, by = drift.chunk_drift(drift.chunk_ks(reference, other), drift.learned_thresholds(trained, ["ks"]), ["ks"])
    assert {r.chunk for r in flagged.where("ks_drifted").collect()} >= {11}
    assert {r.series_id: r.drifted for r in by.collect()} == {"a": True, "b": False}


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    y = np.zeros(400)
    for t in range(2, 400):
        y[t] = 0.6 * y[t - 1] - 0.3 * y[t - 2] + rng.normal()
    df = spark.createDataFrame([(s, DAY + timedelta(days=i), float(v + k)) for k, s in enumerate("ab") for i, v in enumerate(y)], "series_id string, ts timestamp_ntz, y double")
    return asfreq(df, "D")


def test_one_step_scores_equal_separate_fits(matrix):
    tries = [[1], [1, 2], [2, 5], [1, 2, 5]]
    found = search.lag_search(matrix, tries, [0.1, 50.0], 300, [("mean", 3)])
    whole, names, _ = models.design_matrix(matrix, models.Design([1, 2, 5], [("mean", 3)]))
    rows = whole.select("pos", "y", *names).toPandas()
    train, test = rows[rows["pos"] < 300], rows[rows["pos"] >= 300]
    want = []
    for lags in tries:
        cols = [*(f"lag_{k}" for k in lags), "roll_mean_3"]
        for alpha in (0.1, 50.0):
            x, y = train[cols].to_numpy(), train["y"].to_numpy()
            b = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + alpha * np.eye(len(cols)), (x - x.mean(0)).T @ (y - y.mean()))
            e = test["y"].to_numpy() - y.mean() - (test[cols].to_numpy() - x.mean(0)) @ b
            want.append(np.sqrt(np.mean(e**2)))
    assert np.allclose([s["rmse"] for s in found.scores], want)
    best = int(np.argmin(want))
    assert found.alpha == (0.1, 50.0)[best % 2] and found.features == found.scores[best]["features"]
    for bad in ({"metric": "mae"}, {"lag_sets": []}):
        with pytest.raises(ValueError):
            search.lag_search(matrix, **({"lag_sets": tries, "alphas": [1.0], "initial": 300} | bad))
    with pytest.raises(ValueError, match="both sides"):
        search.lag_search(matrix, tries, [1.0], 10**6)


def test_cross_validated_elimination_equals_refits(matrix):
    rng = np.random.default_rng(6)
    names = ["lag_1", "lag_2", "lag_5", "noise"]
    rows = features.train_matrix(matrix, [1, 2, 5]).withColumn("noise", F.rand(1)).withColumn("fold", F.floor(F.col("pos") / 100)).select("fold", "y", *names).toPandas()
    df = matrix.sparkSession.createDataFrame(rows)
    chosen, scores = search.select_features_cv(df, names, "fold")
    assert "lag_1" in chosen and "lag_2" in chosen

    def fit(part, cols):
        x, y = part[cols].to_numpy(), part["y"].to_numpy()
        b = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + np.eye(len(cols)), (x - x.mean(0)).T @ (y - y.mean()))
        return b, lambda p: y.mean() + (p[cols].to_numpy() - x.mean(0)) @ b

    errors = {}
    for fold in sorted(rows["fold"].unique()):
        rest, own, held = rows[rows["fold"] != fold], rows[rows["fold"] == fold], list(names)
        while held:
            b, predict = fit(rest, held)
            errors.setdefault(len(held), []).append(np.mean((own["y"] - predict(own)) ** 2))
            weight = np.abs(b) * rest[held].std(ddof=0).to_numpy()
            held.pop(int(weight.argmin()))
    assert {s["features"]: pytest.approx(s["mse"]) for s in scores} == {k: np.mean(v) for k, v in errors.items()}
    assert len(chosen) == min(errors, key=lambda k: np.mean(errors[k]))
    forced, _ = search.select_features_cv(df, names, "fold", force=["noise"])
    assert "noise" in forced and rng is not None
    with pytest.raises(ValueError, match="two folds"):
        search.select_features_cv(df.where("fold = 0"), names, "fold")
