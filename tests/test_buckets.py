"""Buckets of a series give what one window over the whole gives; no task holds more than a bucket and its halo."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import buckets, features
from seriesloom.sources import series

HOUR = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def long(spark):
    rng = np.random.default_rng(0)
    rows = [(s, HOUR + timedelta(hours=i), None if rng.random() < 0.2 else float(rng.normal())) for s, n in (("a", 900), ("b", 40)) for i in range(n) if not 300 < i < 520 and (i % 7 or i in (0, n - 1))]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double").repartition(5)


def same(a, b, keys=("series_id", "pos")):
    a, b = (x.select(*[F.col(f"`{c}`") for c in sorted(x.columns)]).toPandas().sort_values(list(keys)).reset_index(drop=True) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            assert np.allclose(a[c], b[c], equal_nan=True), c
        else:
            assert (a[c] == b[c]).all(), c


@pytest.mark.parametrize("rows", [7, 64, 10**6])
def test_grids_and_windows(long, rows):
    plain = series.asfreq(long, "h")
    same(buckets.bucketed_asfreq(long, "h", rows), plain)
    windows = [("mean", 5), ("std", 3), ("median", 4), ("ewm", 3)]
    same(buckets.bucketed_features(plain, [1, 24], windows, rows=rows), features.add_features(plain, [1, 24], windows))
    same(buckets.bucketed_difference(plain, 2, rows=rows), features.difference(plain, 2))


@pytest.mark.parametrize("rows", [7, 64, 10**6])
def test_filling(long, rows):
    plain = series.asfreq(long, "h")
    same(buckets.bucketed_fill(plain, "forward", rows=rows), series.forward_fill(plain))
    same(buckets.bucketed_fill(plain, "interpolate", rows=rows), series.interpolate(plain))


def test_a_bucket_bounds_a_window(long):
    plain = series.asfreq(long, "h")
    spread = buckets._spread(plain, 24, 64)
    assert spread.groupBy("series_id").count().agg(F.max("count")).first()[0] <= 64 + 24
    assert spread.where("_own").count() == plain.count()


def test_what_cannot_be_asked(long, spark):
    with pytest.raises(ValueError):
        buckets.bucketed_asfreq(long, "MS")
    with pytest.raises(ValueError):
        buckets.bucketed_fill(series.asfreq(long, "h"), "zero")
    assert buckets.bucketed_asfreq(long.limit(0), "h").count() == 0
