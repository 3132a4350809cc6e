from datetime import datetime

import pytest

from seriesloom.functions.frequency import Freq, seasonal_periods
from seriesloom.plans import rules
from seriesloom.plans.records import CVParams, DataProfile


def profile(n=200, n_series=1, freq="D", lo=1.0, hi=9.0, missing=0, gaps=False):
    near_zero = min(abs(lo), abs(hi)) <= 0.01 or lo <= 0 <= hi
    return DataProfile("long", n_series, "y", freq, n, n * n_series, gaps, False, n, n, missing * n_series, datetime(2024, 1, 1), datetime(2024, 6, 1), near_zero=near_zero)


@pytest.mark.parametrize(
    ("alias", "periods"),
    [("D", [7, 365]), ("h", [24, 168]), ("15min", [4, 96]), ("min", [60, 1440]), ("W-SUN", [52]), ("W", [52]), ("MS", [12]), ("ME", [12]), ("2MS", [6]), ("QE", [4]), ("YS", [1]), ("B", [5, 252]), ("12h", [2, 14])],
)
def test_seasonal_periods(alias, periods):
    assert seasonal_periods(Freq.parse(alias)) == periods


@pytest.mark.parametrize("alias", ["", "xyz", "0D", "D3"])
def test_unknown_frequencies(alias):
    with pytest.raises(ValueError):
        Freq.parse(alias)


def test_strategy_and_estimator():
    assert rules.select_strategy(profile())[0] == "recursive"
    assert "statistical" in rules.select_strategy(profile(freq="MS")) and "statistical" not in rules.select_strategy(profile(freq="h"))
    assert rules.select_strategy(profile(n_series=3)) == ["multi_series", "multivariate"]
    assert rules.select_estimator(profile(249), "recursive") == "ridge" and rules.select_estimator(profile(250), "recursive") == "gbt"
    assert rules.select_estimator(profile(), "foundation") is None


def test_lags():
    assert rules.finalize_lags([3, 1, 40], 29, 7) == [1, 2, 3, 4, 5]
    assert rules.finalize_lags([9, 2, 400, 3], 100, 7) == [2, 3, 7, 9]
    assert rules.finalize_lags([9], 100, 7) == [1, 2, 3, 4, 5, 7, 9]
    assert rules.finalize_lags([], 100, 50) == [1, 2, 3, 4, 5]
    assert rules.finalize_lags([30], 100, None, reserved=10) == [1, 2, 3, 4, 5]


def test_windows():
    assert rules.select_windows(59, [7], "recursive", 20) == []
    assert rules.select_windows(200, [7, 365], "recursive", 66) == [("mean", 3), ("mean", 7), ("mean", 21), ("std", 3)]
    assert rules.select_windows(100, [52], "recursive", 33) == [("mean", 3), ("mean", 33), ("std", 3)]
    assert rules.select_windows(100, [], "recursive", 33) == [("mean", 3), ("mean", 7), ("std", 3)]
    assert rules.select_windows(100, [7], "statistical", 33) == []


def test_calendar_and_metric():
    assert rules.select_calendar("D", 100, "recursive") == ["day_of_week", "weekend", "month"]
    assert rules.select_calendar("h", 2 * 8760, "recursive")[-1] == "month"
    assert rules.select_calendar("D", 29, "recursive") == [] and rules.select_calendar(None, 100, "recursive") == []
    assert rules.calendar_encoding("gbt", "recursive") is None and rules.calendar_encoding("ridge", "recursive") == "cyclical"
    assert rules.select_metric(profile(), "recursive") == ("mae", ["mae", "mse", "mase", "mape"])
    assert rules.select_metric(profile(lo=0.0, n_series=2), "multi_series") == ("mase", ["mae", "mse", "mase"])


def test_shapes_budget_and_splits():
    with pytest.raises(ValueError):
        rules.check_shape(profile(n_series=2), "recursive")
    with pytest.raises(ValueError):
        rules.check_shape(profile(), "other")
    rules.check_budget(33, 100)
    with pytest.raises(ValueError):
        rules.check_budget(34, 100)
    assert rules.resolve_test_rows(0.25, 10) == 2 and rules.resolve_test_rows(0.001, 10) == 1 and rules.resolve_test_rows(9, 10) == 9
    for bad in (0, 10, 1.0, 0.0):
        with pytest.raises(ValueError):
            rules.resolve_test_rows(bad, 10)
    with pytest.raises(TypeError):
        rules.resolve_test_rows(True, 10)
    with pytest.raises(ValueError):
        rules.check_end_train(datetime(2024, 1, 1), datetime(2024, 1, 1), datetime(2024, 2, 1))


def test_folds():
    assert rules.cv_defaults(100, 10, 7) == CVParams(initial=70, steps=7)
    assert rules.cv_defaults(100, 90, 7).initial == 86
    assert rules.count_folds(100, CVParams(70, 7)) == 5
    with pytest.raises(ValueError):
        rules.count_folds(75, CVParams(70, 7))
