"""Decision rules from a profile to a plan: small, deterministic, without data."""

from __future__ import annotations

import math
from datetime import datetime

from seriesloom.functions.frequency import Freq, seasonal_periods
from seriesloom.plans.records import CVParams, DataProfile

# Limits and tables of the rules.
MAX_FEATURE_SHARE = 0.33
MAX_LAGS = 200
MAX_STATISTICAL_SEASON = 24
MIN_WINDOW_ROWS = 60
MIN_CALENDAR_ROWS = 30
SMALL_DATA = 250
NULL_TOLERANT = ("gbt",)
TREES = ("gbt", "spark_gbt", "random_forest", "decision_tree")
STRATEGIES = ("recursive", "direct", "multi_series", "multivariate", "statistical", "foundation")
CALENDAR = {
    "min": ["hour", "minute", "day_of_week", "weekend"],
    "h": ["hour", "day_of_week", "weekend"],
    "B": ["day_of_week", "month"],
    "D": ["day_of_week", "weekend", "month"],
    "W": ["week", "month"],
    "M": ["month", "quarter"],
    "Q": ["quarter"],
}
ROWS_A_YEAR = {"min": 525600, "h": 8760}


def feature_budget(n: int, reserved: int = 0) -> int:
    """Rows that lags and windows may reach back."""
    return max(int(n * MAX_FEATURE_SHARE) - max(reserved, 0), 1)


def check_budget(reach: int, span: int) -> None:
    most = int(span * MAX_FEATURE_SHARE)
    if reach > most:
        raise ValueError(f"features reach back {reach} rows; at most {most} of {span} are allowed")


def select_strategy(profile: DataProfile) -> list[str]:
    """Suitable strategies, the recommended one first."""
    if profile.n_series > 1:
        return ["multi_series", "multivariate"]
    season = max(_seasons(profile), default=1)
    out = ["recursive", "direct", "foundation"]
    return [*out, "statistical"] if min(_seasons(profile), default=1) < MAX_STATISTICAL_SEASON or season == 1 else out


def _seasons(profile: DataProfile) -> list[int]:
    return seasonal_periods(Freq.parse(profile.frequency)) if profile.frequency else []


def select_estimator(profile: DataProfile, strategy: str) -> str | None:
    if strategy in ("statistical", "foundation"):
        return {"statistical": "holt_winters"}.get(strategy)
    return "ridge" if profile.n_observations < SMALL_DATA else "gbt"


def finalize_lags(found: list[int], n: int, season: int | None, reserved: int = 0) -> list[int]:
    """Found lags within the budget, the strongest first, made up by the first five and the season."""
    budget = feature_budget(n, reserved)
    long_enough = n >= MIN_CALENDAR_ROWS
    strongest = [k for k in found if 1 <= k <= budget][:MAX_LAGS] if long_enough else []
    sources = (
        (strongest, True),
        (range(1, min(5, budget) + 1), len(strongest) < 3),
        ([season], long_enough and bool(season) and season <= budget),
    )
    return sorted({k for lags, used in sources if used for k in lags})


def select_windows(n: int, seasons: list[int], strategy: str, budget: int) -> list[tuple[str, int]]:
    """Rolling means over a ladder of windows and a deviation over the shortest.

    The ladder has three rows and every season that fits. A single season adds its largest multiple up to
    three that fits; without one, the whole budget if a season is beyond it, else a week of rows.
    """
    if not _learns(strategy) or n < MIN_WINDOW_ROWS or budget < 3:
        return []
    fitting = [s for s in seasons if 3 <= s <= budget]
    extra = {
        0: lambda: budget if max(seasons, default=0) > budget else min(7, budget),
        1: lambda: fitting[0] * min(3, budget // fitting[0]),
    }.get(len(fitting), lambda: 3)()
    sizes = sorted({3, *fitting, extra})
    return [*(("mean", size) for size in sizes), ("std", sizes[0])]


def _learns(strategy: str) -> bool:
    """Whether the strategy learns from features."""
    return strategy not in ("statistical", "foundation")


def select_calendar(frequency: str | None, n: int, strategy: str) -> list[str]:
    """The features of the frequency's unit, and the month where clock steps cover two years."""
    if not (_learns(strategy) and frequency and n >= MIN_CALENDAR_ROWS):
        return []
    freq = Freq.parse(frequency)
    two_years = 2 * ROWS_A_YEAR.get(freq.unit, math.inf) / freq.n
    return CALENDAR.get(freq.unit, []) + ["month"] * (n >= two_years)


def calendar_encoding(estimator: str | None, strategy: str) -> str | None:
    return None if strategy in ("statistical", "foundation") or estimator in TREES else "cyclical"


def select_metric(profile: DataProfile, strategy: str) -> tuple[str, list[str]]:
    """The ranking metric, and those to compute; shares are unsafe for series that come near zero."""
    return ("mase" if profile.n_series > 1 else "mae"), ["mae", "mse", "mase"] + ([] if profile.near_zero else ["mape"])


def drops_null(profile: DataProfile, estimator: str | None, strategy: str) -> bool:
    missing = profile.has_gaps or profile.missing > 0
    return strategy not in ("statistical", "foundation") and missing and estimator not in NULL_TOLERANT


def preprocessing(profile: DataProfile) -> list[str]:
    steps = []
    if profile.has_duplicates:
        steps.append("keep the first row of repeated timestamps")
    if not profile.frequency:
        steps.append("name the sampling frequency")
    if profile.has_gaps:
        steps.append("align each series with its regular grid")
    if profile.missing:
        steps.append("fill or drop missing values")
    if profile.categorical_exog:
        steps.append("encode categorical columns: " + ", ".join(profile.categorical_exog))
    return steps


def warnings_of(profile_rows: int, frequency: str | None, missing: int, n_series: int) -> list[str]:
    out = []
    if profile_rows < 50:
        out.append(f"the shortest series has {profile_rows} rows, fewer than 50")
    if frequency is None:
        out.append("no regular frequency was found")
    if profile_rows and missing / (profile_rows * max(1, n_series)) > 0.2:
        out.append("more than a fifth of the values are missing")
    return out


def check_shape(profile: DataProfile, strategy: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    if strategy in ("recursive", "direct", "statistical", "foundation") and profile.n_series != 1:
        raise ValueError(f"{strategy} takes one series; the data have {profile.n_series}")
    if strategy == "multivariate" and (profile.shortest != profile.longest or profile.latest_start != profile.start):
        raise ValueError("multivariate takes series of equal lengths that start together")


def resolve_test_rows(size: int | float, n: int) -> int:
    """Test rows of a count or a share (rounded half to even, at least 1, at most n - 1)."""
    if isinstance(size, bool):
        raise TypeError("the test size is a number")
    if isinstance(size, int):
        if not 1 <= size <= n - 1:
            raise ValueError(f"the test size is within 1 and {n - 1}")
        return size
    if not 0 < size < 1:
        raise ValueError("a share is between 0 and 1")
    return min(max(round(n * size), 1), n - 1)


def check_end_train(end: datetime, start: datetime, last: datetime) -> datetime:
    if not start < end <= last:
        raise ValueError("training ends after the first timestamp and by the last")
    return end


def cv_defaults(span: int, reach: int, steps: int) -> CVParams:
    """The first 70 % train, at least what features and one horizon need, leaving two horizons to test."""
    initial = max(int(0.7 * span), reach + steps if reach else 2 * steps)
    if span - 2 * steps > 0:
        initial = min(initial, span - 2 * steps)
    return CVParams(initial=initial, steps=steps)


def count_folds(span: int, cv: CVParams) -> int:
    stride = cv.stride or cv.steps
    n = max(0, math.ceil((span - cv.initial - cv.gap) / stride))
    if n < 2:
        raise ValueError(f"{span} rows give {n} folds; at least 2 are needed")
    return n
