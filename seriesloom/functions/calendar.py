"""Calendar features of a timestamp column, raw, cyclical or one-hot."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The period of each cyclical feature; year and weekend are never encoded.
PERIODS = {"month": 12, "week": 53, "day_of_week": 7, "day_of_month": 31, "day_of_year": 366, "hour": 24, "minute": 60, "second": 60, "quarter": 4}
CATEGORIES = {"month": range(1, 13), "day_of_week": range(7), "quarter": range(1, 5), "hour": range(24)}


def raw(name: str, ts: Column) -> Column:
    """One feature as an integer: days of the week from Monday 0, ISO weeks, weekend as 0 or 1."""
    builders = {
        "year": F.year,
        "quarter": F.quarter,
        "month": F.month,
        "week": F.weekofyear,
        "day_of_week": F.weekday,
        "day_of_month": F.dayofmonth,
        "day_of_year": F.dayofyear,
        "hour": F.hour,
        "minute": F.minute,
        "second": F.second,
        "weekend": lambda t: (F.weekday(t) >= 5).cast("int"),
    }
    if name not in builders:
        raise ValueError(f"unknown calendar feature {name!r}; known: {', '.join(builders)}")
    return builders[name](ts).cast("long")


def cyclical(name: str, ts: Column) -> dict[str, Column]:
    if name not in PERIODS:
        return {name: raw(name, ts)}
    angle = raw(name, ts) * (2 * math.pi / PERIODS[name])
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def onehot(name: str, ts: Column) -> dict[str, Column]:
    if name not in CATEGORIES:
        return {name: raw(name, ts)}
    value = raw(name, ts)
    return {f"{name}_{c}": (value == c).cast("long") for c in CATEGORIES[name]}


def periodic_spline(name: str, ts: Column, knots: int = 6) -> dict[str, Column]:
    """Periodic cubic B-splines on ``knots`` equal knots over the feature's period, as built-in expressions.

    The splines are not negative and add up to 1; each is the cardinal cubic around its knot.
    """
    if name not in PERIODS:
        return {name: raw(name, ts)}
    if knots < 4:
        raise ValueError("cubic splines need four knots or more")
    at = raw(name, ts) * (knots / PERIODS[name])
    out = {}
    for i in range(knots):
        turn = F.pmod(at - i, F.lit(float(knots)))
        gap = F.least(turn, F.lit(float(knots)) - turn)
        near = (4 - 6 * gap * gap + 3 * gap * gap * gap) / 6
        far = F.pow(2 - gap, F.lit(3)) / 6
        out[f"{name}_spline_{i}"] = F.when(gap < 1, near).when(gap < 2, far).otherwise(0.0)
    return out


def add_calendar(df: DataFrame, features: list[str], encoding: str | None = None, ts: str = "ts") -> DataFrame:
    """Append calendar features; ``encoding`` is None, cyclical, onehot or spline."""
    build = {None: lambda n, t: {n: raw(n, t)}, "cyclical": cyclical, "onehot": onehot, "spline": periodic_spline}[encoding]
    columns: dict[str, Column] = {}
    for name in features:
        columns |= build(name, F.col(ts))
    return df.withColumns(columns) if columns else df
