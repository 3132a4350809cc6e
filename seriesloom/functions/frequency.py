"""Sampling frequencies as a step of calendar or clock units."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of clock units, and the weekday (Monday 1) that anchors weeks.
CLOCK = {"s": 1, "min": 60, "h": 3600, "D": 86400}
WEEKDAYS = {"MON": 1, "TUE": 2, "WED": 3, "THU": 4, "FRI": 5, "SAT": 6, "SUN": 7}
MONTHS = {"M": 1, "Q": 3, "Y": 12}


@dataclass(frozen=True)
class Freq:
    """``n`` units; ``end`` marks period-end months, quarters and years; ``anchor`` the weekday of weeks."""

    n: int
    unit: str
    end: bool = False
    anchor: str | None = None

    @staticmethod
    def parse(alias: str) -> Freq:
        """From aliases such as ``D``, ``15min``, ``W-SUN``, ``MS``, ``QE``, ``B``."""
        m = re.fullmatch(r"(\d*)([A-Za-z]+)(?:-([A-Za-z]+))?", alias.strip())
        if not m:
            raise ValueError(f"unknown frequency {alias!r}")
        n, base, anchor = int(m[1] or 1), m[2], m[3].upper() if m[3] else None
        if n < 1:
            raise ValueError(f"unknown frequency {alias!r}")
        if base in ("s", "min", "h", "D"):
            return Freq(n, base)
        low = {"T": "min", "H": "h", "S": "s"}
        if base in low:
            return Freq(n, low[base])
        if base == "B":
            return Freq(n, "B")
        if base == "W":
            return Freq(n, "W", anchor=anchor or "SUN")
        if base[0] in "MQYA" and base[1:] in ("", "S", "E"):
            return Freq(n, "Y" if base[0] == "A" else base[0], end=base[1:] != "S")
        raise ValueError(f"unknown frequency {alias!r}")

    @property
    def seconds(self) -> int | None:
        """The length of a fixed step, None for months and business days."""
        if self.unit in CLOCK:
            return self.n * CLOCK[self.unit]
        return self.n * 7 * 86400 if self.unit == "W" else None

    @property
    def interval(self) -> str:
        if self.unit in MONTHS:
            return f"INTERVAL {self.n * MONTHS[self.unit]} MONTH"
        return f"INTERVAL {self.seconds or 86400} SECOND"

    def grid(self, first: Column, last: Column) -> Column:
        """Array of the grid's timestamps (without zone) from ``first`` to ``last``."""
        first, last = first.cast("timestamp_ntz"), last.cast("timestamp_ntz")
        step = F.expr(self.interval)
        if self.unit in MONTHS and self.end:
            months = F.sequence(F.date_trunc("month", first).cast("timestamp_ntz"), F.date_trunc("month", last).cast("timestamp_ntz"), step)
            return F.transform(months, lambda t: F.last_day(t).cast("timestamp_ntz"))
        out = F.sequence(first, last, step)
        if self.unit == "B":
            out = F.filter(out, lambda t: F.weekday(t) < 5)
        return out

    def shift(self, ts: Column, steps: int | Column) -> Column:
        """``ts`` moved by whole steps."""
        steps = F.lit(steps) if isinstance(steps, int) else steps
        ts = ts.cast("timestamp_ntz")
        if self.unit in MONTHS:
            moved = F.add_months(ts, (steps * (self.n * MONTHS[self.unit])).cast("int"))
            return (F.last_day(moved) if self.end else moved).cast("timestamp_ntz")
        if self.unit == "B":
            day = F.weekday(ts)
            ahead = day + steps * self.n
            return F.date_add(ts.cast("date"), (steps * self.n + 2 * F.floor(ahead / 5)).cast("int")).cast("timestamp_ntz")
        return seconds_on(ts, steps * self.seconds).cast("timestamp_ntz")


def seconds_between(first: Column, last: Column) -> Column:
    """Whole seconds from ``first`` to ``last``, by their clocks, whatever zone the session has."""
    clock = lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    first, last = first.cast("timestamp_ntz"), last.cast("timestamp_ntz")
    return F.datediff(last, first).cast("long") * 86400 + clock(last) - clock(first)


def seconds_on(ts: Column, seconds: Column) -> Column:
    """``ts`` and that many seconds, by its clock."""
    return ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


# Seasonal periods of calendar frequencies, before division by the multiple.
CALENDAR_SEASONS = {"B": (5, 252), "W": (52,), "M": (12,), "Q": (4,), "Y": (1,)}
CYCLES = (3600, 86400, 604800, 31536000)


def seasonal_periods(freq: Freq | None) -> list[int]:
    """Seasonal periods in steps, short to long; of a clock frequency the first two of hour, day, week and year."""
    if freq is None:
        return []
    if freq.unit in CALENDAR_SEASONS:
        return [p // freq.n for p in CALENDAR_SEASONS[freq.unit] if p // freq.n >= 1]
    periods = [c // freq.seconds for c in CYCLES if c % freq.seconds == 0 or c // freq.seconds >= 2]
    return [p for p in periods if p >= 2][:2]
