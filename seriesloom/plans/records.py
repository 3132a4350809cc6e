"""Records of a profile and a plan."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from datetime import datetime
from typing import Protocol, runtime_checkable


def _plain(value):
    return value.isoformat() if isinstance(value, datetime) else value


def _known(cls, values: dict) -> dict:
    names = {f.name for f in fields(cls)}
    unknown = sorted(set(values) - names)
    if unknown:
        raise ValueError(f"{cls.__name__} has no {', '.join(unknown)}")
    out = dict(values)
    for name in ("start", "end", "latest_start", "end_train"):
        if isinstance(out.get(name), str):
            out[name] = datetime.fromisoformat(out[name])
    return out


@dataclass(frozen=True)
class DataProfile:
    """What the data are: roles, ranges, quality. All of it is one row, however many series there are."""

    format: str
    n_series: int
    target: str | list[str]
    frequency: str | None
    span: int
    n_observations: int
    has_gaps: bool
    has_duplicates: bool
    shortest: int
    longest: int
    missing: int = 0
    start: datetime | None = None
    end: datetime | None = None
    latest_start: datetime | None = None
    near_zero: bool = False
    frequency_is_set: bool = False
    exog: list[str] = field(default_factory=list)
    categorical_exog: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {k: _plain(v) for k, v in asdict(self).items()}

    @staticmethod
    def from_dict(values: dict) -> DataProfile:
        return DataProfile(**_known(DataProfile, values))


@dataclass(frozen=True)
class ForecastPlan:
    """What is to be run: strategy, estimator, features, metric."""

    strategy: str
    estimator: str | None
    lags: list[int]
    windows: list[tuple[str, int]]
    calendar: list[str]
    calendar_encoding: str | None
    metric: str
    metrics: list[str]
    scale: bool
    drop_null: bool
    season: int | None
    steps: int
    frequency: str | None
    interval: tuple[float, float] | None = None
    end_train: datetime | None = None
    alpha: float = 1.0
    preprocessing: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    explanation: str = ""
    exog: list[str] = field(default_factory=list)
    categorical_exog: list[str] = field(default_factory=list)
    differentiation: int = 0
    encode_series: bool = False
    interval_method: str | None = None
    params: dict = field(default_factory=dict)
    residual_bins: int = 0
    transform: str | None = None

    def to_dict(self) -> dict:
        return {k: _plain(v) for k, v in asdict(self).items()}

    @staticmethod
    def from_dict(values: dict) -> ForecastPlan:
        """A plan from a record bundle, such as one read from JSON."""
        values = _known(ForecastPlan, values)
        values["windows"] = [tuple(w) for w in values.get("windows") or []]
        if values.get("interval"):
            values["interval"] = tuple(values["interval"])
        return ForecastPlan(**values)


@runtime_checkable
class Explainable(Protocol):
    """Any result that can say how it came about, ours or another library's."""

    def explain(self) -> str: ...


@dataclass(frozen=True)
class CVParams:
    initial: int
    steps: int
    stride: int | None = None
    gap: int = 0
    fixed_train: bool = False
    refit: bool | int = True
    allow_incomplete: bool = True
    skip: int | list[int] | None = None


@dataclass
class CandidateFailure:
    name: str
    error_type: str
    message: str
    traceback: str

    def summary(self) -> str:
        first = self.message.strip().splitlines()[0] if self.message.strip() else ""
        return f"{self.error_type}: {first}"[:200]


class AllCandidatesFailedError(RuntimeError):
    def __init__(self, failures: list[CandidateFailure]):
        super().__init__("all candidates failed: " + "; ".join(f"{f.name}: {f.summary()}" for f in failures))
        self.failures = failures
