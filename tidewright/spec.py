"""Plain descriptions of series, periods and feature plans, checked when they are made."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Names of rolling statistics and the suffix each one gets.
ROLLING_SUFFIX = {"mean": "roll", "std": "std", "min": "min", "max": "max", "median": "med"}

AUTO = "AUTO_FEATURES"

_MMDD = re.compile(r"^(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$")


@dataclass(frozen=True)
class SeriesSpec:
    """Which column is time, what breaks ties, what separates series, what is predicted."""

    time: str = "ts"
    ties: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    target: str | None = None
    features: tuple[str, ...] = ()

    @property
    def order(self) -> tuple[str, ...]:
        return (self.time, *self.ties)


@dataclass(frozen=True)
class Period:
    """A season given by month and day, both ends included, in every year."""

    name: str
    start: str
    end: str
    description: str = ""

    def __post_init__(self):
        for bound in (self.start, self.end):
            if not _MMDD.match(bound):
                raise ValueError(f"period {self.name!r}: {bound!r} is not MM-DD")


@dataclass(frozen=True)
class DateRange:
    """An absolute period; the end date means its first instant."""

    name: str
    start: str
    end: str


def _check_steps(plan: dict[str, list[int]], what: str) -> None:
    for column, steps in plan.items():
        if not isinstance(steps, (list, tuple)):
            raise ValueError(f"{what} of {column!r} must be a list")
        for step in steps:
            if isinstance(step, bool) or not isinstance(step, int) or step <= 0:
                raise ValueError(f"{what} of {column!r}: {step!r} is not a positive whole number")


@dataclass(frozen=True)
class FeaturePlan:
    """Lags and rolling windows per column, and which cyclic time features to add."""

    lags: dict[str, list[int]] = field(default_factory=dict)
    windows: dict[str, list[int]] = field(default_factory=dict)
    statistics: tuple[str, ...] = ("mean", "std")
    hour: bool = True
    day_of_year: bool = True

    def __post_init__(self):
        _check_steps(self.lags, "lags")
        _check_steps(self.windows, "windows")
        unknown = set(self.statistics) - set(ROLLING_SUFFIX)
        if unknown:
            raise ValueError(f"unknown rolling statistics: {sorted(unknown)}")

    @property
    def halo(self) -> int:
        """How many earlier rows a feature of one row can depend on."""
        lag = max((k for steps in self.lags.values() for k in steps), default=0)
        window = max((w for steps in self.windows.values() for w in steps), default=1)
        return max(lag, window - 1)

    def names(self, columns: list[str], full: bool = False) -> list[str]:
        """Names of the columns the plan adds to a frame with ``columns``, in order.

        ``full`` asks for the names of the variant whose windows must be full.
        """
        out = []
        if self.hour:
            out += ["hour_sin", "hour_cos"]
        if self.day_of_year:
            out += ["doy_sin", "doy_cos"]
        out += [f"{c}_lag{k}" for c, steps in self.lags.items() if c in columns for k in steps]
        out += [
            f"{c}_roll{w}_{s}" if full else f"{c}_{ROLLING_SUFFIX[s]}{w}"
            for c, steps in self.windows.items()
            if c in columns
            for w in steps
            for s in ROLLING_SUFFIX
            if s in self.statistics
        ]
        return out


def expand_auto(steps: dict[str, list[int]], features: list[str]) -> dict[str, list[int]]:
    """Spread the entry for all features over ``features``; explicit entries win."""
    if AUTO not in steps:
        return dict(steps)
    explicit = {c: v for c, v in steps.items() if c != AUTO}
    return {**{c: steps[AUTO] for c in features}, **explicit}


def lookup_override(overrides: dict, model: str, period: str, default):
    """Value for (model, period) if one is given, else the default."""
    return overrides.get(model, {}).get(period, default)
