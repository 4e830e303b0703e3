"""User steps: named functions from a frame to a frame, registered in code and chained."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

KINDS = ("features", "preprocessing", "evaluation")


@dataclass(frozen=True)
class Step:
    """``run`` maps a frame to a frame; an evaluation step maps a scored frame to a metrics frame."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    kind: str = "features"
    enabled: bool = True
    names: Callable[[list[str]], list[str]] | None = None
    needs: tuple[str, ...] = ()
    check: Callable[[], bool] | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"step {self.name!r}: unknown kind {self.kind!r}")

    def __call__(self, df: DataFrame) -> DataFrame:
        if not self.enabled:
            return df
        missing = [c for c in self.needs if c not in df.columns]
        if missing:
            raise ValueError(f"step {self.name!r} needs the columns {missing}")
        return self.run(df)

    def feature_names(self, columns: Sequence[str]) -> list[str]:
        """Names the step adds, known before anything runs."""
        return self.names(list(columns)) if self.names else []


class Registry:
    """Steps by name."""

    def __init__(self):
        self._steps: dict[str, Step] = {}

    def register(self, step: Step) -> None:
        if not isinstance(step, Step):
            raise TypeError(f"not a step: {step!r}")
        if step.name in self._steps:
            warnings.warn(f"step {step.name!r} is replaced", stacklevel=2)
        self._steps[step.name] = step

    def get(self, name: str) -> Step | None:
        return self._steps.get(name)

    def of_kind(self, kind: str) -> list[Step]:
        return [s for s in self._steps.values() if s.kind == kind]

    def all(self) -> dict[str, Step]:
        return dict(self._steps)

    def run(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self._steps:
            raise KeyError(f"no step named {name!r}")
        return df.transform(self._steps[name])

    def run_chain(self, names: Sequence[str], df: DataFrame) -> DataFrame:
        """The steps one after the other. Steps are lazy, but those that number rows count them, each for itself."""
        return reduce(lambda frame, name: self.run(name, frame), names, df)

    def invalid(self) -> list[str]:
        """Names of the steps whose own check fails or raises."""
        bad = []
        for step in self._steps.values():
            try:
                if step.check and not step.check():
                    bad.append(step.name)
            except ValueError:
                bad.append(step.name)
        return bad
