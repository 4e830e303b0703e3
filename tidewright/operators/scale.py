"""Scalers: statistics from the train rows, applied as column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.quantiles import quantiles


@dataclass(frozen=True)
class Scaler:
    """(column - center) / width; a column without spread is only centered."""

    center: dict[str, float]
    width: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(self.center[c])) / F.lit(self.width[c] or 1.0) for c in self.center
        })


def _two_aggregates(train, columns, center, width):
    row = train.agg(*[center(c).alias(f"a{i}") for i, c in enumerate(columns)],
                    *[width(c).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    empty = [c for i, c in enumerate(columns) if row[f"a{i}"] is None]
    if empty:
        raise ValueError(f"no known values to scale by in {empty}")
    return Scaler({c: float(row[f"a{i}"]) for i, c in enumerate(columns)},
                  {c: float(row[f"b{i}"] or 0.0) for i, c in enumerate(columns)})


def standard_scaler(train: DataFrame, columns: Sequence[str]) -> Scaler:
    """Mean and population standard deviation."""
    return _two_aggregates(train, columns, F.avg, F.stddev_pop)


def minmax_scaler(train: DataFrame, columns: Sequence[str]) -> Scaler:
    return _two_aggregates(train, columns, F.min, lambda c: F.max(c) - F.min(c))


def robust_scaler(train: DataFrame, columns: Sequence[str]) -> Scaler:
    """Median and interquartile range."""
    cuts = quantiles(train, columns, [0.25, 0.5, 0.75])
    empty = [c for c, q in cuts.items() if q[1] is None]
    if empty:
        raise ValueError(f"no known values to scale by in {empty}")
    return Scaler({c: q[1] for c, q in cuts.items()}, {c: q[2] - q[0] for c, q in cuts.items()})


SCALERS = {"standard": standard_scaler, "minmax": minmax_scaler, "robust": robust_scaler}


def zscore(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distance from the mean in sample standard deviations."""
    return _two_aggregates(df, columns, F.avg, F.stddev_samp).transform(df)
