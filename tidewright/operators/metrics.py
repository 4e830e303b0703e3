"""Regression metrics, alignment of forecasts, and result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_columns(truth: str, prediction: str) -> list[Column]:
    """R2, RMSE and MAE as aggregates. A constant target scores 1 if it is met exactly, else 0."""
    error = F.col(truth) - F.col(prediction)
    squared = F.sum(error * error)
    spread = F.var_pop(truth) * F.count(truth)
    r2 = F.when(spread == 0, F.when(squared == 0, 1.0).otherwise(0.0)).otherwise(1 - squared / spread)
    return [r2.alias("r2"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae")]


def regression_metrics(scored: DataFrame, truth: str = "label", prediction: str = "prediction",
                       by: Sequence[str] = ()) -> DataFrame:
    """One row of metrics per group, over rows where truth and prediction are known."""
    known = scored.where(F.col(truth).isNotNull() & F.col(prediction).isNotNull())
    return known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *metric_columns(truth, prediction))


def align_forecast(actual: DataFrame, forecast: DataFrame, on: Sequence[str]) -> DataFrame:
    """Actual next to forecast, only where both exist."""
    return actual.join(forecast, list(on)).na.drop("any")


def wide_metrics(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Train and test metrics side by side: train_r2, test_r2, ..."""
    wide = metrics.groupBy(*by).pivot("split", ["train", "test"]).agg(
        F.first("r2").alias("r2"), F.first("rmse").alias("rmse"),
        F.first("mae").alias("mae"), F.first("n").alias("n"))
    return wide


def distinct_groups(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


def mean_absolute(df: DataFrame, columns: Sequence[str], name: str = "feature",
                  value: str = "importance") -> DataFrame:
    """Mean absolute value of each column, one row per column."""
    row = df.agg(*[F.avg(F.abs(c)).alias(c) for c in columns])
    return row.unpivot([], list(columns), name, value)
