"""Missing and negative values, and outliers by quartiles or by Mahalanobis distance."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidewright.functions.chi2 import chi2_quantile
from tidewright.operators.quantiles import quantiles
from tidewright.session import materialize


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def non_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose checked columns are all known and at least zero (NaN does not count as known)."""
    kinds = dict(df.dtypes)
    tests = [(F.col(c) >= 0) & ~F.isnan(c) if kinds[c] in ("double", "float") else F.col(c) >= 0
             for c in columns]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def negative_examples(df: DataFrame, columns: Sequence[str], order: Sequence[str],
                      count: int = 5) -> DataFrame:
    """The first negative values of each column, in row order."""
    long = df.unpivot(list(order), [F.col(c).cast("double").alias(c) for c in columns],
                      "variable", "value")
    rank = F.row_number().over(Window.partitionBy("variable").orderBy(*order))
    return long.where(F.col("value") < 0).withColumn("rank", rank).where(F.col("rank") <= count)


def varying_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns whose standard deviation is above zero."""
    row = df.agg(*[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[f"s{i}"] is not None and row[f"s{i}"] > 0]


def drop_constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*set(columns).difference(varying_columns(df, columns)))


def iqr_bounds(df: DataFrame, column: str, factor: float = 1.5,
               at_most: int | None = None) -> tuple[float, float] | None:
    q1, q3 = quantiles(df, [column], [0.25, 0.75], at_most=at_most)[column]
    if q1 is None:
        return None
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def remove_outliers_iqr(df: DataFrame, columns: Sequence[str], factor: float = 1.5, stage: bool = True) -> DataFrame:
    """Column after column; the bounds of one come from the rows the earlier ones left.

    With ``stage`` the rows are written once, so that what made them runs once and every
    pass reads the columns it needs.
    """
    if stage:
        df = materialize(df, "outliers")
    rows = df.count()
    for column in columns:
        bounds = iqr_bounds(df, column, factor, rows)
        if bounds is None:
            return df.where(F.lit(False))
        df = df.where(F.col(column).between(*bounds))
    return df


@dataclass(frozen=True)
class Moments:
    columns: tuple[str, ...]
    mean: np.ndarray
    cov: np.ndarray


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Mean vector and sample covariance in one aggregate over complete rows."""
    k = len(columns)
    complete = drop_missing(df.select(*columns))
    row = complete.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)],
    ).first()
    mean = np.array([row[f"m{i}"] for i in range(k)], dtype=float)
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    return Moments(tuple(columns), mean, cov)


def mahalanobis_distance(m: Moments, inverse: np.ndarray) -> Column:
    """Distance from the mean as one arithmetic expression."""
    diffs = [F.col(c) - F.lit(float(mu)) for c, mu in zip(m.columns, m.mean)]
    k = len(diffs)
    terms = [diffs[i] * diffs[j] * float(inverse[i, j] if i == j else inverse[i, j] + inverse[j, i])
             for i in range(k) for j in range(i, k)]
    return F.sqrt(F.greatest(reduce(lambda a, b: a + b, terms), F.lit(0.0)))


def remove_outliers_mahalanobis(df: DataFrame, columns: Sequence[str], quantile: float = 0.99,
                                stage: bool = True) -> DataFrame:
    """Keep rows whose distance is at most the given quantile of all distances; ``stage`` as above."""
    if stage:
        df = materialize(df, "outliers")
    m = moments(df, columns)
    try:
        inverse = np.linalg.inv(m.cov)
    except np.linalg.LinAlgError as error:
        raise ValueError(f"the covariance of {list(columns)} cannot be inverted") from error
    scored = df.withColumn("_distance", mahalanobis_distance(m, inverse))
    threshold = quantiles(scored, ["_distance"], [quantile])["_distance"][0]
    if threshold is None:
        return df.where(F.lit(False))
    return scored.where(F.col("_distance") <= threshold).drop("_distance")


def flag_mahalanobis(df: DataFrame, columns: Sequence[str], quantile: float = 0.99,
                     keep: Sequence[str] = ()) -> DataFrame:
    """Distance and outlier flag against the chi-square threshold, for complete rows.

    Constant columns take no part; a singular covariance is inverted in the
    least-squares sense.
    """
    df = materialize(df.select(*keep, *[c for c in columns if c not in keep]), "outliers")
    used = varying_columns(df, columns)
    complete = drop_missing(df.select(*keep, *used), used)
    m = moments(complete, used)
    try:
        inverse = np.linalg.inv(m.cov)
    except np.linalg.LinAlgError:
        inverse = np.linalg.pinv(m.cov)
    threshold = math.sqrt(chi2_quantile(quantile, len(used)))
    scored = complete.withColumn("distance", mahalanobis_distance(m, inverse))
    return scored.withColumn("outlier", F.col("distance") > threshold)


@dataclass(frozen=True)
class CleaningOptions:
    """Which steps to run; ``outliers`` is 'iqr', 'mahalanobis', 'both' or None.

    Outlier steps read their input once per column. With ``stage`` the rows the simple
    filters leave are written once, so that those passes read only the columns they need.
    """

    missing: bool = True
    negative: bool = True
    outliers: str | None = "both"
    iqr_factor: float = 1.5
    quantile: float = 0.99
    stage: bool = True

    def __post_init__(self):
        if self.outliers not in (None, "iqr", "mahalanobis", "both"):
            raise ValueError(f"unknown outlier method {self.outliers!r}")


def cleaning_steps(columns: Sequence[str], options: CleaningOptions = CleaningOptions()):
    """The chosen steps as (name, function) pairs, in the order they run."""
    steps = []
    if options.missing:
        steps.append(("missing", drop_missing))
    if options.negative:
        steps.append(("negative", lambda df: non_negative(df, columns)))
    if options.outliers in ("iqr", "both"):
        steps.append(("iqr", lambda df: remove_outliers_iqr(df, columns, options.iqr_factor, False)))
    if options.outliers in ("mahalanobis", "both"):
        steps.append(("mahalanobis", lambda df: remove_outliers_mahalanobis(df, columns, options.quantile, False)))
    return steps


def clean(df: DataFrame, columns: Sequence[str], options: CleaningOptions = CleaningOptions()) -> DataFrame:
    staged = not options.stage
    for name, step in cleaning_steps(columns, options):
        if name in ("iqr", "mahalanobis") and not staged:
            df, staged = materialize(df, "cleaning"), True
        df = df.transform(step)
    return df


def audited_clean(df: DataFrame, columns: Sequence[str],
                  options: CleaningOptions = CleaningOptions()) -> tuple[DataFrame, DataFrame]:
    """The cleaned rows, written once, and the rows left after each step, counted in the same run."""
    counters = [("input", Observation())]
    rows = F.count(F.lit(1)).alias("rows")
    df, staged = df.observe(counters[0][1], rows), not options.stage
    for name, step in cleaning_steps(columns, options):
        if name in ("iqr", "mahalanobis") and not staged:
            df, staged = materialize(df, "cleaning"), True
        counters.append((name, Observation()))
        df = df.transform(step).observe(counters[-1][1], rows)
    cleaned = materialize(df, "cleaned")
    table = [(i, name, counter.get["rows"]) for i, (name, counter) in enumerate(counters)]
    return cleaned, df.sparkSession.createDataFrame(table, "step long, name string, rows long")


def cleaning_audit(df: DataFrame, columns: Sequence[str],
                   options: CleaningOptions = CleaningOptions()) -> DataFrame:
    """Rows left after each step."""
    return audited_clean(df, columns, options)[1]
