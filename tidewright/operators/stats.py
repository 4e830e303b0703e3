"""Profiles, summaries, correlations and distributions. One aggregate per question."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.clean import moments
from tidewright.operators.columns import numeric_columns
from tidewright.operators.quantiles import quantiles


def _long(row: DataFrame, names: Sequence[str], parts: dict[str, str]) -> DataFrame:
    """One-row frame with columns ``{part}{i}`` to one row per name; a missing part is NULL."""
    entries = [F.struct(F.lit(name).alias("column"), *[
        (F.col(f"{p}{i}") if f"{p}{i}" in row.columns else F.lit(None)).cast(t).alias(p)
        for p, t in parts.items()]) for i, name in enumerate(names)]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def missing_count(df: DataFrame, column: str) -> Column:
    empty = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        empty = empty | F.isnan(column)
    return F.coalesce(F.sum(empty.cast("long")), F.lit(0))


def distinct_counts(df: DataFrame) -> dict[int, int]:
    """Exact number of known values of each column, by its place.

    Rows become (place, value) pairs that are combined before the shuffle, so a wide table is
    not copied whole for each of its columns.
    """
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    # Adding zero makes one number of 0.0 and -0.0.
    value = lambda c: ((F.col(c) + 0.0) if c in floats else F.col(c)).cast("string")
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), value(c).alias("v")) for i, c in enumerate(df.columns)])).alias("p")).select("p.*")
    found = pairs.where(F.col("v").isNotNull()).distinct().groupBy("i").count().collect()
    return {r["i"]: r["count"] for r in found}


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, missing and distinct counts of every column; mean, spread and range of numeric ones."""
    numeric = set(numeric_columns(df))
    exact = {} if approximate else distinct_counts(df)
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        unique = F.approx_count_distinct(c) if approximate else F.lit(exact.get(i, 0)).cast("long")
        aggregates += [missing_count(df, c).alias(f"null_count{i}"), unique.alias(f"unique_count{i}")]
        if c in numeric:
            aggregates += [F.avg(c).alias(f"mean{i}"), F.stddev_samp(c).alias(f"std{i}"),
                           F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}")]
    row = df.agg(*aggregates)
    shares = {f"null_percentage{i}": F.when(F.col("_rows") > 0, F.col(f"null_count{i}") / F.col("_rows") * 100)
              for i in range(len(df.columns))}
    parts = {"null_count": "long", "null_percentage": "double", "unique_count": "long",
             "mean": "double", "std": "double", "min": "double", "max": "double"}
    kinds = F.create_map(*[F.lit(x) for c, t in df.dtypes for x in (c, t)])
    return _long(row.withColumns(shares), df.columns, parts).withColumn("dtype", kinds[F.col("column")])


def missing_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values per column, as a count and as a rounded percentage."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[missing_count(df, c).alias(f"missing{i}") for i, c in enumerate(columns)])
    shares = {f"percentage{i}": F.round(F.col(f"missing{i}") / F.col("_rows") * 100, 2)
              for i in range(len(columns))}
    return _long(row.withColumns(shares), columns, {"missing": "long", "percentage": "double"})


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns and missing cells of the whole table."""
    cells = reduce(lambda a, b: a + b, [missing_count(df, c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"),
                  cells.alias("missing_cells"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of equal rows."""
    return df.groupBy(*df.columns).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def negative_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[F.coalesce(F.sum((F.col(c) < 0).cast("long")), F.lit(0)).alias(f"negative{i}")
                   for i, c in enumerate(columns)])
    return _long(row, columns, {"negative": "long"})


def sample_kurtosis(column: str) -> Column:
    """Excess kurtosis with the small-sample correction; missing below four values."""
    n = F.count(column).cast("double")
    corrected = ((n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * F.kurtosis(column) + 6)
    return F.when(F.count(column) > 3, corrected)


def summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spread, kurtosis, extremes, mean, median and range, rounded to three digits.

    Two passes: one for everything but the medians, whose row counts the second one needs.
    """
    parts = {"std": F.stddev_samp, "kurtosis": sample_kurtosis, "max": F.max, "min": F.min, "mean": F.avg}
    row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
                 *[f(c).cast("double").alias(f"{p}{i}") for i, c in enumerate(columns) for p, f in parts.items()]).first()
    medians = quantiles(df, columns, [0.5], at_most=max(row[f"n{i}"] for i in range(len(columns))))
    table = [(c, *[row[f"{p}{i}"] for p in parts], medians[c][0]) for i, c in enumerate(columns)]
    schema = "column string, " + ", ".join(f"{p} double" for p in [*parts, "median"])
    out = df.sparkSession.createDataFrame(table, schema).withColumn("range", F.col("max") - F.col("min"))
    shown = ["std", "kurtosis", "max", "min", "mean", "median", "range"]
    return out.select("column", *[F.round(p, 3).alias(p) for p in shown])


def target_stats(df: DataFrame, target: str) -> DataFrame:
    """Count, mean, spread, extremes and quartiles of the known target values."""
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = df.agg(*[f(target).alias(p) for p, f in parts.items()]).first()
    q25, q50, q75 = quantiles(df, [target], [0.25, 0.5, 0.75], at_most=row["count"])[target]
    known = lambda v: None if v is None else float(v)
    table = [(row["count"], known(row["mean"]), row["std"], known(row["min"]), q25, q50, q75, known(row["max"]))]
    return df.sparkSession.createDataFrame(
        table, "count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    cuts = quantiles(df, columns, probs)
    rows = [(c, float(p), v) for c in columns for p, v in zip(probs, cuts[c])]
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, each over the rows where both are known."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(x).alias("row"), F.lit(y).alias("col"), F.col(f"r{i}").alias("corr"))
               for i, (a, b) in enumerate(pairs) for x, y in {(a, b), (b, a)}]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def target_correlation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Correlation of each feature with the target, strongest first."""
    row = df.agg(*[F.corr(c, target).alias(c) for c in features])
    return row.unpivot([], list(features), "feature", "correlation") \
        .orderBy(F.abs("correlation").desc(), "feature")


def covariance_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, sample covariance and its inverse, one row per pair of columns."""
    m = moments(df, columns)
    inverse = np.linalg.inv(m.cov)
    rows = [(a, b, float(m.mean[i]), float(m.cov[i, j]), float(inverse[i, j]))
            for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(
        rows, "row string, col string, row_mean double, cov double, inverse double")


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Counts of equal-width bins from minimum to maximum; the maximum lies in the last bin."""
    spark = df.sparkSession
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return spark.createDataFrame([], "bin long, low double, high double, count long")
    width = (high - low) / bins or 1.0
    number = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    counted = df.where(F.col(column).isNotNull()).groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    edges = spark.range(bins).withColumnRenamed("id", "bin")
    return edges.join(counted, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def kernel_density(df: DataFrame, column: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian density on an even grid that reaches ``cut`` bandwidths past the data (Scott's rule).

    Every task adds up its rows' share of the grid, so only ``points`` numbers
    per task are shuffled.
    """
    spark = df.sparkSession
    low, high, std, n = df.agg(F.min(column), F.max(column), F.stddev_samp(column), F.count(column)).first()
    if not n or not std:
        return spark.createDataFrame([], "point long, x double, density double")
    bandwidth = std * n ** -0.2
    start, end = low - cut * bandwidth, high + cut * bandwidth
    grid = start + (end - start) / (points - 1) * np.arange(points)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(points)
        for batch in batches:
            values = batch["v"].to_numpy()
            for part in np.array_split(values, max(1, len(values) // 4096)):
                total += np.exp(-0.5 * ((grid[:, None] - part[None, :]) / bandwidth) ** 2).sum(axis=1)
        yield pd.DataFrame({"point": np.arange(points), "x": grid, "part": total})

    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    scale = 1.0 / (n * bandwidth * float(np.sqrt(2 * np.pi)))
    return values.mapInPandas(partial, "point long, x double, part double") \
        .groupBy("point", "x").agg((F.sum("part") * F.lit(scale)).alias("density"))


def boxplot_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, whisker ends (the furthest values within 1.5 quartile ranges) and outlier counts."""
    cuts = quantiles(df, columns, [0.25, 0.5, 0.75])
    aggregates = []
    for i, c in enumerate(columns):
        q1, q2, q3 = cuts[c]
        if q1 is None:
            continue
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = F.col(c).between(low, high)
        aggregates += [
            F.lit(q1).alias(f"q1{i}"), F.lit(q2).alias(f"median{i}"), F.lit(q3).alias(f"q3{i}"),
            F.min(F.when(inside, F.col(c))).alias(f"whisker_low{i}"),
            F.max(F.when(inside, F.col(c))).alias(f"whisker_high{i}"),
            F.sum((~inside).cast("long")).alias(f"outliers{i}")]
    parts = {"q1": "double", "median": "double", "q3": "double",
             "whisker_low": "double", "whisker_high": "double", "outliers": "long"}
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *aggregates)
    return _long(row, columns, parts)
