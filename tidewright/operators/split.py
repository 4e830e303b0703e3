"""Chronological split and expanding-window folds, by position in the series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.index import with_position


def split_point(ratio: float, size: str = "n_rows") -> Column:
    return F.floor(F.col(size) * F.lit(float(ratio)))


def temporal_split(df: DataFrame, order: Sequence[str], ratio: float = 0.8,
                   keys: Sequence[str] = (), **index_options) -> DataFrame:
    """Mark the first share of each series 'train' and the rest 'test'.

    Adds ``pos`` and ``n_rows`` too, and ``split_pos``, the position within the split.
    """
    placed = with_position(df, order, keys, **index_options)
    cut = split_point(ratio)
    in_train = F.col("pos") < cut
    return placed.select(
        "*",
        F.when(in_train, F.lit("train")).otherwise(F.lit("test")).alias("split"),
        F.when(in_train, F.col("pos")).otherwise(F.col("pos") - cut).cast("long").alias("split_pos"),
    )


def fold_bounds(n: int, folds: int) -> list[tuple[int, int]]:
    """(first, end) test positions of each fold; the train rows of a fold are all before ``first``."""
    if folds < 2 or n < folds + 1:
        raise ValueError(f"{folds} folds need at least 2 folds and {folds + 1} rows; there are {n}")
    step = n // (folds + 1)
    return [(n - (folds - i) * step, n - (folds - i - 1) * step) for i in range(folds)]


def cv_folds(df: DataFrame, folds: int, pos: str = "pos", size: str = "n_rows") -> DataFrame:
    """One row per fold a row takes part in, with its role there."""
    step = F.expr(f"`{size}` div {folds + 1}")
    first = F.col(size) - (F.lit(folds) - F.col("fold")) * step
    numbered = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    role = F.when(F.col(pos) < first, "train").when(F.col(pos) < first + step, "test")
    return numbered.withColumn("role", role).where(F.col("role").isNotNull())
