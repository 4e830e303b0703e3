"""Choosing, ordering, naming and assembling columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.spec import AUTO


def numeric_columns(df: DataFrame, exclude: Sequence[str] = (),
                    include: Sequence[str] | None = None) -> list[str]:
    """Columns to check: those asked for that exist, else every numeric one not excluded."""
    if include is not None:
        return [c for c in include if c in df.columns]
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def resolve_features(df: DataFrame, setting, target: str | None, time: str | None,
                     exclude: Sequence[str] = ()) -> list[str]:
    """Feature columns: a list is taken as it is; none or the auto mark means all other numeric ones."""
    if setting == AUTO or not setting:
        return [c for c in numeric_columns(df, exclude) if c not in (target, time)]
    return list(setting) if isinstance(setting, (list, tuple)) else []


def rename_labels(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({c: label for c, label in labels.items() if c in df.columns})


def feature_columns(df: DataFrame, target: str, drop: Sequence[str]) -> list[str]:
    """Everything but the target and the columns that only describe the row."""
    return [c for c in df.columns if c != target and c not in drop]


def assemble(df: DataFrame, features: Sequence[str], target: str, keep: Sequence[str] = ()) -> DataFrame:
    """Feature vector and label, plus the columns that identify the row."""
    vector = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return vector.transform(df).select(
        *keep, "features", F.col(target).cast("double").alias("label"))


def with_residual(df: DataFrame, truth: str = "true", prediction: str = "prediction") -> DataFrame:
    return df.withColumn("residual", F.col(truth) - F.col(prediction))
