"""Long form, unions and labels of result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_results(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, matched by column name; columns a part lacks are missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str],
            name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def dataset_label(name: Column | str) -> Column:
    """'Train' for metric names that mention it, else 'Test'."""
    name = F.col(name) if isinstance(name, str) else name
    return F.when(F.contains(name, F.lit("Train")), "Train").otherwise("Test")


def top_k(df: DataFrame, by: str, k: int, absolute: bool = False, tie: str | None = None) -> DataFrame:
    """The k largest rows, optionally by absolute value."""
    key = F.abs(F.col(by)) if absolute else F.col(by)
    return df.orderBy(key.desc(), *([tie] if tie else [])).limit(k)
