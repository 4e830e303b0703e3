"""Noisy copies of train rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.scalar import gaussian


def add_noise(df: DataFrame, columns: Sequence[str], row_key: Sequence[str], copies: int,
              level: float, seed: int = 42) -> DataFrame:
    """Each row once as it is (copy 0) and ``copies`` times with noise on its features.

    The noise of a column has ``level`` times its population standard deviation.
    Without copies or level the frame is returned with copy 0 only.
    """
    if copies == 0 or level == 0:
        return df.withColumn("copy", F.lit(0))
    spread = df.agg(*[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    multiplied = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    noisy = {}
    for i, c in enumerate(columns):
        identity = [F.lit(seed), F.lit(i), F.col("copy"), *[F.col(k) for k in row_key]]
        noise = gaussian(*identity) * F.lit(level * float(spread[f"s{i}"]))
        noisy[c] = F.when(F.col("copy") == 0, F.col(c)).otherwise(F.col(c) + noise)
    return multiplied.withColumns(noisy)
