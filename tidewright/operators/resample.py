"""Means over a fixed time grid."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.scalar import DAY_MICROS, from_micros, micros

# Microseconds of the units a resampling rule may use.
UNIT_MICROS = {"S": 1_000_000, "T": 60_000_000, "MIN": 60_000_000, "H": 3_600_000_000, "D": DAY_MICROS}

# Bins per array when a gap is unrolled, so that no single array grows with it; and bins within which a predecessor is looked for first.
_GAP_BLOCK, _CHUNK_BINS = 10_000, 100_000


def rule_micros(rule: str) -> int:
    """Length of a rule such as '30T' or '1H'."""
    match = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", rule.strip())
    unit = match and UNIT_MICROS.get(match.group(2).upper())
    if not unit:
        raise ValueError(f"unknown resampling rule {rule!r}")
    return int(match.group(1) or 1) * unit


def resample_mean(df: DataFrame, rule: str, time: str, columns: Sequence[str],
                  keys: Sequence[str] = (), dense: bool = True) -> DataFrame:
    """Mean of each column per time bin; with ``dense``, bins without rows are kept as missing.

    Bins start at midnight of the first day of the series; rows without a time are in none. Rows
    are combined before the shuffle, so a crowded bin is no hot spot.
    """
    step = rule_micros(rule)
    at = df.where(F.col(time).isNotNull()).select(*keys, micros(time).alias("_us"), *columns)
    aligned = DAY_MICROS % step == 0
    if aligned:
        # Midnight is a bin border every day, so the first day need not be known.
        origin = F.lit(0).cast("long")
    else:
        midnight = F.expr(f"(min(_us) div {DAY_MICROS}) * {DAY_MICROS}").alias("_origin")
        if keys:
            at = at.join(at.groupBy(*keys).agg(midnight), list(keys))
        else:
            at = at.withColumn("_origin", F.lit(at.agg(midnight).first()["_origin"]).cast("long"))
        origin = F.col("_origin")
    bin_no = F.floor((F.col("_us") - origin) / F.lit(step)).cast("long")
    binned = at.withColumn("_bin", bin_no)
    extra = [] if aligned else [F.first("_origin").alias("_origin")]
    means = binned.groupBy(*keys, "_bin").agg(*[F.avg(c).alias(c) for c in columns], *extra)
    if dense:
        means = _fill_gaps(means, keys, columns)
    start_us = F.col("_bin") * F.lit(step) + (F.lit(0) if aligned else F.col("_origin"))
    return means.select(*keys, from_micros(start_us).alias(time), *columns)


def _fill_gaps(means: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Every occupied bin, and before it the empty ones since its predecessor.

    A predecessor is found within a stretch of bins, or as the last bin of the stretch before, of which
    there is one row per stretch; so a long series is spread like its bins, and nothing is made that is not in the result.
    """
    placed = means.withColumn("_chunk", F.expr(f"_bin div {_CHUNK_BINS}"))
    ends = placed.groupBy(*keys, "_chunk").agg(F.max("_bin").alias("_end"))
    last = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"),
                       F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_end"))
    match = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    before = F.coalesce(F.lag("_bin").over(Window.partitionBy(*keys, "_chunk").orderBy("_bin")), F.col("_end"))
    found = placed.join(last, match).withColumn("_before", before)
    # Blocks of a gap end at the occupied bin; the first bin of a series has no gap.
    gap = F.coalesce(F.col("_bin") - F.col("_before"), F.lit(1))
    blocks = found.withColumn("_gap", gap).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_gap - 1) div {_GAP_BLOCK}"))))
    first = F.col("_b") * _GAP_BLOCK
    filled = blocks.withColumn("_off", F.explode(F.sequence(first, F.least(first + (_GAP_BLOCK - 1), F.col("_gap") - 1))))
    kept = [c for c in means.columns if c not in columns and c != "_bin"]
    return filled.select(*kept, (F.col("_bin") - F.col("_off")).alias("_bin"), *[F.when(F.col("_off") == 0, F.col(c)).alias(c) for c in columns])
