"""Cross-correlation and autocorrelation over many lags.

Sums of lagged products are formed per chunk of consecutive rows by Fourier transforms of the chunk and its
halo, all lags at once, then added up: one row per chunk and lag is shuffled, not one per row and lag, and
a chunk costs the same whether ten lags are asked for or ten thousand.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.index import chunks_with_halo, with_position

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
_SCHEMA = "lag long, " + ", ".join(f"{s} double" for s in _SUMS)


def _lagged_sums(placed: DataFrame, first: str, second: str, lags: Sequence[int],
                 chunk_rows: int) -> DataFrame:
    """Sums over pairs (first at t, second at t - lag), both already centered."""
    halo = max(abs(lag) for lag in lags)
    staged = chunks_with_halo(placed.select("_pos", F.col(first).alias("_x"), F.col(second).alias("_y")),
                              "_pos", halo, chunk_rows)

    reach = np.abs(np.array(lags))
    back = np.array(lags) < 0

    def sums(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("_pos")
        x, y = chunk["_x"].to_numpy(), chunk["_y"].to_numpy()
        own = (chunk["_own"] == chunk["_chunk"]).to_numpy()
        size, start = len(x), int(np.argmax(own)) if own.any() else len(x)
        # A pair belongs to the chunk of its later row, which is one of the chunk's own.
        begin = np.maximum(start, reach)
        some = np.flatnonzero(begin < size)
        far, begin, turned = reach[some], begin[some], back[some]
        upto = lambda v: np.concatenate([[0.0], np.cumsum(v)])
        later = {c: upto(v) for c, v in (("x", x), ("y", y), ("xx", x * x), ("yy", y * y))}

        def at(name: str, is_later: np.ndarray) -> np.ndarray:
            v = later[name]
            return np.where(is_later, v[size] - v[begin], v[size - far] - v[begin - far])

        width = 1 << (2 * size - 1).bit_length()
        fx, fy = np.fft.rfft(x, width), np.fft.rfft(y, width)
        mask = np.arange(size) >= start
        products = np.fft.irfft(np.fft.rfft(np.where(mask, x, 0.0), width) * fy.conj(), width)[far]
        if turned.any():
            other = np.fft.irfft(np.fft.rfft(np.where(mask, y, 0.0), width) * fx.conj(), width)[far]
            products = np.where(turned, other, products)
        return pd.DataFrame({"lag": np.array(lags)[some], "n": (size - begin).astype(float), "sx": at("x", ~turned), "sy": at("y", turned),
                             "sxx": at("xx", ~turned), "syy": at("yy", turned), "sxy": products})

    parts = staged.groupBy("_chunk").applyInPandas(sums, _SCHEMA)
    return parts.groupBy("lag").agg(*[F.sum(s).alias(s) for s in _SUMS])


def cross_correlation(df: DataFrame, first: str, second: str, order: Sequence[str],
                      step_minutes: int = 15, max_lag_hours: float = 24,
                      chunk_rows: int = 100_000, **index_options) -> DataFrame:
    """Correlation of ``first`` with ``second`` shifted by each lag, over rows where both are known.

    Empty if one of the series does not vary.
    """
    spark = df.sparkSession
    known = df.select(*order, F.col(first).cast("double").alias("_a"),
                      F.col(second).cast("double").alias("_b")).na.drop(subset=["_a", "_b"])
    n, ma, mb, sa, sb = known.agg(F.count(F.lit(1)), F.avg("_a"), F.avg("_b"),
                                  F.stddev_samp("_a"), F.stddev_samp("_b")).first()
    if not n or not sa or not sb:
        return spark.createDataFrame([], "lag long, hours double, corr double")
    centered = known.select(*order, (F.col("_a") - F.lit(ma)).alias("_a"), (F.col("_b") - F.lit(mb)).alias("_b"))
    placed = with_position(centered, order, pos="_pos", size="_size", **index_options)
    reach = int(max_lag_hours * 60 / step_minutes)
    sums = _lagged_sums(placed, "_a", "_b", range(-reach, reach + 1), chunk_rows)
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    corr = F.when((F.col("n") > 1) & (vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))
    return sums.select("lag", (F.col("lag") * F.lit(step_minutes / 60)).alias("hours"), corr.alias("corr"))


def best_lag(correlations: DataFrame) -> DataFrame:
    """The lag of the largest absolute correlation, the first one if several are equal."""
    return correlations.where(F.col("corr").isNotNull()) \
        .orderBy(F.abs("corr").desc(), "lag").limit(1)


def autocorrelation(df: DataFrame, column: str, order: Sequence[str], max_lag: int,
                    chunk_rows: int = 100_000, **index_options) -> DataFrame:
    """Autocorrelation for lags 1 to ``max_lag``, with the 95 % and 99 % bands of white noise."""
    spark = df.sparkSession
    known = df.select(*order, F.col(column).cast("double").alias("_a")).na.drop(subset=["_a"])
    n, mean, spread = known.agg(F.count(F.lit(1)), F.avg("_a"), F.var_pop("_a")).first()
    if not n or not spread:
        return spark.createDataFrame([], "lag long, autocorr double, band95 double, band99 double")
    centered = known.select(*order, (F.col("_a") - F.lit(mean)).alias("_a"))
    placed = with_position(centered, order, pos="_pos", size="_size", **index_options)
    lags = range(1, min(max_lag, n - 1) + 1)
    sums = _lagged_sums(placed, "_a", "_a", lags, chunk_rows)
    # Two-sided 95 % and 99 % points of the normal distribution.
    z95, z99 = 1.959963984540054, 2.5758293035489004
    return sums.select(
        "lag", (F.col("sxy") / F.lit(n * spread)).alias("autocorr"),
        F.lit(z95 / math.sqrt(n)).alias("band95"), F.lit(z99 / math.sqrt(n)).alias("band99"))
