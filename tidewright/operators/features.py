"""Lag, rolling and cyclic time features."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidewright.functions.scalar import cyclic_columns
from tidewright.operators.index import over_chunks, with_position
from tidewright.spec import ROLLING_SUFFIX, FeaturePlan

_ROLLING = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
}


def lag_columns(window: WindowSpec, columns: Sequence[str], lags: dict[str, list[int]]) -> list[Column]:
    """``{column}_lag{k}``; columns the frame lacks are skipped."""
    return [F.lag(c, k).over(window).alias(f"{c}_lag{k}")
            for c, steps in lags.items() if c in columns for k in steps]


def rolling_columns(window: WindowSpec, columns: Sequence[str], windows: dict[str, list[int]],
                    statistics: Sequence[str] = ("mean", "std"), full: bool = False) -> list[Column]:
    """Statistics over the last w rows, the current one included; medians are ``add_medians``'.

    With ``full`` a value appears only once the window holds w known values, and
    the names end in the statistic, as in the interactive variant.
    """
    out = []
    for c, sizes in windows.items():
        if c not in columns:
            continue
        for w in sizes:
            frame = window.rowsBetween(-(w - 1), 0)
            for name in ROLLING_SUFFIX:
                if name not in statistics or name == "median":
                    continue
                value = _ROLLING[name](F.col(c)).over(frame)
                if full:
                    value = F.when(F.count(c).over(frame) >= w, value).alias(f"{c}_roll{w}_{name}")
                else:
                    value = value.alias(f"{c}_{ROLLING_SUFFIX[name]}{w}")
                out.append(value)
    return out


def add_time_features(df: DataFrame, time: str, hour: bool = True, day_of_year: bool = True) -> DataFrame:
    if time not in df.columns:
        return df
    return df.select("*", *cyclic_columns(time, hour, day_of_year))


def add_row_features(df: DataFrame, plan: FeaturePlan, scope: Sequence[str], pos: str,
                     full: bool = False, chunk_rows: int | None = None) -> DataFrame:
    """Lags and rolling statistics of one plan, all in one sort. Windows stay within ``scope``."""
    columns = df.columns

    def build(window):
        return [*lag_columns(window, columns, plan.lags),
                *rolling_columns(window, columns, plan.windows, plan.statistics, full)]

    sizes = {c: w for c, w in plan.windows.items() if c in columns} if "median" in plan.statistics else {}
    return over_chunks(df, build, pos, scope, plan.halo, chunk_rows, then=lambda staged: add_medians(staged, sizes, pos, scope, full))


class SlidingMedian:
    """The median of the last ``width`` values, with two heaps: the lower half and the upper one.

    A value that has left the window stays in its heap until it comes to the top, so a step costs the logarithm of the window.
    """

    def __init__(self, width: int):
        self.width, self.window = width, deque()
        self.low: list[tuple[float, int]] = []  # negated, the largest first
        self.high: list[tuple[float, int]] = []
        self.n_low = self.n_high = self.count = 0
        self.in_low: dict[int, bool] = {}

    def push(self, value: float | None) -> float | None:
        """Take the next value in, which may be missing, and give the median of the known ones in the window."""
        number, self.count = self.count, self.count + 1
        if value is not None:
            self.window.append(number)
            lower = bool(self.n_low) and value <= -self.low[0][0]
            self.in_low[number] = lower
            heappush(self.low, (-value, number)) if lower else heappush(self.high, (value, number))
            self.n_low, self.n_high = self.n_low + lower, self.n_high + (not lower)
        while self.window and self.window[0] <= number - self.width:
            lower = self.in_low.pop(self.window.popleft())
            self.n_low, self.n_high = self.n_low - lower, self.n_high - (not lower)
        self._prune()
        while self.n_low > self.n_high:
            self._move(self.low, self.high, False)
        while self.n_high > self.n_low + 1:
            self._move(self.high, self.low, True)
        if not self.n_high:
            return None
        return self.high[0][0] if self.n_high > self.n_low else (self.high[0][0] - self.low[0][0]) / 2

    def _prune(self) -> None:
        while self.low and self.in_low.get(self.low[0][1]) is not True:
            heappop(self.low)
        while self.high and self.in_low.get(self.high[0][1]) is not False:
            heappop(self.high)

    def _move(self, source: list, target: list, lower: bool) -> None:
        value, number = heappop(source)
        heappush(target, (-value, number))
        self.in_low[number] = lower
        step = 1 if lower else -1
        self.n_low, self.n_high = self.n_low + step, self.n_high - step
        self._prune()


def add_medians(staged: DataFrame, windows: dict[str, list[int]], pos: str, scope: Sequence[str], full: bool = False) -> DataFrame:
    """Rolling medians of frames from ``chunks_with_halo``, in one walk over each chunk."""
    wanted = [(c, w, f"{c}_roll{w}_median" if full else f"{c}_{ROLLING_SUFFIX['median']}{w}") for c, sizes in windows.items() for w in sizes]
    if not wanted:
        return staged
    names = staged.columns
    schema = StructType([*staged.schema.fields, *[StructField(name, DoubleType()) for _, _, name in wanted]])

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by(pos)
        for c, w, name in wanted:
            median, known, out = SlidingMedian(w), 0, []
            values = table.column(names.index(c)).cast(pa.float64()).to_pylist()
            for i, value in enumerate(values):
                found = median.push(value)
                known += (value is not None) - (i >= w and values[i - w] is not None)
                out.append(None if full and known < w else found)
            table = table.append_column(name, pa.array(out, pa.float64()))
        return table

    return staged.groupBy(*scope, "_chunk").applyInArrow(lambda t: walk(t), schema)


def add_features(df: DataFrame, plan: FeaturePlan, order: Sequence[str], keys: Sequence[str] = (),
                 full: bool = False, chunk_rows: int | None = None, **index_options) -> DataFrame:
    """Features over whole series, before any split."""
    placed = with_position(df, order, keys, pos="_pos", size="_size", **index_options)
    out = add_row_features(placed, plan, keys, "_pos", full, chunk_rows)
    return out.drop("_pos", "_size")


def add_split_features(split: DataFrame, plan: FeaturePlan, time: str, keys: Sequence[str] = (),
                       chunk_rows: int | None = None) -> DataFrame:
    """Features of a frame from ``temporal_split``; no window crosses the border between train and test."""
    timed = add_time_features(split, time, plan.hour, plan.day_of_year)
    return add_row_features(timed, plan, [*keys, "split"], "split_pos", chunk_rows=chunk_rows)


def time_gaps(df: DataFrame, time: str, order: Sequence[str], keys: Sequence[str] = (),
              **index_options) -> DataFrame:
    """Microseconds since the row before; the first row of a series has none and is left out."""
    from tidewright.functions.scalar import micros

    placed = with_position(df, order, keys, pos="_pos", size="_size", **index_options)
    gap = lambda w: [(micros(time) - F.lag(micros(time)).over(w)).alias("gap_us")]
    return over_chunks(placed, gap, "_pos", keys, 1).where(F.col("gap_us").isNotNull()) \
        .drop("_pos", "_size")
