"""Seasons, absolute periods, and settings that differ by model and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.scalar import month_day
from tidewright.spec import DateRange, Period


def in_season(time: Column | str, period: Period) -> Column:
    """Month and day within the season; a season that starts later than it ends runs over new year."""
    day = month_day(time)
    if period.start <= period.end:
        return day.between(period.start, period.end)
    return (day >= period.start) | (day <= period.end)


def filter_season(df: DataFrame, time: str, period: Period) -> DataFrame:
    return df.where(in_season(time, period))


def filter_dates(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Rows from the start date to the first instant of the end date; reaches the scan as a filter."""
    low, high = (F.lit(bound).cast("timestamp_ntz") for bound in (start, end))
    return df.where((F.col(time) >= low) & (F.col(time) <= high))


def pick_periods(periods: Sequence[Period], names: Sequence[str] | None) -> list[Period]:
    """Periods by name, ignoring case; no names means all."""
    if not names:
        return list(periods)
    wanted = {n.lower() for n in names}
    return [p for p in periods if p.name.lower() in wanted]


def _explode_matches(df, tests, column):
    matches = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests]))
    return df.withColumn(column, F.explode(matches))


def assign_periods(df: DataFrame, time: str, periods: Sequence[Period], column: str = "period") -> DataFrame:
    """One row per period a row falls into. Periods may overlap; one pass, no join, no shuffle."""
    return _explode_matches(df, [(p.name, in_season(time, p)) for p in periods], column)


def assign_ranges(df: DataFrame, time: str, ranges: Sequence[DateRange], column: str = "period") -> DataFrame:
    """The same for absolute periods."""
    tests = [(r.name, F.col(time).between(F.lit(r.start).cast("timestamp_ntz"),
                                          F.lit(r.end).cast("timestamp_ntz"))) for r in ranges]
    return _explode_matches(df, tests, column)


def large_enough(df: DataFrame, keys: Sequence[str], min_rows: int) -> DataFrame:
    """Rows of the groups that have at least ``min_rows`` rows."""
    kept = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= min_rows)
    return df.join(kept.select(*keys), list(keys), "left_semi")


def settings_table(spark: SparkSession, overrides: dict, value_type: str) -> DataFrame:
    """{model: {period: value}} as a table; its size is that of the settings, not of the data."""
    rows = [(m, p, v) for m, by_period in overrides.items() for p, v in by_period.items()]
    return spark.createDataFrame(rows, f"model string, period string, override {value_type}")


def with_override(df: DataFrame, settings: DataFrame, default: Column, column: str) -> DataFrame:
    """The setting of each row's model and period, else the default.

    ``settings`` comes from ``settings_table``, that is from a dictionary of the
    driver, so it is small enough to be broadcast.
    """
    joined = df.join(F.broadcast(settings), ["model", "period"], "left")
    return joined.withColumn(column, F.coalesce("override", default)).drop("override")


def pair_with_configs(df: DataFrame, ranges: Sequence[DateRange], configs: Sequence[dict],
                      schema: str, column: str = "period") -> DataFrame:
    """Give each row the configuration that stands at the same place as its period."""
    rows = [(r.name, *c.values()) for r, c in zip(ranges, configs)]
    table = df.sparkSession.createDataFrame(rows, f"{column} string, {schema}")
    return df.join(F.broadcast(table), column)
