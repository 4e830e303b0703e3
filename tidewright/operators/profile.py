"""From a table to a plan: time column, resolution, target, lags, windows, periods."""

from __future__ import annotations

import calendar
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.scalar import DAY_MICROS, micros
from tidewright.operators.columns import numeric_columns
from tidewright.operators.features import time_gaps
from tidewright.spec import AUTO, Period

# Words that mark a time column and a target column.
TIME_WORDS = ["time", "date", "timestamp", "datetime", "created_at", "updated_at"]
TARGET_WORDS = ["target", "label", "y", "output", "prediction", "class",
                "n2o", "emission", "concentration", "level", "amount"]

# Seasons proposed for data longer than a year, quarters for longer than 90 days.
SEASONS = [("Winter", "12-01", "02-28", "Winter period (Dec-Feb)"),
           ("Spring", "03-01", "05-31", "Spring period (Mar-May)"),
           ("Summer", "06-01", "08-31", "Summer period (Jun-Aug)"),
           ("Autumn", "09-01", "11-30", "Autumn period (Sep-Nov)")]
QUARTERS = [("Q1", "01-01", "03-31"), ("Q2", "04-01", "06-30"),
            ("Q3", "07-01", "09-30"), ("Q4", "10-01", "12-31")]

# Lags in rows, horizons of windows in minutes, and the limits of both.
LAG_ROWS = [1, 4, 16, 64]
WINDOW_MINUTES = [60, 360, 1440, 10080]
MAX_LAG, MAX_LAGS, MAX_WINDOW, MAX_WINDOWS = 100, 6, 1000, 4
DEFAULT_MINUTES = 15

_SECOND_US, _MINUTE_US, _HOUR_US = 1_000_000, 60_000_000, 3_600_000_000
#: Units a resolution is told in, coarsest first.
_UNITS = ((DAY_MICROS, "D"), (_HOUR_US, "H"), (_MINUTE_US, "T"), (_SECOND_US, "S"))


def datetime_columns(df: DataFrame) -> list[str]:
    """Timestamp and date columns, and text columns all of whose known values parse.

    Numbers never count as times. All texts are looked at in one pass.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    parses = set()
    if texts:
        row = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(texts)],
                     *[F.count(F.try_to_timestamp(c)).alias(f"ok{i}") for i, c in enumerate(texts)]).first()
        parses = {c for i, c in enumerate(texts) if 0 < row[f"n{i}"] == row[f"ok{i}"]}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) or f.name in parses]


def detect_time_column(df: DataFrame, candidates: Sequence[str] | None = None) -> str | None:
    """A datetime column named like a time, else the first datetime column."""
    found = datetime_columns(df) if candidates is None else candidates
    named = [c for c in found if any(w in c.lower() for w in TIME_WORDS)]
    return next(iter([*named, *found]), None)


def likely_target(name: str) -> bool:
    return any(w in name.lower() for w in TARGET_WORDS)


def target_candidates(df: DataFrame) -> DataFrame:
    """Numeric columns named like a target with a confidence, best first; ties keep column order.

    The name alone gives 0.6; a column of fractions and a moderate spread around its mean add 0.2 each.
    """
    names = [c for c in numeric_columns(df) if likely_target(c)]
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal long, column string, confidence double")
    fractions = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    entries = [F.struct(F.lit(i).cast("long").alias("ordinal"), F.lit(c).alias("column"), F.lit(0.2 * (c in fractions)).alias("kind"),
                        (F.stddev_samp(c) / F.abs(F.nullif(F.avg(c), F.lit(0.0)))).alias("cv")) for i, c in enumerate(names)]
    moderate = F.when((F.col("cv") > 0.1) & (F.col("cv") < 2.0), 0.2).otherwise(0.0)
    return df.agg(F.array(*entries).alias("e")).select(F.explode("e").alias("e")).select("e.*") \
        .select("ordinal", "column", (F.lit(0.6) + F.col("kind") + moderate).alias("confidence")) \
        .orderBy(F.desc("confidence"), "ordinal")


def recommended_features(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if not likely_target(c)]


def date_range(df: DataFrame, time: str) -> DataFrame:
    """First and last time, whole days between them, and the pattern flags derived from that."""
    days = F.floor((F.max(micros(time)) - F.min(micros(time))) / F.lit(DAY_MICROS))
    return df.agg(F.min(time).alias("start"), F.max(time).alias("end"), days.alias("days")).select(
        "*", F.lit(True).alias("daily"), F.lit(False).alias("weekly"), (F.col("days") > 300).alias("yearly"))


def resolution_label(gap_us: Column) -> Column:
    """Gap as seconds, minutes, hours or days, cut to whole units; for show."""
    label = None
    for unit, mark in _UNITS:
        text = F.concat(F.floor(gap_us / F.lit(unit)).cast("string"), F.lit(mark))
        label = F.when(gap_us >= unit, text) if label is None else label.when(gap_us >= unit, text)
    return label.otherwise("0S")


def time_resolution(df: DataFrame, time: str, order: Sequence[str], **index_options) -> DataFrame:
    """The most frequent gap between neighbouring times, the smallest of several equally frequent ones."""
    gaps = time_gaps(df.select(*dict.fromkeys([time, *order])), time, order, **index_options)
    top = gaps.groupBy("gap_us").count().orderBy(F.col("count").desc(), "gap_us").limit(1)
    return top.select("gap_us", F.col("count").alias("gaps"),
                      resolution_label(F.col("gap_us")).alias("resolution"))


def suggest_lags() -> list[int]:
    """Lags in rows, the same for every resolution."""
    return [k for k in LAG_ROWS if k <= MAX_LAG][:MAX_LAGS]


def suggest_windows(gap_us: int | None) -> list[int]:
    """Rows that make up each horizon, for rows ``gap_us`` microseconds apart.

    A gap counts in whole units of its label and as a minute at least; an unknown one as a quarter of an hour.
    """
    step = DEFAULT_MINUTES * _MINUTE_US
    if gap_us is not None:
        step = max(_MINUTE_US, next((gap_us - gap_us % unit for unit, _ in _UNITS if gap_us >= unit), 0))
    rows = {max(1, minutes * _MINUTE_US // step) for minutes in WINDOW_MINUTES}
    return sorted(r for r in rows if r <= MAX_WINDOW)[:MAX_WINDOWS]


def suggest_periods(start, end, days: int) -> list[Period]:
    """Seasons for more than a year, quarters for more than 90 days, else months."""
    if days > 365:
        return [Period(*season) for season in SEASONS]
    if days > 90:
        return [Period(f"{start.year}_{q}", a, b, f"{q} {start.year} ({a} to {b})") for q, a, b in QUARTERS]
    out, year, month = [], start.year, start.month
    while (year, month) <= (end.year, end.month):
        last = calendar.monthrange(year, month)[1]
        out.append(Period(f"{year}_{month:02d}", f"{month:02d}-01", f"{month:02d}-{last:02d}",
                          f"{calendar.month_name[month]} {year}"))
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    return out


def suggested_periods_table(df: DataFrame, time: str) -> DataFrame:
    row = date_range(df, time).first()
    periods = suggest_periods(row["start"], row["end"], row["days"]) if row["start"] else []
    return df.sparkSession.createDataFrame(
        [(p.name, p.start, p.end, p.description) for p in periods],
        "name string, start_date string, end_date string, description string")


@dataclass(frozen=True)
class DatasetPlan:
    """What the profile of a table suggests for modelling it."""

    time: str | None
    target: str | None
    features: list[str]
    numeric: list[str]
    categorical: list[str]
    datetimes: list[str]
    resolution: str = "unknown"
    days: int | None = None
    lags: dict[str, list[int]] = field(default_factory=dict)
    windows: dict[str, list[int]] = field(default_factory=dict)
    periods: list[Period] = field(default_factory=list)


def analyze(df: DataFrame, ties: Sequence[str] = ()) -> DatasetPlan:
    """Profile a whole table and propose a plan."""
    found = datetime_columns(df)
    time = detect_time_column(df, found)
    numeric = numeric_columns(df)
    best = target_candidates(df).first()
    resolution, gap_us, days, periods = "unknown", None, None, []
    if time:
        if isinstance(df.schema[time].dataType, T.StringType):
            df = df.withColumn(time, F.try_to_timestamp(time).cast("timestamp_ntz"))
        span = date_range(df, time).first()
        if span["start"] is not None:
            days = span["days"]
            periods = suggest_periods(span["start"], span["end"], days)
        top = time_resolution(df.where(F.col(time).isNotNull()), time, [time, *ties]).first()
        if top:
            resolution, gap_us = top["resolution"], top["gap_us"]
    return DatasetPlan(
        time=time, target=best["column"] if best else None, features=recommended_features(df),
        numeric=numeric, categorical=[c for c in df.columns if c not in numeric], datetimes=found,
        resolution=resolution, days=days, lags={AUTO: suggest_lags()},
        windows={AUTO: suggest_windows(gap_us)}, periods=periods)
