"""Lag and rolling features, splits, folds, scaling, augmentation and step chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalog.base import (
    ASSIGNED, CLEAN, EVENT_PERIODS, KNOWN, READINGS, SENSORS, SPLIT, clean_readings, events, known_sensors,
    query, readings, rounded, sql)
from tidewright.operators import periods as pe
from tidewright.operators.augment import add_noise
from tidewright.operators.features import add_features, add_split_features, add_time_features, time_gaps
from tidewright.operators.metrics import metric_columns
from tidewright.operators.scale import SCALERS
from tidewright.operators.split import cv_folds, temporal_split
from tidewright.spec import FeaturePlan

ORDER = ["ts", "event_id"]


def _plan(lags=None, windows=None, statistics=("mean", "std"), time=False):
    return FeaturePlan(lags=lags or {}, windows=windows or {}, statistics=statistics, hour=time, day_of_year=time)


_LAGS = """SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 4) OVER w AS value_lag4,
    lag(value, 64) OVER w AS value_lag64 FROM readings WINDOW w AS (ORDER BY ts, event_id)"""


@query("lag_features", sql(READINGS, _LAGS))
def lag_features(spark, sf):
    plan = _plan(lags={"value": [1, 4, 64], "no_such_column": [1]})
    out = add_features(readings(spark, sf), plan, ORDER)
    return out.select("event_id", "value_lag1", "value_lag4", "value_lag64")


@query("lag_features_chunked", sql(READINGS, _LAGS))
def lag_features_chunked(spark, sf):
    """The same with limits so low that the series is sorted in ranges and cut into chunks."""
    out = add_features(readings(spark, sf), _plan(lags={"value": [1, 4, 64]}), ORDER,
                       chunk_rows=700, max_group_rows=500, range_rows=900)
    return out.select("event_id", "value_lag1", "value_lag4", "value_lag64")


_LAGS_BY_KEY = """SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2
    FROM readings WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)"""


@query("lag_features_by_key", sql(READINGS, _LAGS_BY_KEY.format(key="user_id")))
def lag_features_by_key(spark, sf):
    out = add_features(readings(spark, sf), _plan(lags={"value": [1, 2]}), ORDER, ["user_id"])
    return out.select("event_id", "value_lag1", "value_lag2")


@query("lag_features_by_key_chunked", sql(READINGS, _LAGS_BY_KEY.format(key="event_type")))
def lag_features_by_key_chunked(spark, sf):
    out = add_features(readings(spark, sf), _plan(lags={"value": [1, 2]}), ORDER, ["event_type"],
                       chunk_rows=300, max_group_rows=500, range_rows=900)
    return out.select("event_id", "value_lag1", "value_lag2")


_FRAMES = """WINDOW w3 AS (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
    w24 AS (ORDER BY ts, event_id ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""


@query("rolling_mean_std", sql(READINGS, f"""
    SELECT event_id, round(avg(value) OVER w3, 6) AS value_roll3, round(stddev_samp(value) OVER w3, 4) AS value_std3,
        round(avg(value) OVER w24, 6) AS value_roll24, round(stddev_samp(value) OVER w24, 4) AS value_std24
    FROM readings {_FRAMES}"""))
def rolling_mean_std(spark, sf):
    out = add_features(readings(spark, sf), _plan(windows={"value": [3, 24]}), ORDER)
    out = out.select("event_id", "value_roll3", "value_std3", "value_roll24", "value_std24")
    return rounded(rounded(out, 6, "value_roll3", "value_roll24"), 4, "value_std3", "value_std24")


@query("rolling_min_max", sql(READINGS, f"""
    SELECT event_id, min(value) OVER w3 AS value_min3, max(value) OVER w3 AS value_max3,
        min(value) OVER w24 AS value_min24, max(value) OVER w24 AS value_max24 FROM readings {_FRAMES}"""))
def rolling_min_max(spark, sf):
    out = add_features(readings(spark, sf), _plan(windows={"value": [3, 24]}, statistics=("min", "max")), ORDER)
    return out.select("event_id", "value_min3", "value_max3", "value_min24", "value_max24")


@query("rolling_median", sql(READINGS, f"""
    SELECT event_id, round(median(value) OVER w3, 6) AS value_med3, round(median(value) OVER w24, 6) AS value_med24
    FROM readings {_FRAMES}"""))
def rolling_median(spark, sf):
    out = add_features(readings(spark, sf), _plan(windows={"value": [3, 24]}, statistics=("median",)), ORDER)
    return rounded(out.select("event_id", "value_med3", "value_med24"), 6, "value_med3", "value_med24")


@query("rolling_median_week", sql(READINGS, """
    SELECT event_id, round(median(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 671 PRECEDING AND CURRENT ROW), 6) AS value_med672
    FROM readings"""))
def rolling_median_week(spark, sf):
    """A window of a week of quarter hours, cut into several chunks."""
    out = add_features(readings(spark, sf), _plan(windows={"value": [672]}, statistics=("median",)), ORDER, chunk_rows=3000)
    return rounded(out.select("event_id", "value_med672"), 6, "value_med672")


@query("rolling_full_window", sql(READINGS, """
    SELECT event_id, CASE WHEN count(value) OVER w >= 6 THEN round(avg(value) OVER w, 6) END AS value_roll6_mean,
        CASE WHEN count(value) OVER w >= 6 THEN round(stddev_samp(value) OVER w, 4) END AS value_roll6_std
    FROM readings WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"""))
def rolling_full_window(spark, sf):
    out = add_features(readings(spark, sf), _plan(windows={"value": [6]}), ORDER, full=True)
    out = out.select("event_id", "value_roll6_mean", "value_roll6_std")
    return rounded(rounded(out, 6, "value_roll6_mean"), 4, "value_roll6_std")


@query("time_gaps", """
    SELECT * FROM (SELECT event_id, date_diff('microsecond', lag(ts) OVER (ORDER BY ts, event_id), ts) AS gap_us
        FROM events) WHERE gap_us IS NOT NULL""")
def time_gaps_query(spark, sf):
    return time_gaps(events(spark, sf), "ts", ORDER).select("event_id", "gap_us")


def _assigned(spark, sf):
    return pe.assign_periods(clean_readings(spark, sf), "ts", EVENT_PERIODS)


@query("temporal_split", sql(READINGS, CLEAN, ASSIGNED, SPLIT, "SELECT period, event_id, pos, split FROM split"))
def temporal_split_query(spark, sf):
    return temporal_split(_assigned(spark, sf), ORDER, 0.8, ["period"]).select("period", "event_id", "pos", "split")


@query("temporal_split_ranges", sql(READINGS, CLEAN, ASSIGNED, SPLIT, "SELECT period, event_id, pos, split FROM split"))
def temporal_split_ranges(spark, sf):
    """The same split with the rows sorted into ranges, as for series too long for one task."""
    out = temporal_split(_assigned(spark, sf), ORDER, 0.8, ["period"], max_group_rows=500, range_rows=900)
    return out.select("period", "event_id", "pos", "split")


@query("ts_cv_folds", sql(READINGS, CLEAN, ASSIGNED, SPLIT, """
    SELECT period, fold, role, count(*) AS n, min(pos) AS first, max(pos) AS last FROM (
        SELECT period, pos, fold, CASE WHEN pos < n - (5 - fold) * (n // 6) THEN 'train'
            WHEN pos < n - (4 - fold) * (n // 6) THEN 'test' END AS role
        FROM split, (SELECT unnest(range(5)) AS fold)) WHERE role IS NOT NULL GROUP BY ALL"""))
def ts_cv_folds(spark, sf):
    split = temporal_split(_assigned(spark, sf), ORDER, 0.8, ["period"])
    folds = cv_folds(split, 5).groupBy("period", F.col("fold").cast("long").alias("fold"), "role")
    return folds.agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


_SCOPED = """features AS (
    SELECT *, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2,
        avg(value) OVER w3 AS value_roll3, stddev_samp(value) OVER w3 AS value_std3,
        avg(value) OVER w6 AS value_roll6, stddev_samp(value) OVER w6 AS value_std6,
        sin(2 * pi() * hour(ts) / 24) AS hour_sin
    FROM split WINDOW w AS (PARTITION BY period, split ORDER BY ts, event_id),
        w3 AS (PARTITION BY period, split ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
        w6 AS (PARTITION BY period, split ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""

_MODEL_PLAN = FeaturePlan(lags={"value": [1, 2]}, windows={"value": [3, 6]})


def _scoped(spark, sf):
    split = temporal_split(_assigned(spark, sf), ORDER, 0.8, ["period"])
    return add_split_features(split, _MODEL_PLAN, "ts", ["period"])


@query("features_split_scoped", sql(READINGS, CLEAN, ASSIGNED, SPLIT, _SCOPED, """
    SELECT period, split, event_id, value_lag1, value_lag2, round(value_roll3, 6) AS value_roll3,
        round(value_std3, 4) AS value_std3, round(value_roll6, 6) AS value_roll6, round(value_std6, 4) AS value_std6
    FROM features"""))
def features_split_scoped(spark, sf):
    out = _scoped(spark, sf).select("period", "split", "event_id", "value_lag1", "value_lag2",
                                    "value_roll3", "value_std3", "value_roll6", "value_std6")
    return rounded(rounded(out, 6, "value_roll3", "value_roll6"), 4, "value_std3", "value_std6")


@query("features_then_split", sql(READINGS, CLEAN, """features AS (
    SELECT ts, event_id, value, lag(value, 1) OVER w AS value_lag1,
        CASE WHEN count(value) OVER w6 >= 6 THEN avg(value) OVER w6 END AS value_roll6_mean FROM clean
    WINDOW w AS (ORDER BY ts, event_id), w6 AS (ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
    complete AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM features
        WHERE value_lag1 IS NOT NULL AND value_roll6_mean IS NOT NULL)""", """
    SELECT event_id, value_lag1, round(value_roll6_mean, 6) AS value_roll6_mean,
        CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM complete"""))
def features_then_split(spark, sf):
    plan = _plan(lags={"value": [1]}, windows={"value": [6]}, statistics=("mean",))
    complete = add_features(clean_readings(spark, sf), plan, ORDER, full=True).na.drop("any")
    split = temporal_split(complete, ORDER, 0.8)
    return rounded(split.select("event_id", "value_lag1", "value_roll6_mean", "split"), 6, "value_roll6_mean")


@query("persistence_by_period", sql(READINGS, CLEAN, ASSIGNED, SPLIT, _SCOPED, """
    complete AS (SELECT * FROM features WHERE value_lag2 IS NOT NULL AND value_std3 IS NOT NULL)""", """
    SELECT period, split, count(*) AS n,
        round(1 - sum((value - value_lag1) * (value - value_lag1)) / (var_pop(value) * count(*)), 6) AS r2,
        round(sqrt(avg((value - value_lag1) * (value - value_lag1))), 6) AS rmse,
        round(avg(abs(value - value_lag1)), 6) AS mae, round(avg(hour_sin), 6) AS hour_sin
    FROM complete GROUP BY period, split"""))
def persistence_by_period(spark, sf):
    """Clean, assign to periods, split, add features, drop incomplete rows, score the reading before."""
    complete = _scoped(spark, sf).na.drop(subset=["value", *_MODEL_PLAN.names(["value"])])
    scores = complete.groupBy("period", "split").agg(
        F.count(F.lit(1)).alias("n"), *metric_columns("value", "value_lag1"), F.avg("hour_sin").alias("hour_sin"))
    return rounded(scores, 6, "r2", "rmse", "mae", "hour_sin")


# ---------------------------------------------------------------- scaling and augmentation

_SENSOR_SPLIT = """placed AS (
    SELECT *, row_number() OVER (ORDER BY ts, key) - 1 AS pos, count(*) OVER () AS n FROM known),
    split AS (SELECT *, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM placed),
    train AS (SELECT * FROM split WHERE split = 'train')"""


def _sensor_split(spark, sf):
    return temporal_split(known_sensors(spark, sf), ["ts", "key"], 0.8)


def _scale_query(kind):
    def run(spark, sf):
        split = _sensor_split(spark, sf)
        scaler = SCALERS[kind](split.where(F.col("split") == "train"), ["amount", "tax"])
        return rounded(scaler.transform(split).select("key", "split", "amount", "tax"), 6, "amount", "tax")
    return run


def _scale_sql(center, width):
    parts = ", ".join(f"round(({c} - {center.format(c=c)}) / ({width.format(c=c)}), 6) AS {c}" for c in ("amount", "tax"))
    stats = ", ".join(f"{f.format(c=c)} AS {n}{c}" for c in ("amount", "tax") for n, f in (
        ("avg_", "avg({c})"), ("sd_", "stddev_pop({c})"), ("min_", "min({c})"), ("max_", "max({c})"),
        ("q1_", "quantile_cont({c}, 0.25)"), ("q2_", "quantile_cont({c}, 0.5)"), ("q3_", "quantile_cont({c}, 0.75)")))
    return sql(SENSORS, KNOWN, _SENSOR_SPLIT, f"fit AS (SELECT {stats} FROM train)",
               f"SELECT key, split, {parts} FROM split, fit")


query("standard_scale", _scale_sql("avg_{c}", "sd_{c}"))(_scale_query("standard"))
query("minmax_scale", _scale_sql("min_{c}", "max_{c} - min_{c}"))(_scale_query("minmax"))
query("robust_scale", _scale_sql("q2_{c}", "q3_{c} - q1_{c}"))(_scale_query("robust"))


def _sql_noise(seed, feature, column):
    digest = f"md5('{seed}|{feature}|' || copy || '|' || key)"
    uniform = "(CAST('0x' || substr({d}, {s}, 13) AS BIGINT) + 0.5) / 4503599627370496.0"
    return (f"round(CASE WHEN copy = 0 THEN {column} ELSE {column} + 0.1 * (SELECT stddev_pop({column}) FROM known) * "
            f"sqrt(-2 * ln({uniform.format(d=digest, s=1)})) * cos(2 * pi() * {uniform.format(d=digest, s=14)}) END, 4) AS {column}")


@query("augment_noise", sql(SENSORS, KNOWN, "copies AS (SELECT known.*, copy FROM known, (SELECT unnest(range(3)) AS copy))", f"""
    SELECT key, copy, amount, {_sql_noise(42, 0, 'quantity')}, {_sql_noise(42, 1, 'tax')} FROM copies"""))
def augment_noise(spark, sf):
    noisy = add_noise(known_sensors(spark, sf), ["quantity", "tax"], ["key"], copies=2, level=0.1)
    out = noisy.select("key", F.col("copy").cast("long").alias("copy"), "amount", "quantity", "tax")
    return rounded(out, 4, "quantity", "tax")


# ---------------------------------------------------------------- step chains

@query("step_chain", sql(READINGS, CLEAN, """
    SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0 AS hour_sin, lag(value, 1) OVER w AS value_lag1,
        round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS value_roll3
    FROM clean WINDOW w AS (ORDER BY ts, event_id)"""))
def step_chain(spark, sf):
    from tidewright.operators.clean import drop_missing, non_negative
    from tidewright.plans.steps import Registry, Step

    registry = Registry()
    registry.register(Step("missing", drop_missing, "preprocessing"))
    registry.register(Step("negative", lambda df: non_negative(df, ["value"]), "preprocessing"))
    registry.register(Step("time", lambda df: add_time_features(df, "ts")))
    registry.register(Step("lag", lambda df: add_features(df, _plan(lags={"value": [1]}), ORDER)))
    registry.register(Step("rolling", lambda df: add_features(df, _plan(windows={"value": [3]}, statistics=("mean",)), ORDER)))
    registry.register(Step("unused", lambda df: df.limit(0), enabled=False))
    out = registry.run_chain(["missing", "negative", "time", "lag", "rolling", "unused"], readings(spark, sf))
    return out.select("event_id", (F.round("hour_sin", 6) + 0).alias("hour_sin"), "value_lag1",
                      F.round("value_roll3", 6).alias("value_roll3"))
