"""Scans, sinks, column choice, filters, joins, set operations and scalar functions."""

from __future__ import annotations

import uuid
from itertools import product

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewright.catalog.base import (
    ASSIGNED, CLEAN, EVENT_PERIODS, KNOWN, MEASURES, ORDER_PERIODS, READINGS, SENSORS, SPLIT,
    clean_readings, events, known_sensors, query, readings, rounded, sensors, shown_time, sql, table)
from tidewright.functions.scalar import cyclic_columns, safe_label
from tidewright.operators import clean as cl
from tidewright.operators import columns as co
from tidewright.operators import metrics as me
from tidewright.operators import periods as pe
from tidewright.operators import reshape as rs
from tidewright.operators.features import add_features
from tidewright.operators.scale import minmax_scaler, zscore
from tidewright.operators.split import temporal_split
from tidewright.session import shared_folder
from tidewright.sources import readers, writers
from tidewright.spec import AUTO, DateRange, FeaturePlan, Period

# ---------------------------------------------------------------- scans and sinks

_CSV_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def _scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_BY_TYPE = """SELECT event_type, count(*) AS n, count(value) AS known, round(sum(value), 2) AS total
    FROM readings GROUP BY event_type"""


def _by_type(df):
    return df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("known"),
        F.round(F.sum("value"), 2).alias("total"))


@query("scan_csv", sql(READINGS, _BY_TYPE))
def scan_csv(spark, sf):
    path = _scratch(spark, "csv")
    readings(spark, sf).write.option("header", True).csv(path)
    return _by_type(readers.load_series(spark, path, "ts", _CSV_SCHEMA))


@query("scan_csv_inferred", sql(READINGS, _BY_TYPE))
def scan_csv_inferred(spark, sf):
    """One file without decimals until its last rows, whose type has to come from all of them."""
    path = _scratch(spark, "csv")
    whole = F.col("value") == F.floor("value")
    readings(spark, sf).coalesce(1).sortWithinPartitions(F.coalesce(whole, F.lit(True)).desc(), "event_id") \
        .write.option("header", True).csv(path)
    return _by_type(readers.load_series(spark, path, "ts"))


@query("scan_glob", sql(READINGS, _BY_TYPE))
def scan_glob(spark, sf):
    """A pattern over files whose columns differ in order and number."""
    folder = _scratch(spark, "glob")
    df = readings(spark, sf)
    for k, columns in enumerate((["event_id", "ts", "value", "event_type"], ["event_type", "value"], ["value", "user_id", "event_type"])):
        df.where(F.col("user_id") % 3 == k).select(*columns).write.option("header", True).csv(f"{folder}/part{k}")
    return _by_type(readers.read_many(spark, [f"{folder}/part*/*.csv"], as_text=("event_type",)))


@query("scan_sample", sql(READINGS, "SELECT event_id, value FROM readings ORDER BY ts, event_id LIMIT 10"))
def scan_sample(spark, sf):
    return readers.head_sample(readings(spark, sf), 10, ("ts", "event_id")).select("event_id", "value")


@query("parse_time_sorted", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed FROM orders
    ORDER BY o_orderdate, o_orderkey""")
def parse_time_sorted(spark, sf):
    texts = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"))
    parsed = readers.parse_time(texts, "ts")
    return parsed.orderBy("ts", "o_orderkey").select("o_orderkey", shown_time().alias("parsed"))


_PERSISTENCE = """forecast AS (
    SELECT period, split, event_id, ts, value,
           lag(value) OVER (PARTITION BY period, split ORDER BY ts, event_id) AS prediction FROM split)"""


def _forecast(spark, sf):
    """The reading before as a forecast, within each period and split."""
    assigned = pe.assign_periods(clean_readings(spark, sf), "ts", EVENT_PERIODS)
    split = temporal_split(assigned, ["ts", "event_id"], 0.8, ["period"])
    plan = FeaturePlan(lags={"value": [1]}, hour=False, day_of_year=False)
    from tidewright.operators.features import add_split_features

    return add_split_features(split, plan, "ts", ["period"]) \
        .withColumnRenamed("value_lag1", "prediction").where(F.col("prediction").isNotNull())


@query("predictions_sink", sql(READINGS, CLEAN, ASSIGNED, SPLIT, _PERSISTENCE, """
    SELECT 'persistence' AS model, period, count(*) AS n, round(sum("value"), 2) AS true_sum,
           round(sum(prediction), 2) AS prediction_sum
    FROM forecast WHERE split = 'test' AND prediction IS NOT NULL GROUP BY period"""))
def predictions_sink(spark, sf):
    path = _scratch(spark, "predictions")
    test = _forecast(spark, sf).where(F.col("split") == "test")
    frame = writers.predictions_frame(test, "ts", "value", "prediction", "persistence")
    for _ in range(2):
        writers.write_predictions(frame, path)
    schema = "time timestamp_ntz, true double, prediction double, model string, period string"
    return readers.read_csv(spark, path, schema).groupBy("model", "period").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("true"), 2).alias("true_sum"),
        F.round(F.sum("prediction"), 2).alias("prediction_sum"))


@query("append_results", sql(READINGS, """
    SELECT run, event_type, n, total FROM (SELECT event_type, count(*) AS n, round(sum(value), 2) AS total
    FROM readings GROUP BY event_type), (VALUES (1::BIGINT), (2::BIGINT)) AS runs(run)"""))
def append_results(spark, sf):
    path = _scratch(spark, "results")
    results = _by_type(readings(spark, sf)).select("event_type", "n", "total")
    for run in (1, 2):
        writers.append_results(results.withColumn("run", F.lit(run)), path)
    return readers.read_csv(spark, path, "event_type string, n long, total double, run long")


# ---------------------------------------------------------------- column choice

@query("select_numeric", sql(SENSORS, "SELECT key, amount, quantity, discount, tax FROM sensors"))
def select_numeric(spark, sf):
    df = sensors(spark, sf)
    return df.select(*co.numeric_columns(df, exclude=["ts", "lines"]))


@query("select_included", sql(SENSORS, "SELECT amount, tax FROM sensors"))
def select_included(spark, sf):
    df = sensors(spark, sf)
    return df.select(*co.numeric_columns(df, include=["amount", "tax", "no_such_column"]))


@query("auto_features", sql(SENSORS, " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS known FROM sensors" for c in MEASURES if c != "amount")))
def auto_features(spark, sf):
    df = sensors(spark, sf)
    names = co.resolve_features(df, AUTO, "amount", "ts", exclude=["key"])
    return df.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "known")


@query("time_first", sql(SENSORS, "SELECT 'ts' AS first_column, key, amount FROM sensors"))
def time_first(spark, sf):
    df = readers.time_first(sensors(spark, sf).select("key", "amount", "ts"), "ts")
    return df.select(F.lit(df.columns[0]).alias("first_column"), "key", "amount")


@query("assemble", sql(SENSORS, KNOWN, """
    SELECT key, amount AS label, CAST(4 AS BIGINT) AS size,
           round(quantity + discount + tax + lines, 6) AS total FROM known"""))
def assemble(spark, sf):
    df = known_sensors(spark, sf)
    features = co.feature_columns(df, "amount", ["ts", "key"])
    vectors = co.assemble(df, features, "amount", keep=["key"]).withColumn("x", vector_to_array("features"))
    total = F.aggregate("x", F.lit(0.0), lambda a, b: a + b)
    return vectors.select("key", "label", F.size("x").cast("long").alias("size"),
                          F.round(total, 6).alias("total"))


@query("residuals", sql(READINGS, CLEAN, ASSIGNED, SPLIT, _PERSISTENCE, """
    SELECT period, event_id, round(value - prediction, 6) AS residual FROM forecast
    WHERE prediction IS NOT NULL"""))
def residuals(spark, sf):
    df = co.with_residual(_forecast(spark, sf), "value", "prediction")
    return rounded(df.select("period", "event_id", "residual"), 6, "residual")


# ---------------------------------------------------------------- filters

@query("drop_missing", sql(SENSORS, "SELECT key, amount, tax FROM sensors WHERE amount IS NOT NULL"))
def drop_missing(spark, sf):
    return cl.drop_missing(sensors(spark, sf)).select("key", "amount", "tax")


@query("drop_missing_subset", sql(READINGS, """
    SELECT event_id, event_type, value FROM readings WHERE value IS NOT NULL"""))
def drop_missing_subset(spark, sf):
    return cl.drop_missing(readings(spark, sf), ["value"]).select("event_id", "event_type", "value")


@query("non_negative", sql(SENSORS, KNOWN, """
    SELECT key, tax, discount FROM known WHERE amount >= 0 AND quantity >= 0 AND discount >= 0 AND tax >= 0"""))
def non_negative(spark, sf):
    df = cl.drop_missing(sensors(spark, sf))
    return cl.non_negative(df, ["amount", "quantity", "discount", "tax"]).select("key", "tax", "discount")


@query("period_mask", """
    SELECT o_orderkey, strftime(o_orderdate, '%m-%d') AS day FROM orders
    WHERE strftime(o_orderdate, '%m-%d') BETWEEN '03-01' AND '05-15'""")
def period_mask(spark, sf):
    df = pe.filter_season(table(spark, sf, "orders"), "o_orderdate", ORDER_PERIODS[1])
    return df.select("o_orderkey", F.date_format("o_orderdate", "MM-dd").alias("day"))


@query("period_mask_wrap", """
    SELECT o_orderkey FROM orders
    WHERE strftime(o_orderdate, '%m-%d') >= '12-01' OR strftime(o_orderdate, '%m-%d') <= '02-28'""")
def period_mask_wrap(spark, sf):
    winter = Period("Winter", "12-01", "02-28")
    return pe.filter_season(table(spark, sf, "orders"), "o_orderdate", winter).select("o_orderkey")


@query("date_range", """
    SELECT event_id, value FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'""")
def date_range(spark, sf):
    return pe.filter_dates(events(spark, sf), "ts", "2024-01-05", "2024-01-12").select("event_id", "value")


def _iqr(source: str, columns: list[str], last: str) -> list[str]:
    """Subqueries that remove quartile outliers column after column."""
    out, current = [], source
    for i, c in enumerate(columns):
        target = last if i == len(columns) - 1 else f"{last}_{i}"
        out += [f"{last}_b{i} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {current})",
                f"{target} AS (SELECT s.* FROM {current} s, {last}_b{i} b "
                f"WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"]
        current = target
    return out


def _mahalanobis(source: str, a: str, b: str, target: str) -> list[str]:
    """Subquery with the distance of each row, by the closed inverse of a 2 x 2 covariance."""
    return [f"{target}_m AS (SELECT avg({a}) AS ma, avg({b}) AS mb, covar_samp({a}, {a}) AS vaa, "
            f"covar_samp({a}, {b}) AS vab, covar_samp({b}, {b}) AS vbb FROM {source})",
            f"{target} AS (SELECT s.*, sqrt((vbb * ({a} - ma) * ({a} - ma) - 2 * vab * ({a} - ma) * ({b} - mb) "
            f"+ vaa * ({b} - mb) * ({b} - mb)) / (vaa * vbb - vab * vab)) AS distance "
            f"FROM {source} s, {target}_m)"]


_NEAR = """SELECT key, amount, quantity FROM scored
    WHERE distance <= (SELECT quantile_cont(distance, 0.99) FROM scored)"""

_POSITIVE = "positive AS (SELECT * FROM known WHERE amount >= 0 AND quantity >= 0 AND lines >= 0)"


@query("iqr_sequential", sql(SENSORS, KNOWN, *_iqr("known", ["amount", "quantity", "lines"], "kept"),
                             "SELECT key, amount, quantity, lines FROM kept"))
def iqr_sequential(spark, sf):
    columns = ["amount", "quantity", "lines"]
    return cl.remove_outliers_iqr(known_sensors(spark, sf), columns).select("key", *columns)


@query("mahalanobis_quantile", sql(SENSORS, KNOWN, *_mahalanobis("known", "amount", "quantity", "scored"), _NEAR))
def mahalanobis_quantile(spark, sf):
    columns = ["amount", "quantity"]
    return cl.remove_outliers_mahalanobis(known_sensors(spark, sf), columns).select("key", *columns)


@query("mahalanobis_chi2", sql(SENSORS, KNOWN, *_mahalanobis("known", "amount", "lines", "scored"), """
    SELECT key, round(distance, 4) AS distance, distance > sqrt(9.210340371976182) AS outlier FROM scored"""))
def mahalanobis_chi2(spark, sf):
    flagged = cl.flag_mahalanobis(known_sensors(spark, sf), ["amount", "lines"], 0.99, keep=["key"])
    return rounded(flagged.select("key", "distance", "outlier"), 4, "distance")


@query("negative_examples", sql(SENSORS, """
    SELECT variable, key, value, rank FROM (
        SELECT variable, key, value, row_number() OVER (PARTITION BY variable ORDER BY ts, key) AS rank
        FROM (SELECT 'tax' AS variable, ts, key, tax AS value FROM sensors
              UNION ALL SELECT 'discount', ts, key, round(discount - 0.05, 6) FROM sensors)
        WHERE value < 0) WHERE rank <= 5"""))
def negative_examples(spark, sf):
    df = sensors(spark, sf).withColumn("discount", F.round(F.col("discount") - 0.05, 6))
    found = cl.negative_examples(df, ["tax", "discount"], ["ts", "key"])
    return found.select("variable", "key", "value", F.col("rank").cast("long").alias("rank"))


@query("select_period", sql(READINGS, CLEAN, ASSIGNED, "SELECT period, event_id FROM assigned WHERE period = 'late'"))
def select_period(spark, sf):
    chosen = pe.pick_periods(EVENT_PERIODS, ["LATE"])
    return pe.assign_periods(clean_readings(spark, sf), "ts", chosen).select("period", "event_id")


@query("min_samples_guard", """
    SELECT user_id, event_id FROM events
    WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 65)""")
def min_samples_guard(spark, sf):
    return pe.large_enough(events(spark, sf), ["user_id"], 65).select("user_id", "event_id")


@query("drop_constant_cols", sql(SENSORS, "SELECT key, amount, lines FROM sensors"))
def drop_constant_cols(spark, sf):
    df = sensors(spark, sf).select("key", "amount", "lines", F.lit(7.0).alias("fixed"))
    return cl.drop_constant_columns(df, ["amount", "lines", "fixed"])


_CLEAN_COLUMNS = ["amount", "quantity", "lines"]


@query("clean_all", sql(SENSORS, KNOWN, _POSITIVE.replace(" AND lines >= 0", ""),
                        *_iqr("positive", ["amount", "quantity"], "kept"),
                        *_mahalanobis("kept", "amount", "quantity", "scored"), _NEAR))
def clean_all(spark, sf):
    columns = ["amount", "quantity"]
    return cl.clean(sensors(spark, sf), columns).select("key", *columns)


@query("clean_iqr", sql(SENSORS, KNOWN, _POSITIVE, *_iqr("positive", _CLEAN_COLUMNS, "kept"),
                        "SELECT key, amount, quantity, lines FROM kept"))
def clean_iqr(spark, sf):
    options = cl.CleaningOptions(outliers="iqr")
    return cl.clean(sensors(spark, sf), _CLEAN_COLUMNS, options).select("key", *_CLEAN_COLUMNS)


@query("clean_mahal", sql(SENSORS, KNOWN, *_mahalanobis("known", "amount", "quantity", "scored"), _NEAR))
def clean_mahal(spark, sf):
    options = cl.CleaningOptions(negative=False, outliers="mahalanobis")
    return cl.clean(sensors(spark, sf), ["amount", "quantity"], options).select("key", "amount", "quantity")


@query("cleaning_audit", sql(SENSORS, KNOWN, _POSITIVE, *_iqr("positive", _CLEAN_COLUMNS, "kept"), """
    SELECT CAST(0 AS BIGINT) AS step, 'input' AS name, count(*) AS rows FROM sensors
    UNION ALL SELECT 1, 'missing', count(*) FROM known
    UNION ALL SELECT 2, 'negative', count(*) FROM positive
    UNION ALL SELECT 3, 'iqr', count(*) FROM kept"""))
def cleaning_audit(spark, sf):
    return cl.cleaning_audit(sensors(spark, sf), _CLEAN_COLUMNS, cl.CleaningOptions(outliers="iqr"))


# ---------------------------------------------------------------- joins

@query("assign_periods", """
    SELECT period, o_orderkey FROM orders JOIN (VALUES
        ('Januar–März', '01-01', '03-31'), ('März–Mitte Mai', '03-01', '05-15'),
        ('Mai–Oktober', '05-15', '10-31')) AS p(period, a, b)
    ON strftime(o_orderdate, '%m-%d') BETWEEN a AND b""")
def assign_periods(spark, sf):
    return pe.assign_periods(table(spark, sf, "orders"), "o_orderdate", ORDER_PERIODS) \
        .select("period", "o_orderkey")


_RULES = {"click": {"early": "30T"}, "view": {"late": "1H", "early": "2H"}}


@query("override_lookup", sql(READINGS, CLEAN, ASSIGNED, """
    SELECT event_type AS model, period, coalesce(override, '15T') AS rule, count(*) AS n
    FROM assigned LEFT JOIN (VALUES ('click', 'early', '30T'), ('view', 'late', '1H'), ('view', 'early', '2H'))
        AS o(model, name, override) ON o.model = event_type AND o.name = period
    GROUP BY ALL"""))
def override_lookup(spark, sf):
    assigned = pe.assign_periods(clean_readings(spark, sf), "ts", EVENT_PERIODS)
    labelled = assigned.withColumnRenamed("event_type", "model")
    settings = pe.settings_table(spark, _RULES, "string")
    return pe.with_override(labelled, settings, F.lit("15T"), "rule") \
        .groupBy("model", "period", "rule").agg(F.count(F.lit(1)).alias("n"))


RANGES = [DateRange("1", "2024-01-01", "2024-01-12"), DateRange("2", "2024-01-10", "2024-01-20"),
          DateRange("3", "2024-01-20", "2024-01-31")]
CONFIGS = [{"mode": "multiplicative", "prior": 0.009}, {"mode": "additive", "prior": 0.001},
           {"mode": "multiplicative", "prior": 0.00205}]


@query("period_config_join", """
    SELECT period, mode, prior, count(*) AS n, round(sum(value), 2) AS total FROM events JOIN (VALUES
        ('1', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-12', 'multiplicative', CAST(0.009 AS DOUBLE)),
        ('2', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20', 'additive', CAST(0.001 AS DOUBLE)),
        ('3', TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-31', 'multiplicative', CAST(0.00205 AS DOUBLE)))
        AS p(period, a, b, mode, prior) ON ts BETWEEN a AND b
    GROUP BY ALL""")
def period_config_join(spark, sf):
    assigned = pe.assign_ranges(events(spark, sf), "ts", RANGES)
    paired = pe.pair_with_configs(assigned, RANGES, CONFIGS, "mode string, prior double")
    return paired.groupBy("period", "mode", "prior").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("align_forecast", sql(READINGS, """
    SELECT event_id, value, yhat FROM (
        SELECT event_id, value, lag(value, 2) OVER (ORDER BY ts, event_id) AS yhat FROM readings)
    WHERE value IS NOT NULL AND yhat IS NOT NULL"""))
def align_forecast(spark, sf):
    df = readings(spark, sf).select("ts", "event_id", "value")
    plan = FeaturePlan(lags={"value": [2]}, hour=False, day_of_year=False)
    forecast = add_features(df, plan, ["ts", "event_id"]).select(
        "ts", "event_id", F.col("value_lag2").alias("yhat"))
    return me.align_forecast(df, forecast, ["ts", "event_id"]).select("event_id", "value", "yhat")


GRID = {"n_neighbors": [3, 5, 7], "weights": ["uniform", "distance"]}


@query("param_grid", sql(READINGS, CLEAN, """
    SELECT event_type AS model, n_neighbors, weights, count(*) AS n FROM clean,
        (VALUES (3::BIGINT), (5::BIGINT), (7::BIGINT)) AS a(n_neighbors),
        (VALUES ('uniform'), ('distance')) AS b(weights)
    GROUP BY ALL"""))
def param_grid(spark, sf):
    models = clean_readings(spark, sf).groupBy(F.col("event_type").alias("model")).agg(
        F.count(F.lit(1)).alias("n"))
    points = F.array(*[F.struct(F.lit(k).cast("long").alias("n_neighbors"), F.lit(w).alias("weights"))
                       for k, w in product(*GRID.values())])
    return models.withColumn("p", F.explode(points)).select("model", "p.n_neighbors", "p.weights", "n")


# ---------------------------------------------------------------- sets, shapes, top-k

@query("union_results", sql(READINGS, """
    SELECT event_type, count(*) AS n, CAST(NULL AS DOUBLE) AS total FROM readings GROUP BY event_type
    UNION ALL
    SELECT event_type, NULL, round(sum(value), 2) FROM readings GROUP BY event_type"""))
def union_results(spark, sf):
    by_type = readings(spark, sf).groupBy("event_type")
    return rs.union_results(by_type.agg(F.count(F.lit(1)).alias("n")),
                            by_type.agg(F.round(F.sum("value"), 2).alias("total")))


LABELS = {"amount": "amount [EUR]", "quantity": "quantity [1]"}


@query("unpivot_scaled", sql(SENSORS, KNOWN, """
    bounds AS (SELECT min(amount) AS a0, max(amount) AS a1, min(quantity) AS q0, max(quantity) AS q1 FROM known)
    """, """
    SELECT key, 'amount [EUR]' AS variable, round((amount - a0) / (a1 - a0), 6) AS scaled FROM known, bounds
    UNION ALL
    SELECT key, 'quantity [1]', round((quantity - q0) / (q1 - q0), 6) FROM known, bounds"""))
def unpivot_scaled(spark, sf):
    df = known_sensors(spark, sf).select("key", "amount", "quantity")
    scaled = minmax_scaler(df, ["amount", "quantity"]).transform(df)
    long = rs.to_long(co.rename_labels(scaled, LABELS), ["key"], list(LABELS.values()), "variable", "scaled")
    return rounded(long, 6, "scaled")


_SPLIT_METRICS = """metrics AS (
    SELECT period, split, count(*) AS n,
           1 - sum((value - prediction) * (value - prediction)) / (var_pop(value) * count(*)) AS r2,
           sqrt(avg((value - prediction) * (value - prediction))) AS rmse, avg(abs(value - prediction)) AS mae
    FROM forecast WHERE prediction IS NOT NULL GROUP BY period, split)"""


@query("unpivot_metrics", sql(READINGS, CLEAN, ASSIGNED, SPLIT, _PERSISTENCE, _SPLIT_METRICS, """
    SELECT period, CASE WHEN split = 'train' THEN 'Train' ELSE 'Test' END AS dataset, round(r2, 6) AS r2
    FROM metrics"""))
def unpivot_metrics(spark, sf):
    metrics = me.regression_metrics(_forecast(spark, sf), "value", "prediction", ["period", "split"])
    wide = me.wide_metrics(metrics, ["period"]).select(
        "period", F.col("train_r2").alias("Train R2"), F.col("test_r2").alias("Test R2"))
    long = rs.to_long(wide, ["period"], ["Train R2", "Test R2"], "dataset", "r2")
    return rounded(long.withColumn("dataset", rs.dataset_label("dataset")), 6, "r2")


@query("distinct_groups", sql(READINGS, CLEAN, ASSIGNED, """
    SELECT DISTINCT event_type AS model, period FROM assigned ORDER BY model, period"""))
def distinct_groups(spark, sf):
    assigned = pe.assign_periods(clean_readings(spark, sf), "ts", EVENT_PERIODS)
    return me.distinct_groups(assigned.withColumnRenamed("event_type", "model"), "model", "period")


@query("regression_metrics", sql(READINGS, CLEAN, ASSIGNED, SPLIT, _PERSISTENCE, _SPLIT_METRICS, """
    SELECT period, split, n, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM metrics"""))
def regression_metrics(spark, sf):
    metrics = me.regression_metrics(_forecast(spark, sf), "value", "prediction", ["period", "split"])
    return rounded(metrics, 6, "r2", "rmse", "mae")


@query("experiment_results", sql(READINGS, CLEAN, ASSIGNED, SPLIT, _PERSISTENCE, _SPLIT_METRICS, """
    SELECT period, max(round(r2, 6)) FILTER (split = 'train') AS train_r2,
           max(round(r2, 6)) FILTER (split = 'test') AS test_r2,
           max(round(rmse, 6)) FILTER (split = 'train') AS train_rmse,
           max(round(rmse, 6)) FILTER (split = 'test') AS test_rmse,
           max(round(mae, 6)) FILTER (split = 'train') AS train_mae,
           max(round(mae, 6)) FILTER (split = 'test') AS test_mae,
           max(n) FILTER (split = 'train') AS train_n, max(n) FILTER (split = 'test') AS test_n
    FROM metrics GROUP BY period"""))
def experiment_results(spark, sf):
    metrics = me.regression_metrics(_forecast(spark, sf), "value", "prediction", ["period", "split"])
    return me.wide_metrics(rounded(metrics, 6, "r2", "rmse", "mae"), ["period"])


@query("mean_absolute", sql(SENSORS, """
    SELECT 'tax' AS feature, round(avg(abs(tax)), 6) AS importance FROM sensors
    UNION ALL SELECT 'discount', round(avg(abs(discount)), 6) FROM sensors"""))
def mean_absolute(spark, sf):
    return rounded(me.mean_absolute(sensors(spark, sf), ["tax", "discount"]), 6, "importance")


@query("top_k", sql(SENSORS, "SELECT key, amount FROM sensors ORDER BY amount DESC NULLS LAST, key LIMIT 20"))
def top_k(spark, sf):
    return rs.top_k(sensors(spark, sf).select("key", "amount"), "amount", 20, tie="key")


# ---------------------------------------------------------------- scalar functions

@query("cyclic_time", """
    SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) + 0 AS hour_sin,
           round(cos(2 * pi() * hour(ts) / 24), 6) + 0 AS hour_cos,
           round(sin(2 * pi() * dayofyear(ts) / 365), 6) AS doy_sin,
           round(cos(2 * pi() * dayofyear(ts) / 365), 6) AS doy_cos FROM events""")
def cyclic_time(spark, sf):
    df = events(spark, sf).select("event_id", *cyclic_columns("ts"))
    return df.select("event_id", *[(F.round(c, 6) + 0).alias(c) for c in df.columns[1:]])


@query("safe_label", """
    SELECT o_orderkey, replace(replace(replace(replace(replace(replace(
        CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' ELSE o_orderpriority || ' für März–Größe' END,
        ' ', '_'), '–', '-'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') AS label FROM orders""")
def safe_label_query(spark, sf):
    text = F.when(F.col("o_orderpriority") != "5-LOW",
                  F.concat("o_orderpriority", F.lit(" für März–Größe")))
    return table(spark, sf, "orders").select("o_orderkey", safe_label(text).alias("label"))


@query("zscore", sql(SENSORS, KNOWN, """
    SELECT key, round((amount - (SELECT avg(amount) FROM known)) / (SELECT stddev_samp(amount) FROM known), 6)
        AS amount FROM known"""))
def zscore_query(spark, sf):
    return rounded(zscore(known_sensors(spark, sf).select("key", "amount"), ["amount"]), 6, "amount")
