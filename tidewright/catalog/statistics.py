"""Profiles, summaries, correlations, distributions and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalog.base import (
    KNOWN, MEASURES, READINGS, SENSORS, clean_readings, events, known_sensors, query, readings, rounded,
    sensors, shown_time, sql, table)
from tidewright.operators import correlate as cr
from tidewright.operators import profile as pr
from tidewright.operators import resample as rp
from tidewright.operators import stats as st
from tidewright.spec import AUTO, expand_auto

_SENSOR_COLUMNS = ["amount", "quantity", "tax"]


def _union(template: str, columns) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query("profile_columns", sql(SENSORS, " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", 'double' AS dtype, count(*) - count({c}) AS null_count,
        round((count(*) - count({c})) * 100.0 / count(*), 6) AS null_percentage,
        count(DISTINCT {c}) AS unique_count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        min({c}) AS min, max({c}) AS max FROM sensors""" for c in _SENSOR_COLUMNS) + """
    UNION ALL SELECT 'ts', 'timestamp_ntz', count(*) - count(ts), 0, count(DISTINCT ts),
        NULL, NULL, NULL, NULL FROM sensors"""))
def profile_columns(spark, sf):
    out = st.profile_columns(sensors(spark, sf).select("ts", *_SENSOR_COLUMNS))
    return rounded(rounded(out, 4, "mean", "std"), 6, "null_percentage")


@query("profile_text_columns", _union("""
    SELECT '{c}' AS "column", 'string' AS dtype, count(*) - count({c}) AS null_count,
        count(DISTINCT {c}) AS unique_count FROM orders""", ["o_orderstatus", "o_orderpriority"]))
def profile_text_columns(spark, sf):
    out = st.profile_columns(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))
    return out.select("column", "dtype", "null_count", "unique_count")


@query("missing_table", sql(SENSORS, _union("""
    SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
        round((count(*) - count({c})) * 100.0 / count(*), 2) AS percentage FROM sensors""", MEASURES)))
def missing_table(spark, sf):
    return st.missing_table(sensors(spark, sf), MEASURES)


@query("dataset_overview", sql(SENSORS, f"""
    SELECT count(*) AS rows, CAST(7 AS BIGINT) AS columns,
        {' + '.join(f'(count(*) - count({c}))' for c in MEASURES)} AS missing_cells FROM sensors"""))
def dataset_overview(spark, sf):
    return st.overview(sensors(spark, sf))


@query("duplicate_count", """
    SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (
        SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag, l_linestatus)""")
def duplicate_count(spark, sf):
    return st.duplicate_count(table(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


@query("negative_counts", sql(SENSORS, _union(
    """SELECT '{c}' AS "column", count(*) FILTER ({c} < 0) AS negative FROM sensors""", MEASURES)))
def negative_counts(spark, sf):
    return st.negative_counts(sensors(spark, sf), MEASURES)


@query("summary_stats", sql(SENSORS, _union("""
    SELECT '{c}' AS "column", round(stddev_samp({c}), 3) AS std, round(kurtosis({c}), 3) AS kurtosis,
        max({c}) AS max, min({c}) AS min, round(avg({c}), 3) AS mean, round(median({c}), 3) AS median,
        round(max({c}) - min({c}), 3) AS range FROM sensors""", ["amount", "quantity"])))
def summary_stats(spark, sf):
    return st.summary(sensors(spark, sf), ["amount", "quantity"])


@query("target_stats", sql(READINGS, """
    SELECT count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
        min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(median(value), 6) AS q50,
        round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM readings"""))
def target_stats(spark, sf):
    return rounded(st.target_stats(readings(spark, sf), "value"), 6, "mean", "std", "q25", "q50", "q75")


_PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]


@query("quantiles", sql(SENSORS, " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST({p} AS DOUBLE) AS prob, round(quantile_cont({c}, {p}), 6) AS value FROM sensors"""
    for c in ["amount", "discount"] for p in _PROBS)))
def quantiles_query(spark, sf):
    return rounded(st.quantile_table(sensors(spark, sf), ["amount", "discount"], _PROBS), 6, "value")


@query("quantiles_narrowed", sql(READINGS, " UNION ALL ".join(
    f"""SELECT CAST({p} AS DOUBLE) AS prob, round(quantile_cont(value, {p}), 6) AS value FROM readings"""
    for p in _PROBS)))
def quantiles_narrowed(spark, sf):
    from tidewright.operators.quantiles import quantiles

    found = quantiles(readings(spark, sf), ["value"], _PROBS, exact_rows=500)["value"]
    return rounded(spark.createDataFrame(list(zip(_PROBS, found)), "prob double, value double"), 6, "value")


_FIFTY = [round((k + 0.5) / 50, 2) for k in range(50)]


@query("quantiles_many", sql(READINGS, """SELECT unnest(range(50)) AS place, round(unnest(quantile_cont(value, [{}])), 6) AS value
    FROM readings""".format(", ".join(map(str, _FIFTY)))))
def quantiles_many(spark, sf):
    """Fifty quantiles of a column that counts as long: the same two passes as for one."""
    from tidewright.operators.quantiles import quantiles

    found = quantiles(readings(spark, sf), ["value"], _FIFTY, exact_rows=500)["value"]
    return rounded(spark.createDataFrame(list(enumerate(found)), "place long, value double"), 6, "value")


_CORR = ["amount", "quantity", "discount", "lines"]


@query("corr_matrix", sql(SENSORS, " UNION ALL ".join(
    f"""SELECT '{a}' AS "row", '{b}' AS col, round(corr({a}, {b}), 6) AS corr FROM sensors"""
    for a in _CORR for b in _CORR)))
def corr_matrix(spark, sf):
    return rounded(st.correlation_matrix(sensors(spark, sf), _CORR), 6, "corr")


@query("target_correlation", sql(SENSORS, """
    SELECT feature, correlation FROM (""" + _union(
    "SELECT '{c}' AS feature, round(corr({c}, amount), 6) AS correlation FROM sensors", _CORR[1:]) + """)
    ORDER BY abs(correlation) DESC"""))
def target_correlation(spark, sf):
    return rounded(st.target_correlation(sensors(spark, sf), _CORR[1:], "amount"), 6, "correlation")


@query("covariance_matrix", sql(SENSORS, KNOWN, """m AS (
    SELECT avg(quantity) AS ma, avg(lines) AS mb, covar_samp(quantity, quantity) AS vaa,
           covar_samp(quantity, lines) AS vab, covar_samp(lines, lines) AS vbb FROM known)""", """
    SELECT "row", col, round(row_mean, 6) AS row_mean, round(cov, 4) AS cov, round(inverse, 6) AS inverse FROM (
        SELECT 'quantity' AS "row", 'quantity' AS col, ma AS row_mean, vaa AS cov, vbb / (vaa * vbb - vab * vab) AS inverse FROM m
        UNION ALL SELECT 'quantity', 'lines', ma, vab, -vab / (vaa * vbb - vab * vab) FROM m
        UNION ALL SELECT 'lines', 'quantity', mb, vab, -vab / (vaa * vbb - vab * vab) FROM m
        UNION ALL SELECT 'lines', 'lines', mb, vbb, vaa / (vaa * vbb - vab * vab) FROM m)"""))
def covariance_matrix(spark, sf):
    out = st.covariance_table(known_sensors(spark, sf), ["quantity", "lines"])
    return rounded(rounded(out, 6, "row_mean", "inverse"), 4, "cov")


@query("histogram", sql(SENSORS, KNOWN, """
    b AS (SELECT min(amount) AS lo, (max(amount) - min(amount)) / 40 AS w FROM known),
    c AS (SELECT least(CAST(floor((amount - lo) / w) AS BIGINT), 39) AS bin, count(*) AS n FROM known, b GROUP BY 1)
    """, """
    SELECT r.bin, round(lo + r.bin * w, 4) AS low, round(lo + (r.bin + 1) * w, 4) AS high, coalesce(n, 0) AS count
    FROM (SELECT unnest(range(40)) AS bin) r CROSS JOIN b LEFT JOIN c ON c.bin = r.bin"""))
def histogram(spark, sf):
    return rounded(st.histogram(known_sensors(spark, sf), "amount", 40), 4, "low", "high")


_BOX = """(SELECT quantile_cont({e}, 0.25) AS q1, quantile_cont({e}, 0.5) AS q2, quantile_cont({e}, 0.75) AS q3 FROM {s})"""


def _boxplot(source, columns):
    return " UNION ALL ".join(f"""
        SELECT '{c}' AS "column", round(q1, 6) AS q1, round(q2, 6) AS median, round(q3, 6) AS q3,
            round(min(CASE WHEN {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {c} END), 6) AS whisker_low,
            round(max(CASE WHEN {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {c} END), 6) AS whisker_high,
            count(*) FILTER (NOT ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS outliers
        FROM {source}, {_BOX.format(e=c, s=source)} GROUP BY q1, q2, q3""" for c in columns)


_SCALED = """scaled AS (
    SELECT (amount - min(amount) OVER ()) / (max(amount) OVER () - min(amount) OVER ()) AS amount,
           (quantity - min(quantity) OVER ()) / (max(quantity) OVER () - min(quantity) OVER ()) AS quantity FROM known)"""

_BOX_VALUES = ("q1", "median", "q3", "whisker_low", "whisker_high")


@query("boxplot_stats", sql(SENSORS, KNOWN, _boxplot("known", ["amount", "quantity"])))
def boxplot_stats(spark, sf):
    return rounded(st.boxplot_stats(known_sensors(spark, sf), ["amount", "quantity"]), 6, *_BOX_VALUES)


@query("boxplot_stats_scaled", sql(SENSORS, KNOWN, _SCALED, _boxplot("scaled", ["amount", "quantity"])))
def boxplot_stats_scaled(spark, sf):
    from tidewright.operators.scale import minmax_scaler

    df = known_sensors(spark, sf).select("amount", "quantity")
    scaled = minmax_scaler(df, ["amount", "quantity"]).transform(df)
    return rounded(st.boxplot_stats(scaled, ["amount", "quantity"]), 6, *_BOX_VALUES)


_RESIDUALS = """residuals AS (
    SELECT value - lag(value) OVER (ORDER BY ts, event_id) AS residual FROM clean)"""


def _residuals(spark, sf):
    from tidewright.operators.features import add_features
    from tidewright.spec import FeaturePlan

    plan = FeaturePlan(lags={"value": [1]}, hour=False, day_of_year=False)
    df = add_features(clean_readings(spark, sf), plan, ["ts", "event_id"])
    return df.select((F.col("value") - F.col("value_lag1")).alias("residual"))


@query("residual_histogram", sql(READINGS, "clean AS (SELECT * FROM readings WHERE value >= 0)", _RESIDUALS, """
    b AS (SELECT min(residual) AS lo, (max(residual) - min(residual)) / 30 AS w FROM residuals),
    c AS (SELECT least(CAST(floor((residual - lo) / w) AS BIGINT), 29) AS bin, count(*) AS n
          FROM residuals, b WHERE residual IS NOT NULL GROUP BY 1)""", """
    SELECT r.bin, coalesce(n, 0) AS count
    FROM (SELECT unnest(range(30)) AS bin) r LEFT JOIN c ON c.bin = r.bin"""))
def residual_histogram(spark, sf):
    return st.histogram(_residuals(spark, sf), "residual", 30).select("bin", "count")


@query("residual_kde", sql(READINGS, "clean AS (SELECT * FROM readings WHERE value >= 0)", _RESIDUALS, """
    b AS (SELECT min(residual) AS lo, max(residual) AS hi, count(residual) AS n,
                 stddev_samp(residual) * pow(count(residual), -0.2) AS h FROM residuals),
    g AS (SELECT point, lo - 3 * h + (hi - lo + 6 * h) / 199 * point AS x, h, n
          FROM (SELECT unnest(range(200)) AS point), b)""", """
    SELECT point, round(x, 4) AS x, round(sum(exp(-0.5 * pow((x - residual) / h, 2))) / (n * h * sqrt(2 * pi())), 9) AS density
    FROM g, residuals WHERE residual IS NOT NULL GROUP BY point, x, h, n"""))
def residual_kde(spark, sf):
    density = st.kernel_density(_residuals(spark, sf), "residual")
    return rounded(rounded(density, 4, "x"), 9, "density")


# ---------------------------------------------------------------- time structure

@query("date_range_profile", """
    SELECT strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last,
        CAST(floor(date_diff('microsecond', min(o_orderdate), max(o_orderdate)) / 86400000000.0) AS BIGINT) AS days,
        true AS daily, false AS weekly, date_diff('day', min(o_orderdate), max(o_orderdate)) > 300 AS yearly
    FROM orders""")
def date_range_profile(spark, sf):
    span = pr.date_range(table(spark, sf, "orders"), "o_orderdate")
    return span.select(shown_time("start").alias("first"), shown_time("end").alias("last"),
                       "days", "daily", "weekly", "yearly")


_GAPS = """gaps AS (SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts, event_id), ts) AS gap_us FROM events),
    top AS (SELECT gap_us, count(*) AS gaps FROM gaps WHERE gap_us IS NOT NULL
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
    res AS (SELECT gap_us, gaps, CASE WHEN gap_us < 60000000 THEN CAST(gap_us // 1000000 AS BIGINT) || 'S'
        WHEN gap_us < 3600000000 THEN CAST(gap_us // 60000000 AS BIGINT) || 'T'
        WHEN gap_us < 86400000000 THEN CAST(gap_us // 3600000000 AS BIGINT) || 'H'
        ELSE CAST(gap_us // 86400000000 AS BIGINT) || 'D' END AS resolution FROM top),
    step AS (SELECT greatest(1, CAST(gap_us // 60000000 AS BIGINT)) AS minutes FROM res),
    horizons AS (SELECT DISTINCT greatest(1, m // minutes) AS step
        FROM step, (VALUES (60::BIGINT), (360::BIGINT), (1440::BIGINT), (10080::BIGINT)) AS v(m)
        WHERE greatest(1, m // minutes) <= 1000)"""


def _resolution(spark, sf):
    return pr.time_resolution(events(spark, sf), "ts", ["ts", "event_id"])


@query("time_resolution", sql(_GAPS, "SELECT gap_us, gaps, resolution FROM res"))
def time_resolution(spark, sf):
    return _resolution(spark, sf)


@query("suggest_lags", """SELECT step, count(value) AS known FROM events, (VALUES (1::BIGINT), (4::BIGINT), (16::BIGINT), (64::BIGINT)) AS v(step)
    GROUP BY step""")
def suggest_lags(spark, sf):
    """Lags proposed for the series, each with the values it can be taken of."""
    plan = pr.analyze(events(spark, sf), ties=["event_id"])
    steps = F.explode(F.array(*[F.lit(k).cast("long") for k in plan.lags[AUTO]]))
    return events(spark, sf).select("value", steps.alias("step")).groupBy("step").agg(F.count("value").alias("known"))


@query("suggest_windows", sql(_GAPS, "SELECT step FROM horizons"))
def suggest_windows(spark, sf):
    gap = _resolution(spark, sf).first()["gap_us"]
    return spark.createDataFrame([(k,) for k in pr.suggest_windows(gap)], "step long")


@query("suggest_periods_monthly", """
    SELECT strftime(m, '%Y_%m') AS name, strftime(m, '%m-01') AS start_date,
        strftime(last_day(m), '%m-%d') AS end_date, strftime(m, '%B %Y') AS description
    FROM (SELECT unnest(generate_series(date_trunc('month', min(ts)), max(ts), INTERVAL 1 MONTH)) AS m FROM events)""")
def suggest_periods_monthly(spark, sf):
    return pr.suggested_periods_table(events(spark, sf), "ts")


_HALF = 181  # days; the dates of all orders are folded into so many


@query("suggest_periods_quarterly", f"""
    SELECT year(a) || '_' || q AS name, s AS start_date, e AS end_date,
        q || ' ' || year(a) || ' (' || s || ' to ' || e || ')' AS description
    FROM (SELECT min(d) AS a, date_diff('day', min(d), max(d)) AS days FROM (
            SELECT DATE '1995-01-01' + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % {_HALF} AS INTEGER) AS d FROM orders)),
        (VALUES ('Q1', '01-01', '03-31'), ('Q2', '04-01', '06-30'), ('Q3', '07-01', '09-30'), ('Q4', '10-01', '12-31')) AS v(q, s, e)
    WHERE days BETWEEN 91 AND 365""")
def suggest_periods_quarterly(spark, sf):
    """All orders, with their dates folded into half a year."""
    first = F.lit("1995-01-01").cast("date")
    folded = F.date_add(first, (F.datediff(F.col("o_orderdate").cast("date"), first) % _HALF).cast("int"))
    return pr.suggested_periods_table(table(spark, sf, "orders").select(folded.cast("timestamp_ntz").alias("day")), "day")


@query("suggest_periods_season", """
    SELECT v.* FROM (SELECT max(o_orderdate) - min(o_orderdate) AS d FROM orders), (VALUES
        ('Winter', '12-01', '02-28', 'Winter period (Dec-Feb)'), ('Spring', '03-01', '05-31', 'Spring period (Mar-May)'),
        ('Summer', '06-01', '08-31', 'Summer period (Jun-Aug)'), ('Autumn', '09-01', '11-30', 'Autumn period (Sep-Nov)'))
        AS v(name, start_date, end_date, description) WHERE d > INTERVAL 365 DAY""")
def suggest_periods_season(spark, sf):
    return pr.suggested_periods_table(table(spark, sf, "orders"), "o_orderdate")


def _dated_text(spark, sf):
    """Orders with the date as text, as a CSV without types would give it."""
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), "o_totalprice")


@query("detect_datetime_columns", """
    SELECT 'order_date' AS "column", count(TRY_CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP)) AS parsed FROM orders""")
def detect_datetime_columns(spark, sf):
    """One text column of dates; another whose latest rows alone are none."""
    df = _dated_text(spark, sf)
    last = df.agg(F.max("o_orderkey")).first()[0]
    df = df.withColumn("shipped", F.when(F.col("o_orderkey") < last, F.col("order_date")).otherwise("not yet"))
    names = pr.datetime_columns(df)
    return df.agg(*[F.count(F.try_to_timestamp(c)).alias(c) for c in names]).unpivot([], names, "column", "parsed")


@query("detect_time_column", """
    SELECT 'order_date' AS time_column, count(*) AS n FROM orders""")
def detect_time_column(spark, sf):
    df = _dated_text(spark, sf)
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(pr.detect_time_column(df)).alias("time_column"), "n")


@query("suggest_target", sql(SENSORS, """
    SELECT name AS "column", CAST(round(0.6 + 0.2 + CASE WHEN cv > 0.1 AND cv < 2.0 THEN 0.2 ELSE 0 END, 6) AS DOUBLE) AS confidence FROM (
        SELECT 'quantity' AS name, stddev_samp(quantity) / abs(avg(quantity)) AS cv FROM sensors
        UNION ALL SELECT 'amount', stddev_samp(amount) / abs(avg(amount)) FROM sensors)
    UNION ALL SELECT 'key', CAST(0.6 + CASE WHEN stddev_samp(key) / avg(key) BETWEEN 0.1 AND 2 THEN 0.2 ELSE 0 END AS DOUBLE) FROM sensors"""))
def suggest_target(spark, sf):
    return rounded(pr.target_candidates(sensors(spark, sf)), 6, "confidence").select("column", "confidence")


@query("recommended_features", sql(SENSORS, _union(
    "SELECT '{c}' AS feature, count({c}) AS known FROM sensors", ["discount", "tax", "lines"])))
def recommended_features(spark, sf):
    df = sensors(spark, sf)
    names = pr.recommended_features(df)
    return df.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "feature", "known")


_STEPS = {AUTO: [1, 2], "tax": [4]}


@query("expand_auto_features", sql(SENSORS, """
    steps AS (SELECT f AS name, k FROM (VALUES ('quantity'), ('discount'), ('lines')) AS a(f),
              (VALUES (1::BIGINT), (2::BIGINT)) AS b(k) UNION ALL SELECT 'tax', 4)""", """
    SELECT name AS "column", k AS step, CASE name WHEN 'quantity' THEN count(quantity) WHEN 'discount' THEN count(discount)
        WHEN 'lines' THEN count(lines) ELSE count(tax) END AS known FROM steps, sensors GROUP BY name, k"""))
def expand_auto_features(spark, sf):
    df = sensors(spark, sf)
    plan = expand_auto(_STEPS, ["quantity", "discount", "tax", "lines"])
    points = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).cast("long").alias("step"),
                                F.col(c).alias("known")) for c, steps in plan.items() for k in steps])
    return df.agg(*[F.count(c).alias(c) for c in plan]).select(F.explode(points).alias("p")).select("p.*")


@query("dataset_plan", sql(_GAPS, """
    SELECT 'ts' AS time, CAST(NULL AS VARCHAR) AS target, 'event_id,user_id,value' AS features, 'event_id,user_id,value' AS numeric,
        'ts,event_type' AS categorical, 'ts' AS datetimes, (SELECT resolution FROM res) AS resolution,
        CAST(floor(date_diff('microsecond', min(ts), max(ts)) / 86400000000.0) AS BIGINT) AS days, '1,4,16,64' AS lags,
        (SELECT string_agg(step, ',' ORDER BY step) FROM horizons) AS windows,
        strftime(min(ts), '%Y_%m') AS periods
    FROM events"""))
def dataset_plan(spark, sf):
    plan = pr.analyze(events(spark, sf), ties=["event_id"])
    shown = lambda values: ",".join(str(v) for v in values)
    row = (plan.time, plan.target, shown(plan.features), shown(plan.numeric), shown(plan.categorical), shown(plan.datetimes),
           plan.resolution, plan.days, shown(plan.lags[AUTO]), shown(plan.windows[AUTO]), shown(p.name for p in plan.periods))
    return spark.createDataFrame([row], "time string, target string, features string, numeric string, categorical string, "
                                 "datetimes string, resolution string, days long, lags string, windows string, periods string")


# ---------------------------------------------------------------- lagged correlation and grids

_PAIRED = """placed AS (
    SELECT row_number() OVER (ORDER BY ts, event_id) AS idx, value, CAST(user_id AS DOUBLE) AS load FROM readings
    WHERE value IS NOT NULL),
    lagged AS (
    SELECT lag, corr(a.value, b.load) AS corr FROM (SELECT unnest(range(-96, 97)) AS lag), placed a, placed b
    WHERE b.idx = a.idx - lag GROUP BY lag)"""


def _cross(spark, sf, **options):
    df = readings(spark, sf).withColumn("load", F.col("user_id").cast("double"))
    return cr.cross_correlation(df, "value", "load", ["ts", "event_id"], **options)


@query("cross_correlation", sql(READINGS, _PAIRED, "SELECT lag, CAST(lag AS DOUBLE) / 4 AS hours, round(corr, 6) AS corr FROM lagged"))
def cross_correlation(spark, sf):
    return rounded(_cross(spark, sf), 6, "hours", "corr")


@query("cross_correlation_chunked", sql(READINGS, _PAIRED, "SELECT lag, round(corr, 6) AS corr FROM lagged"))
def cross_correlation_chunked(spark, sf):
    out = _cross(spark, sf, chunk_rows=500, max_group_rows=1000, range_rows=1500)
    return rounded(out.select("lag", "corr"), 6, "corr")


@query("best_lag", sql(READINGS, _PAIRED, "SELECT lag, round(corr, 6) AS corr FROM lagged ORDER BY abs(corr) DESC, lag LIMIT 1"))
def best_lag(spark, sf):
    return rounded(cr.best_lag(_cross(spark, sf)).select("lag", "corr"), 6, "corr")


def _autocorrelation_sql(lags: int) -> str:
    return sql(READINGS, """placed AS (
        SELECT row_number() OVER (ORDER BY ts, event_id) AS idx, value FROM readings WHERE value IS NOT NULL),
        m AS (SELECT avg(value) AS mean, var_pop(value) * count(*) AS spread, count(*) AS n FROM placed)""", f"""
        SELECT lag, round(sum((a.value - mean) * (b.value - mean)) / spread, 6) AS autocorr,
            round(1.959963984540054 / sqrt(n), 6) AS band95, round(2.5758293035489004 / sqrt(n), 6) AS band99
        FROM (SELECT unnest(range(1, {lags + 1})) AS lag), placed a, placed b, m WHERE b.idx = a.idx + lag
        GROUP BY lag, spread, n""")


@query("autocorrelation", _autocorrelation_sql(100))
def autocorrelation(spark, sf):
    out = cr.autocorrelation(readings(spark, sf), "value", ["ts", "event_id"], 100)
    return rounded(out, 6, "autocorr", "band95", "band99")


@query("autocorrelation_long", _autocorrelation_sql(10_000))
def autocorrelation_long(spark, sf):
    out = cr.autocorrelation(readings(spark, sf), "value", ["ts", "event_id"], 10_000)
    return rounded(out, 6, "autocorr", "band95", "band99")


@query("resample_mean", sql(READINGS, """
    SELECT strftime(time_bucket(INTERVAL 30 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, round(avg(value), 6) AS value
    FROM readings GROUP BY time_bucket(INTERVAL 30 MINUTE, ts)"""))
def resample_mean(spark, sf):
    out = rp.resample_mean(readings(spark, sf), "30T", "ts", ["value"], dense=False)
    return out.select(shown_time().alias("start"), F.round("value", 6).alias("value"))


@query("resample_mean_dense", sql(READINGS, """
    bins AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS b, avg(value) AS value FROM readings GROUP BY 1),
    grid AS (SELECT unnest(generate_series(min(b), max(b), INTERVAL 15 MINUTE)) AS b FROM bins)""", """
    SELECT strftime(grid.b, '%Y-%m-%d %H:%M:%S') AS start, round(value, 6) AS value FROM grid LEFT JOIN bins ON bins.b = grid.b"""))
def resample_mean_dense(spark, sf):
    out = rp.resample_mean(readings(spark, sf), "15T", "ts", ["value"])
    return out.select(shown_time().alias("start"), F.round("value", 6).alias("value"))


@query("resample_by_type", sql(READINGS, """
    bins AS (SELECT event_type, time_bucket(INTERVAL 7 HOUR, ts, (SELECT date_trunc('day', min(ts)) FROM readings)) AS b,
             avg(value) AS value FROM readings GROUP BY ALL),
    grid AS (SELECT event_type, unnest(generate_series(min(b), max(b), INTERVAL 7 HOUR)) AS b FROM bins GROUP BY event_type)
    """, """
    SELECT event_type, strftime(b, '%Y-%m-%d %H:%M:%S') AS start, round(value, 6) AS value
    FROM grid LEFT JOIN bins USING (event_type, b)"""))
def resample_by_type(spark, sf):
    out = rp.resample_mean(readings(spark, sf), "7H", "ts", ["value"], keys=["event_type"])
    return out.select("event_type", shown_time().alias("start"), F.round("value", 6).alias("value"))
