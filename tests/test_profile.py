import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewright.operators import profile as pr
from tidewright.spec import AUTO


@pytest.fixture(scope="module")
def quarter_hours(spark):
    """10,000 readings from 2016-01-01 00:00 to 2016-04-14 03:45."""
    return spark.range(10_000).select(
        F.timestamp_seconds(F.lit(1_451_606_400) + F.col("id") * 900).cast("timestamp_ntz").alias("TIME"),
        F.when(F.col("id") >= 43, F.sin("id") + 2).alias("N2O"), F.cos("id").alias("DO"))


def test_known_plan(quarter_hours):
    plan = pr.analyze(quarter_hours)
    assert (plan.time, plan.target, plan.features) == ("TIME", "N2O", ["DO"])
    assert (plan.resolution, plan.days) == ("15T", 104)
    assert plan.lags == {AUTO: [1, 4, 16, 64]} and plan.windows == {AUTO: [4, 24, 96, 672]}
    assert [(p.name, p.start, p.end) for p in plan.periods] == [
        ("2016_Q1", "01-01", "03-31"), ("2016_Q2", "04-01", "06-30"),
        ("2016_Q3", "07-01", "09-30"), ("2016_Q4", "10-01", "12-31")]


def test_windows_of_other_resolutions():
    minute = 60_000_000
    assert [pr.suggest_windows(m * minute) for m in (1, 60, 1440)] == [[60, 360], [1, 6, 24, 168], [1, 7]]
    assert pr.suggest_windows(90 * minute) == pr.suggest_windows(60 * minute)
    assert pr.suggest_windows(30_000_000) == pr.suggest_windows(0) == pr.suggest_windows(minute)
    assert pr.suggest_windows(None) == pr.suggest_windows(15 * minute) == [4, 24, 96, 672]
    assert pr.suggest_lags() == [1, 4, 16, 64]


def test_labels_of_gaps(spark):
    gaps = [0, 30_000_000, 59_999_999, 60_000_000, 5_400_000_000, 86_400_000_000, 200_000_000_000]
    df = spark.createDataFrame([(g,) for g in gaps], "g long").select(pr.resolution_label(F.col("g")).alias("label"))
    assert [r.label for r in df.collect()] == ["0S", "30S", "59S", "1T", "1H", "1D", "2D"]


def test_one_late_value_makes_a_column_no_time(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4999, "2016-01-01").otherwise("soon").alias("t"), F.lit("2016-01-01").alias("u"))
    assert pr.datetime_columns(df.coalesce(1)) == ["u"]


def test_periods_by_length():
    day = dt.datetime
    assert [p.name for p in pr.suggest_periods(day(2015, 1, 1), day(2016, 6, 1), 500)] == \
        ["Winter", "Spring", "Summer", "Autumn"]
    months = pr.suggest_periods(day(2015, 12, 15), day(2016, 2, 1), 48)
    assert [(p.name, p.start, p.end) for p in months] == [
        ("2015_12", "12-01", "12-31"), ("2016_01", "01-01", "01-31"), ("2016_02", "02-01", "02-29")]


def test_time_columns(spark):
    df = spark.createDataFrame([("2016-01-01", "x", 5, "2016-01-02")] * 3, "a string, b string, n long, update_date string")
    assert pr.datetime_columns(df) == ["a", "update_date"]
    assert pr.detect_time_column(df) == "update_date"
    assert pr.detect_time_column(df.select("b", "n")) is None
    empty = df.withColumn("a", F.lit(None).cast("string")).select("a")
    assert pr.datetime_columns(empty) == []


def test_targets_and_resolution(spark):
    df = spark.createDataFrame([(1.0, 2, 1.0), (2.0, 2, 9.0)], "level double, amount_n long, flow double")
    got = [(r["column"], round(r.confidence, 1)) for r in pr.target_candidates(df).orderBy("ordinal").collect()]
    assert got == [("level", 1.0), ("amount_n", 0.6)]
    assert pr.target_candidates(df.select("flow")).count() == 0
    two = spark.createDataFrame([("2016-01-01",), ("2016-01-03",)], "t string").selectExpr("cast(t as timestamp_ntz) as ts")
    assert pr.time_resolution(two, "ts", ["ts"]).first().resolution == "2D"
    assert pr.time_resolution(two.limit(1), "ts", ["ts"]).first() is None
