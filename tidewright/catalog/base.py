"""Registry of queries, and the two series they run on.

``readings`` is the events table seen as one irregular sensor: error events carry no
reading, and the sensor's zero is off by five, so some readings are missing and some
negative. ``sensors`` is a wide table with one row per order: its date, and sums and
means of its lines. Orders without lines have missing measures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.spec import Period

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that gives the same rows where there is one."""
    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def sql(*parts: str) -> str:
    """Named subqueries followed by the final SELECT."""
    *named, final = parts
    return f"WITH {', '.join(named)} {final}" if named else final


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def shown_time(column: str = "ts") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")


def readings(spark, sf) -> DataFrame:
    value = F.when(F.col("event_type") != "error", F.round(F.col("value") - 5, 2))
    return events(spark, sf).withColumn("value", value)


READINGS = """readings AS (
    SELECT event_id, ts, user_id, event_type,
           CASE WHEN event_type <> 'error' THEN round(value - 5, 2) END AS value
    FROM events)"""

CLEAN = """clean AS (SELECT * FROM readings WHERE value IS NOT NULL AND value >= 0)"""


def clean_readings(spark, sf) -> DataFrame:
    return readings(spark, sf).where(F.col("value").isNotNull() & (F.col("value") >= 0))


MEASURES = ["amount", "quantity", "discount", "tax", "lines"]


def sensors(spark, sf) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("amount"),
        F.sum("l_quantity").alias("quantity"),
        F.round(F.avg("l_discount"), 6).alias("discount"),
        F.round(F.avg("l_tax") - 0.01, 6).alias("tax"),
        F.count(F.lit(1)).cast("double").alias("lines"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("key"))
    return orders.join(lines, F.col("key") == F.col("l_orderkey"), "left").select("ts", "key", *MEASURES)


SENSORS = """sensors AS (
    SELECT o_orderdate AS ts, o_orderkey AS key, amount, quantity, discount, tax, lines
    FROM orders LEFT JOIN (
        SELECT l_orderkey, round(sum(l_extendedprice), 2) AS amount, sum(l_quantity) AS quantity,
               round(avg(l_discount), 6) AS discount, round(avg(l_tax) - 0.01, 6) AS tax,
               CAST(count(*) AS DOUBLE) AS lines
        FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""

KNOWN = """known AS (SELECT * FROM sensors WHERE amount IS NOT NULL)"""


def known_sensors(spark, sf) -> DataFrame:
    return sensors(spark, sf).where(F.col("amount").isNotNull())


# Overlapping periods within the month the events cover, and seasons for the orders.
EVENT_PERIODS = [Period("early", "01-01", "01-15"), Period("late", "01-10", "01-31")]
ORDER_PERIODS = [Period("Januar–März", "01-01", "03-31"), Period("März–Mitte Mai", "03-01", "05-15"),
                 Period("Mai–Oktober", "05-15", "10-31")]

ASSIGNED = """assigned AS (
    SELECT 'early' AS period, * FROM clean WHERE strftime(ts, '%m-%d') BETWEEN '01-01' AND '01-15'
    UNION ALL
    SELECT 'late' AS period, * FROM clean WHERE strftime(ts, '%m-%d') BETWEEN '01-10' AND '01-31')"""

SPLIT = """placed AS (
    SELECT *, row_number() OVER (PARTITION BY period ORDER BY ts, event_id) - 1 AS pos,
           count(*) OVER (PARTITION BY period) AS n FROM assigned),
    split AS (
    SELECT *, CASE WHEN pos < floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM placed)"""
