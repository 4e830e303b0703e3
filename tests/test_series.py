import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.operators import correlate as cr
from tidewright.operators.augment import add_noise
from tidewright.operators.features import SlidingMedian, add_features, add_split_features, add_time_features
from tidewright.operators.index import over_chunks, with_position
from tidewright.operators.metrics import regression_metrics
from tidewright.operators.periods import (
    assign_periods, filter_dates, filter_season, large_enough, pick_periods)
from tidewright.operators.resample import resample_mean, rule_micros
from tidewright.operators.scale import minmax_scaler, robust_scaler, standard_scaler
from tidewright.operators.split import cv_folds, fold_bounds, temporal_split
from tidewright.spec import FeaturePlan, Period


def series(spark, n, key=False):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(n), "v": rng.normal(0, 1, n).round(3),
                        "k": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n))})
    pdf["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(pdf["id"] // 2 * 7, unit="min")
    return spark.createDataFrame(pdf.sample(frac=1, random_state=1)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


LOW = {"max_group_rows": 20, "range_rows": 70}


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_positions_by_ranges_equal_row_numbers(spark, keys):
    df = series(spark, 1000)
    plain = with_position(df, ["ts", "id"], keys).select("id", "pos", "n_rows").toPandas().sort_values("id")
    ranged = with_position(df, ["ts", "id"], keys, **LOW).select("id", "pos", "n_rows").toPandas().sort_values("id")
    assert (plain.to_numpy() == ranged.to_numpy()).all()


@pytest.mark.parametrize("keys,chunk", [([], 50), (["k"], 24), (["k"], 1)])
def test_chunked_features_equal_pandas(spark, keys, chunk):
    df = series(spark, 600)
    plan = FeaturePlan(lags={"v": [1, 24]}, windows={"v": [3, 25]}, statistics=("mean", "std", "min", "max", "median"),
                       hour=False, day_of_year=False)
    got = add_features(df, plan, ["ts", "id"], keys, chunk_rows=chunk, **LOW).toPandas().sort_values("id")
    pdf = df.toPandas().sort_values("id")
    groups = pdf.groupby("k") if keys else None
    col = groups["v"] if keys else pdf["v"]
    roll = lambda w: col.rolling(w, min_periods=1)
    want = {"v_lag24": col.shift(24), "v_lag1": col.shift(1)}
    for w in (3, 25):
        want |= {f"v_roll{w}": roll(w).mean(), f"v_std{w}": roll(w).std(), f"v_min{w}": roll(w).min(),
                 f"v_max{w}": roll(w).max(), f"v_med{w}": roll(w).median()}
    for name, values in want.items():
        if keys and values.index.nlevels > 1:
            values = values.droplevel(0).sort_index()
        values = values.loc[pdf.index] if not keys else values.reindex(pdf.index)
        np.testing.assert_allclose(got[name].to_numpy(dtype=float), values.to_numpy(dtype=float), atol=1e-9, err_msg=name)


def test_full_windows_need_all_values(spark, tiny):
    plan = FeaturePlan(windows={"v": [2]}, statistics=("mean",), hour=False, day_of_year=False)
    from tidewright.sources.readers import nan_to_null
    out = add_features(nan_to_null(tiny), plan, ["ts"], full=True).orderBy("ts")
    assert [r.v_roll2_mean for r in out.collect()] == [None, None, None, None, None, 0.5, 6.5, 7.5]


def test_windows_stay_within_the_split(spark):
    df = series(spark, 100)
    split = temporal_split(df, ["ts", "id"], 0.8)
    plan = FeaturePlan(lags={"v": [1]}, windows={"v": [5]})
    out = add_split_features(split, plan, "ts", chunk_rows=7)
    first = out.where("split = 'test' and split_pos = 0").first()
    assert first.v_lag1 is None and first.v_roll5 == first.v and first.v_std5 is None
    assert out.count() == 100 and set(plan.names(["v"])) <= set(out.columns)


def test_chunks_do_not_shuffle_again(spark):
    placed = with_position(series(spark, 100), ["ts", "id"], ["k"])
    out = over_chunks(placed, lambda w: [F.lag("v").over(w).alias("l")], "pos", ["k"], 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_split_and_folds(spark):
    for n, ratio in ((100, 0.29), (11, 0.8), (1, 0.8)):
        split = temporal_split(series(spark, n), ["ts", "id"], ratio)
        assert split.where("split = 'train'").count() == int(n * ratio)
    assert fold_bounds(11, 3) == [(5, 7), (7, 9), (9, 11)]
    placed = with_position(series(spark, 11), ["ts", "id"])
    got = {(r.fold, r.role): (r.a, r.b) for r in cv_folds(placed, 3).groupBy("fold", "role").agg(
        F.min("pos").alias("a"), F.max("pos").alias("b")).collect()}
    assert got == {(0, "train"): (0, 4), (0, "test"): (5, 6), (1, "train"): (0, 6), (1, "test"): (7, 8),
                   (2, "train"): (0, 8), (2, "test"): (9, 10)}
    with pytest.raises(ValueError):
        fold_bounds(3, 3)


def test_periods(spark):
    days = ["2016-02-28", "2016-02-29", "2016-12-31", "2016-03-01", "2017-05-15"]
    df = spark.createDataFrame([(d,) for d in days], "d string").selectExpr("cast(d as timestamp_ntz) as ts")
    winter = Period("Winter", "12-01", "02-28")
    assert filter_season(df, "ts", winter).count() == 2
    both = [Period("a", "01-01", "03-31"), Period("b", "03-01", "05-15")]
    assert sorted(r.period for r in assign_periods(df, "ts", both).collect()) == ["a", "a", "a", "b", "b"]
    assert [p.name for p in pick_periods(both, ["B"])] == ["b"]
    assert filter_dates(df, "ts", "2016-02-29", "2016-03-01").count() == 2
    assert large_enough(assign_periods(df, "ts", both), ["period"], 3).count() == 3
    feature = add_time_features(df.where("ts = '2016-12-31'"), "ts").first()
    assert feature.doy_sin == pytest.approx(np.sin(2 * np.pi * 366 / 365))


def test_resample_keeps_empty_bins(spark):
    rows = [("2016-01-01 00:00:00", 1.0), ("2016-01-01 00:20:00", 2.0), ("2016-01-01 01:40:00", 3.0)]
    df = spark.createDataFrame(rows, "t string, v double").selectExpr("cast(t as timestamp_ntz) as ts", "v")
    assert [r.v for r in resample_mean(df, "30T", "ts", ["v"]).orderBy("ts").collect()] == [1.5, None, None, 3.0]
    assert resample_mean(df, "30T", "ts", ["v"], dense=False).count() == 2
    odd = resample_mean(df, "50T", "ts", ["v"]).orderBy("ts").collect()
    assert [(r.ts, r.v) for r in odd] == [(dt.datetime(2016, 1, 1), 1.5), (dt.datetime(2016, 1, 1, 0, 50), None),
                                          (dt.datetime(2016, 1, 1, 1, 40), 3.0)]
    assert rule_micros("H") == 3_600_000_000
    with pytest.raises(ValueError):
        rule_micros("3Q")


@pytest.mark.parametrize("chunk", [10_000, 40])
def test_best_lag_of_a_shifted_pair(spark, chunk):
    rng = np.random.default_rng(4)
    a = rng.normal(0, 1, 500)
    pdf = pd.DataFrame({"i": np.arange(500), "a": a, "b": np.r_[a[7:], rng.normal(0, 1, 7)]})
    df = spark.createDataFrame(pdf)
    got = cr.cross_correlation(df, "a", "b", ["i"], 15, 3, chunk_rows=chunk, **LOW)
    assert cr.best_lag(got).first().lag == 7
    table = got.toPandas().set_index("lag")["corr"]
    for lag in (-12, -3, 0, 5, 12):
        assert table[lag] == pytest.approx(pdf.b.shift(lag).corr(pdf.a), abs=1e-9)
    auto = cr.autocorrelation(df, "a", ["i"], 20, chunk_rows=chunk, **LOW).toPandas().set_index("lag")["autocorr"]
    c = a - a.mean()
    assert auto[3] == pytest.approx((c[:-3] * c[3:]).sum() / (c * c).sum())
    assert cr.cross_correlation(df.withColumn("k", F.lit(1.0)), "a", "k", ["i"]).count() == 0


def test_scalers_and_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (6.0, 5.0)], "a double, k double")
    got = standard_scaler(df, ["a", "k"]).transform(df).toPandas()
    np.testing.assert_allclose(got["a"], (np.array([1, 2, 6]) - 3) / np.std([1, 2, 6]))
    assert (got["k"] == 0).all()
    assert sorted(r.a for r in minmax_scaler(df, ["a"]).transform(df).collect()) == pytest.approx([0, 0.2, 1])
    assert sorted(r.a for r in robust_scaler(df, ["a"]).transform(df).collect()) == pytest.approx([-0.4, 0, 1.6])


def test_noise_is_repeatable_and_scaled(spark):
    df = spark.range(4000).selectExpr("id", "cast(id % 50 as double) as a", "id as y")
    one = add_noise(df, ["a"], ["id"], 2, 0.1).orderBy("id", "copy").toPandas()
    two = add_noise(df.repartition(7), ["a"], ["id"], 2, 0.1).orderBy("id", "copy").toPandas()
    assert len(one) == 12_000
    # The standard deviation may differ in its last digits, as sums are formed in another order.
    np.testing.assert_allclose(one["a"], two["a"], rtol=1e-12, atol=1e-12)
    noise = one["a"] - one["id"] % 50
    assert (noise[one["copy"] == 0] == 0).all() and (one["y"] == one["id"]).all()
    assert noise[one["copy"] > 0].std() == pytest.approx(0.1 * np.std(np.arange(50)), rel=0.05)
    assert add_noise(df, ["a"], ["id"], 0, 0.1).count() == 4000
    assert add_noise(df, ["a"], ["id"], 3, 0.0).count() == 4000


def test_metrics_of_a_constant_target(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0)],
                               "g string, label double, prediction double")
    got = {r.g: r for r in regression_metrics(df, by=["g"]).collect()}
    assert got["a"].r2 == 1 and got["b"].r2 == 0 and got["b"].mae == 0.5


@pytest.mark.parametrize("width", [1, 2, 5, 64])
def test_sliding_median(width):
    rng = np.random.default_rng(width)
    values = [None if rng.uniform() < 0.2 else float(rng.integers(0, 9)) for _ in range(400)]
    values[100:180] = [None] * 80
    median = SlidingMedian(width)
    for i, value in enumerate(values):
        known = [v for v in values[max(0, i - width + 1):i + 1] if v is not None]
        assert median.push(value) == (pytest.approx(np.median(known)) if known else None)


def test_medians_by_chunk_and_scope(spark):
    rng = np.random.default_rng(2)
    rows = [(k, i, None if rng.uniform() < 0.1 else float(rng.normal())) for k in ("a", None) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    plan = FeaturePlan(windows={"v": [4, 7]}, statistics=("mean", "median"), hour=False, day_of_year=False)
    for full in (False, True):
        got = {(r.k, r.i): r for r in add_features(df, plan, ["i"], ["k"], full=full, chunk_rows=11).collect()}
        for k, i, _ in rows:
            for w in (4, 7):
                known = [v for kk, j, v in rows if kk == k and i - w < j <= i and v is not None]
                want = np.median(known) if known and (not full or len(known) >= w) else None
                found = got[k, i][f"v_roll{w}_median" if full else f"v_med{w}"]
                assert found == (None if want is None else pytest.approx(want))


@pytest.mark.parametrize("gap", [1_000_000, 37])
def test_gaps_of_any_length(spark, gap):
    """Two bins far apart, for one key of several, one of which is missing."""
    rows = [("a", 0, 1.0), ("a", gap * 900, 3.0), (None, 1800, 5.0), (None, 4 * 900, 7.0), ("b", 50, 2.0)]
    df = spark.createDataFrame(rows, "k string, s long, v double").selectExpr("k", "cast(timestamp_seconds(s + 86400 * 40) as timestamp_ntz) as ts", "v")
    out = resample_mean(df, "15T", "ts", ["v"], keys=["k"])
    sizes = {r.k: (r.n, r.known, r.total) for r in out.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("known"), F.sum("v").alias("total")).collect()}
    assert sizes == {"a": (gap + 1, 2, 4.0), None: (3, 2, 12.0), "b": (1, 1, 2.0)}
    steps = out.where("k = 'a'").agg(F.countDistinct("ts").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    assert steps.n == gap + 1 and (steps.hi - steps.lo).total_seconds() == gap * 900


@pytest.mark.parametrize("chunk", [7, 60, 1000])
def test_lagged_sums_by_definition(spark, chunk):
    rng = np.random.default_rng(1)
    x, y = rng.normal(0, 1, 200), rng.normal(0, 1, 200)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "_pos long, a double, b double")
    got = {r.lag: r for r in cr._lagged_sums(df, "a", "b", range(-60, 61), chunk).collect()}
    assert len(got) == 121
    for lag, r in got.items():
        u, v = (x[lag:], y[:200 - lag]) if lag >= 0 else (x[:200 + lag], y[-lag:])
        want = [len(u), u.sum(), v.sum(), (u * u).sum(), (v * v).sum(), (u * v).sum()]
        assert [r.n, r.sx, r.sy, r.sxx, r.syy, r.sxy] == pytest.approx(want, abs=1e-9)
