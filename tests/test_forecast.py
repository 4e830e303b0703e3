"""Sparse trends by the conditions of optimality, intervals against independent simulation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewright.models import forecast as fc


def bent(spark, days=120, seed=1, noise=0.4, mode="additive"):
    """A trend that turns at days 30 and 70, with a daily wave."""
    rng = np.random.default_rng(seed)
    hours = np.arange(days * 6) * 4
    t = hours / 24
    trend = 20 + 0.1 * t + 0.5 * np.maximum(t - 30, 0) - 0.8 * np.maximum(t - 70, 0)
    wave = np.sin(2 * np.pi * t)
    y = (trend + 2 * wave if mode == "additive" else trend * (1 + 0.1 * wave)) + noise * rng.normal(0, 1, len(t))
    pdf = pd.DataFrame({"ds": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, unit="h"), "y": y})
    return spark.createDataFrame(pdf).withColumn("ds", F.col("ds").cast("timestamp_ntz"))


@pytest.mark.parametrize("seed", range(6))
def test_sparse_weights_are_optimal(seed):
    rng = np.random.default_rng(seed)
    n, p = 300, 12
    t = np.sort(rng.uniform(0, 1, n))
    x = np.maximum(t[:, None] - np.linspace(0, 0.8, p), 0) if seed % 2 else rng.normal(0, 1, (n, p))
    y = x @ np.where(rng.uniform(0, 1, p) < 0.3, rng.normal(0, 3, p), 0) + 0.1 * rng.normal(0, 1, n)
    penalty = rng.uniform(0.5, 4, p) * (0.05 if seed % 2 else 5)
    w = fc.sparse_weights(x.T @ x, x.T @ y, penalty)
    slope = x.T @ (y - x @ w)
    assert (w == 0).any() and (w != 0).any()
    np.testing.assert_allclose(slope[w != 0], penalty[w != 0] * np.sign(w[w != 0]), rtol=1e-6)
    assert (np.abs(slope[w == 0]) <= penalty[w == 0] * (1 + 1e-6)).all()
    cost = lambda v: 0.5 * ((y - x @ v) ** 2).sum() + (penalty * np.abs(v)).sum()
    assert all(cost(w) <= cost(w + 1e-3 * rng.normal(0, 1, p)) for _ in range(50))


def test_without_penalty_weights_are_least_squares():
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, (50, 4)), rng.normal(0, 1, 50)
    np.testing.assert_allclose(fc.sparse_weights(x.T @ x, x.T @ y, np.zeros(4)), np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-8)


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_trend_changes_where_it_was_bent(spark, mode):
    df = bent(spark, mode=mode, noise=0.1)
    model = fc.fit_forecast(df, "ds", "y", fc.ForecastConfig(0.05, daily=True, weekly=False, seasonality_mode=mode))
    jumps = np.array([v for n, v in model.trend_weights.items() if n.startswith("hinge")])
    assert (jumps == 0).sum() >= 8
    # Rates before, between and behind the turns, per day.
    rate = lambda at: (model.trend_weights["slope"] + sum(
        j for j, c in zip(jumps, model.changes, strict=True) if c < at)) * model.scale / model.span
    assert [rate(15 / 120), rate(50 / 120), rate(110 / 120)] == pytest.approx([0.1, 0.6, -0.2], abs=0.06)
    assert model.noise * model.scale == pytest.approx(0.1, rel=0.25)


def test_a_narrow_prior_leaves_no_change(spark):
    model = fc.fit_forecast(bent(spark), "ds", "y", fc.ForecastConfig(1e-6, daily=True))
    assert all(v == 0 for n, v in model.trend_weights.items() if n.startswith("hinge"))


def test_fit_is_the_most_likely_one(spark):
    """No small change of weights or noise makes the rows likelier, priors included."""
    df = bent(spark)
    config = fc.ForecastConfig(0.05, 10.0, daily=True, weekly=False)
    model = fc.fit_forecast(df, "ds", "y", config)
    trend, season = model.trend_columns(), {n: c for cols in model.season_columns().values() for n, c in cols.items()}
    rows = np.array(df.select(*trend.values(), *season.values(), F.col("y") / model.scale).toDF(
        *[f"c{i}" for i in range(len(trend) + len(season) + 1)]).toPandas())
    x, y = rows[:, :-1], rows[:, -1]
    w = np.array([*model.trend_weights.values(), *model.season_weights.values()])
    hinge = np.array([n.startswith("hinge") for n in [*trend, *season]])
    prior = np.array([fc.TREND_SCALE if n in ("offset", "slope") else 0.05 if h else 10.0 for n, h in zip([*trend, *season], hinge, strict=True)])

    def cost(w, noise):
        own = np.where(hinge, np.abs(w) / prior, w ** 2 / (2 * prior ** 2)).sum()
        return len(y) * np.log(noise) + ((y - x @ w) ** 2).sum() / (2 * noise ** 2) + own + noise ** 2 / (2 * fc.NOISE_SCALE ** 2)

    best, rng = cost(w, model.noise), np.random.default_rng(0)
    for _ in range(100):
        assert cost(w + 1e-4 * rng.normal(0, 1, len(w)), model.noise) >= best - 1e-9
        assert cost(w, model.noise * (1 + 1e-3 * rng.normal())) >= best - 1e-9


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_interval_as_simulated(spark, mode):
    """Against a simulation with other random numbers."""
    df = bent(spark, mode=mode)
    model = fc.fit_forecast(df.where("ds < '2024-03-31'"), "ds", "y", fc.ForecastConfig(0.5, daily=True, seasonality_mode=mode))
    out = model.transform(df).orderBy("ds").toPandas()
    parts = model.components(df).orderBy("ds").toPandas()
    level = model.scale * (1 + parts[list(model.seasons)].sum(axis=1) if mode == "multiplicative" else 1)
    t = df.select(model.trend_columns()["slope"].alias("t"), "ds").orderBy("ds").toPandas()["t"].to_numpy()
    width = (out.yhat_upper - out.yhat_lower).to_numpy()
    past = t <= 1
    np.testing.assert_allclose(width[past], 2 * 1.2816 * model.noise * model.scale, rtol=0.01)
    rng, jumps = np.random.default_rng(8), [abs(v) for n, v in model.trend_weights.items() if n.startswith("hinge")]
    assert sum(jumps) > 0
    for row in np.flatnonzero(~past)[[20, 80, -1]]:
        ahead = t[row] - 1
        off = [(np.maximum(ahead - rng.uniform(0, ahead, k), 0) * rng.laplace(0, np.mean(jumps), k)).sum()
               for k in rng.poisson(len(jumps) * ahead, 40_000)]
        ends = np.quantile(np.array(off) * (level.iloc[row] if mode == "multiplicative" else level) + rng.normal(0, model.noise * model.scale, 40_000), [0.1, 0.9])
        assert width[row] == pytest.approx(ends[1] - ends[0], rel=0.12)
    assert width[-1] > 1.3 * width[0] and (out.yhat_lower <= out.yhat).all() and (out.yhat <= out.yhat_upper).all()


def test_interval_covers_four_fifths(spark):
    df = bent(spark)
    model = fc.fit_forecast(df, "ds", "y", fc.ForecastConfig(0.05, daily=True))
    inside = model.transform(df).agg(F.avg(F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")).cast("int"))).first()[0]
    assert 0.76 < inside < 0.84


def test_paths_do_not_depend_on_the_rows_beside_them(spark):
    df = bent(spark)
    model = fc.fit_forecast(df.where("ds < '2024-03-31'"), "ds", "y", fc.ForecastConfig(0.5, daily=True))
    whole = {r.ds: (r.yhat_lower, r.yhat_upper) for r in model.transform(df.repartition(3)).collect()}
    few = model.transform(df.where("day(ds) = 7").coalesce(1)).collect()
    assert len(few) > 20 and all(whole[r.ds] == pytest.approx((r.yhat_lower, r.yhat_upper)) for r in few)
