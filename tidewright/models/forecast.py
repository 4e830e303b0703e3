"""Forecasts from a piecewise-linear trend and Fourier seasons (Taylor and Letham 2018).

The design matrix is a set of column expressions. The fit is the most likely one: Gaussian priors on offset, slope,
seasons and regressors, a Laplace prior on the changes of the trend's rate, which keeps most of them at zero, and a
half-normal prior on the noise. All of it is found from the sums of products, one pass over the rows. Intervals come from
paths of the trend with changes to come, as often and as large as those found, and noise around them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.draws import laplace, uniform
from tidewright.functions.scalar import DAY_MICROS, micros
from tidewright.operators.metrics import regression_metrics, wide_metrics
from tidewright.operators.periods import filter_dates
from tidewright.operators.quantiles import quantiles
from tidewright.operators.split import temporal_split
from tidewright.spec import DateRange

# Length in days and number of waves of each season, and the days of data 'auto' asks for.
SEASONS = {"yearly": (365.25, 10, 730), "weekly": (7.0, 3, 14), "daily": (1.0, 4, 2)}
CHANGEPOINTS = 25
# Prior widths of offset and slope, and of extra regressors.
TREND_SCALE, REGRESSOR_SCALE = 5.0, 10.0


# Prior width of the noise, and number of paths behind an interval.
NOISE_SCALE, PATHS = 0.5, 1000


@dataclass(frozen=True)
class ForecastConfig:
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    seasonality_mode: str = "additive"
    yearly: bool | str = "auto"
    weekly: bool | str = "auto"
    daily: bool | str = "auto"
    changepoint_range: float = 0.8
    interval_width: float = 0.8
    regressors: tuple[str, ...] = ()
    seed: int = 42

    def __post_init__(self):
        if self.seasonality_mode not in ("additive", "multiplicative"):
            raise ValueError(f"unknown seasonality mode {self.seasonality_mode!r}")


def days_since_epoch(time: str) -> Column:
    return micros(time) / F.lit(float(DAY_MICROS))


def fourier_columns(time: str, name: str, waves: int | None = None) -> dict[str, Column]:
    """Sine and cosine waves of a season, by name."""
    period, default, _ = SEASONS[name]
    out = {}
    for k in range(1, (waves or default) + 1):
        angle = F.lit(2.0 * k) * F.pi() * days_since_epoch(time) / F.lit(period)
        out[f"{name}_sin{k}"] = F.sin(angle)
        out[f"{name}_cos{k}"] = F.cos(angle)
    return out


def changepoint_days(df: DataFrame, time: str, share: float = 0.8, count: int = CHANGEPOINTS,
                     at_most: int | None = None) -> list[float]:
    """Times, in days, that cut the first share of the rows into equally full pieces."""
    days = df.select(days_since_epoch(time).alias("d"))
    return quantiles(days, ["d"], [share * j / count for j in range(1, count + 1)],
                     at_most=at_most)["d"]


def hinge_columns(t: Column, changes: Sequence[float]) -> dict[str, Column]:
    return {f"hinge{j}": F.greatest(t - F.lit(float(s)), F.lit(0.0)) for j, s in enumerate(changes)}


def active_seasons(config: ForecastConfig, span_days: float) -> list[str]:
    """Seasons switched on, or left to the data and covered by it at least twice."""
    wanted = {"yearly": config.yearly, "weekly": config.weekly, "daily": config.daily}
    return [n for n, w in wanted.items() if w is True or (w == "auto" and span_days >= SEASONS[n][2])]


def _dot(columns: dict[str, Column], weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [columns[c] * F.lit(weights[c]) for c in columns], F.lit(0.0))


@dataclass(frozen=True)
class ForecastModel:
    time: str
    config: ForecastConfig
    start: float
    span: float
    scale: float
    changes: tuple[float, ...]
    seasons: tuple[str, ...]
    regressor_stats: dict[str, tuple[float, float]]
    trend_weights: dict[str, float] = field(default_factory=dict)
    season_weights: dict[str, float] = field(default_factory=dict)
    #: Standard deviation of the noise, as a part of ``scale``.
    noise: float = 0.0

    def trend_columns(self) -> dict[str, Column]:
        t = (days_since_epoch(self.time) - F.lit(self.start)) / F.lit(self.span)
        return {"offset": F.lit(1.0), "slope": t, **hinge_columns(t, self.changes)}

    def season_columns(self) -> dict[str, dict[str, Column]]:
        out = {n: fourier_columns(self.time, n) for n in self.seasons}
        if self.regressor_stats:
            out["regressors"] = {c: (F.col(c) - F.lit(m)) / F.lit(s)
                                 for c, (m, s) in self.regressor_stats.items()}
        return out

    def components(self, df: DataFrame) -> DataFrame:
        """Trend, each season and the forecast; multiplicative seasons are shares of the trend."""
        trend = _dot(self.trend_columns(), self.trend_weights) * F.lit(self.scale)
        parts = {n: _dot(cols, {c: self.season_weights[c] for c in cols})
                 for n, cols in self.season_columns().items()}
        total = reduce(lambda a, b: a + b, parts.values(), F.lit(0.0))
        if self.config.seasonality_mode == "multiplicative":
            yhat = trend * (1 + total)
        else:
            parts = {n: p * F.lit(self.scale) for n, p in parts.items()}
            yhat = trend + total * F.lit(self.scale)
        return df.withColumns({"trend": trend, **parts, "yhat": yhat})

    def transform(self, df: DataFrame) -> DataFrame:
        """Add yhat and the interval around it.

        Its ends are quantiles over ``PATHS`` paths. Up to the last train row a path differs from the
        forecast by noise alone, behind it by the changes of its rate as well. A path's changes and noise follow from its
        number, so every row, wherever it is, sees the same paths.
        """
        t = self.trend_columns()["slope"]
        out = self.components(df)
        seasons = reduce(lambda a, b: a + b, [F.col(f"`{n}`") for n in self.season_columns()], F.lit(0.0))
        level = F.lit(self.scale) * ((1 + seasons) if self.config.seasonality_mode == "multiplicative" else 1)
        ends = F.arrow_udf(self._spread(), "array<double>")(F.greatest(t - 1, F.lit(0.0)), level.cast("double"))
        out = out.withColumn("_ends", ends).drop("trend", *self.season_columns())
        lower, upper = (F.col("yhat") + F.col("_ends")[i] for i in (0, 1))
        return out.withColumns({"yhat_lower": lower, "yhat_upper": upper}).drop("_ends")

    def _spread(self):
        """For times behind the train rows, in train spans, and the level of the trend's unit: what quantiles of the paths differ by."""
        jumps = [abs(v) for n, v in self.trend_weights.items() if n not in ("offset", "slope")]
        size, rate = (sum(jumps) / len(jumps), len(jumps)) if jumps else (0.0, 0)
        tail, seed, width = (1 - self.config.interval_width) / 2, self.config.seed, self.noise * self.scale
        number = np.arange(PATHS)
        # Noise in equally likely steps, dealt to the paths at random.
        order = np.argsort(uniform(number, seed, -1), kind="stable")
        noise = np.empty(PATHS)
        noise[order] = [width * NormalDist().inv_cdf((k + 0.5) / PATHS) for k in range(PATHS)]
        still = np.quantile(noise, [tail, 1 - tail])

        def spread(ahead: pa.Array, level: pa.Array) -> pa.Array:
            far, unit = ahead.to_numpy(zero_copy_only=False), level.to_numpy(zero_copy_only=False)
            out = np.tile(still, (len(far), 1))
            later = np.flatnonzero(far > 0) if size else np.zeros(0, int)
            for a in range(0, len(later), 256):
                rows = later[a:a + 256]
                off, place, change = np.zeros((len(rows), PATHS)), np.zeros(PATHS), 0
                while True:  # change by change, until every path is past the last time
                    place = place - np.log1p(-uniform(number, seed, 2 * change)) / rate
                    seen = np.flatnonzero(place < far[rows].max())
                    if not len(seen):
                        break
                    step = laplace(uniform(seen, seed, 2 * change + 1), size)
                    off[:, seen] += np.maximum(far[rows][:, None] - place[seen], 0.0) * step
                    change += 1
                out[rows] = np.quantile(off * unit[rows][:, None] + noise, [tail, 1 - tail], axis=1).T
            return pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * 2), pa.array(out.ravel()))

        spread.__annotations__ = {"ahead": pa.Array, "level": pa.Array, "return": pa.Array}
        return spread


def _gram(design: DataFrame, combine) -> np.ndarray:
    """Sum over all rows of a'a, where ``combine`` turns a block of the design into rows a.

    Each task adds up one small matrix with NumPy; the matrices are added up on Spark.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for batch in batches:
            a = combine(batch.to_numpy(dtype=float))
            total = total + a.T @ a
        if not np.isscalar(total):
            yield pd.DataFrame({"place": np.arange(total.size), "part": total.ravel()})

    rows = design.mapInPandas(work, "place long, part double").groupBy("place").agg(F.sum("part").alias("s")).collect()
    flat = np.empty(len(rows))
    for r in rows:
        flat[r["place"]] = r["s"]
    return flat.reshape(math.isqrt(len(rows)), -1)


def sparse_weights(products: np.ndarray, target: np.ndarray, penalty: np.ndarray, sweeps: int = 20_000) -> np.ndarray:
    """Weights w that make w'Pw / 2 - w't + sum(penalty * |w|) least, weight by weight; those near the end are solved for at once."""
    weights, rest, diagonal = np.zeros(len(target)), target.astype(float).copy(), np.maximum(np.diag(products), 1e-300)
    for sweep in range(sweeps):
        largest = 0.0
        for j in range(len(target)):
            pull = rest[j] + diagonal[j] * weights[j]
            new = math.copysign(max(abs(pull) - penalty[j], 0.0), pull) / diagonal[j]
            if new != weights[j]:
                step = new - weights[j]
                rest -= products[:, j] * step
                largest = max(largest, abs(step) * math.sqrt(diagonal[j]))
                weights[j] = new
        if sweep % 50 == 49 or not largest:
            solved = _on_support(products, target, penalty, weights)
            if solved is not None:
                return solved
        if not largest:
            break
    return weights


def _on_support(products, target, penalty, weights) -> np.ndarray | None:
    """The solution with the signs of the given weights, if it is the best of all."""
    some, signs = np.flatnonzero(weights), np.sign(weights)
    out = np.zeros(len(weights))
    if len(some):
        out[some] = np.linalg.lstsq(products[np.ix_(some, some)], target[some] - penalty[some] * signs[some], rcond=1e-14)[0]
    slope = target - products @ out
    optimal = (np.sign(out[some]) == signs[some]).all() and (np.abs(slope) <= penalty * (1 + 1e-7)).all()
    return out if optimal else None


def _solve(gram: np.ndarray, prior: np.ndarray, sparse: np.ndarray, noise: float) -> tuple[np.ndarray, float]:
    """Weights from the sums of products, the target in the last place, and the squared error left.

    ``sparse`` marks weights with a Laplace prior. The others are their least squares given those, so they drop out of the search.
    """
    xx, xy, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    s, r = np.flatnonzero(sparse), np.flatnonzero(~sparse)
    weights = np.zeros(len(prior))
    own = xx[np.ix_(r, r)] + np.diag(noise * noise / prior[r] ** 2)
    across, alone = np.linalg.solve(own, xx[np.ix_(r, s)]), np.linalg.solve(own, xy[r])
    if len(s):
        weights[s] = sparse_weights(xx[np.ix_(s, s)] - xx[np.ix_(s, r)] @ across, xy[s] - xx[np.ix_(s, r)] @ alone, noise * noise / prior[s])
    weights[r] = alone - across @ weights[s]
    return weights, float(yy - 2 * weights @ xy + weights @ xx @ weights)


def _most_likely(gram: np.ndarray, prior: np.ndarray, sparse: np.ndarray, rows: int, noise: float) -> tuple[np.ndarray, float]:
    """Weights and noise, by turns until the noise stands still."""
    for _ in range(100):
        weights, sse = _solve(gram, prior, sparse, noise)
        # The noise at which rows / noise = sse / noise^3 - noise / NOISE_SCALE^2.
        square = NOISE_SCALE ** 2
        found = math.sqrt(max((math.sqrt(rows ** 2 + 4 * max(sse, 0.0) / square) - rows) * square / 2, 0.0)) or 1e-6
        if abs(found - noise) <= 1e-10 * noise:
            break
        noise = found
    return weights, noise


def _fit_weights(design: DataFrame, rows: int, prior_t: np.ndarray, prior_s: np.ndarray, sparse: np.ndarray, mode: str, rounds: int):
    """(trend weights, season weights, noise). The design holds trend columns, season columns and the target.

    Sums are one pass over the rows; additive models need one, multiplicative ones two per round.
    """
    k, noise = len(prior_t), 0.25
    if mode == "additive" or not len(prior_s):
        both = np.concatenate([sparse, np.zeros(len(prior_s), bool)])
        weights, noise = _most_likely(_gram(design, lambda a: a), np.concatenate([prior_t, prior_s]), both, rows, noise)
        return weights[:k], weights[k:], noise
    shares = np.zeros(len(prior_s))
    for _ in range(rounds):
        gram = _gram(design, lambda a: np.column_stack([a[:, :k] * (1 + a[:, k:-1] @ shares)[:, None], a[:, -1]]))
        level, noise = _most_likely(gram, prior_t, sparse, rows, noise)

        def seasonal(a):
            g = a[:, :k] @ level
            return np.column_stack([a[:, k:-1] * g[:, None], a[:, -1] - g])

        shares, noise = _most_likely(_gram(design, seasonal), prior_s, np.zeros(len(prior_s), bool), rows, noise)
    return level, shares, noise


def fit_forecast(train: DataFrame, time: str, target: str, config: ForecastConfig = ForecastConfig(),
                 rounds: int = 3) -> ForecastModel:
    """Fit trend and seasons; multiplicative seasons by turns: trend given seasons, seasons given trend."""
    known = train.select(time, F.col(target).cast("double").alias("_y"), *config.regressors).na.drop("any")
    stats = known.agg(
        F.min(days_since_epoch(time)).alias("lo"), F.max(days_since_epoch(time)).alias("hi"),
        F.max(F.abs("_y")).alias("top"), F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in config.regressors],
        *[F.stddev_samp(c).alias(f"s_{c}") for c in config.regressors]).first()
    if not stats["n"] or stats["n"] < 2:
        raise ValueError("too few rows to fit a forecast")
    start, span, scale = stats["lo"], (stats["hi"] - stats["lo"]) or 1.0, stats["top"] or 1.0
    count = min(CHANGEPOINTS, max(1, int(stats["n"] * config.changepoint_range) - 1))
    changes = changepoint_days(known, time, config.changepoint_range, count, stats["n"])
    model = ForecastModel(
        time, config, start, span, scale, tuple((c - start) / span for c in changes),
        tuple(active_seasons(config, span)),
        {c: (stats[f"m_{c}"], stats[f"s_{c}"] or 1.0) for c in config.regressors})
    trend = model.trend_columns()
    groups = model.season_columns()
    season = {n: c for cols in groups.values() for n, c in cols.items()}
    prior = {n: TREND_SCALE if n in ("offset", "slope") else config.changepoint_prior_scale for n in trend}
    prior |= {n: REGRESSOR_SCALE if n in model.regressor_stats else config.seasonality_prior_scale for n in season}
    once = config.seasonality_mode == "additive" or not season  # one pass over the rows then
    known = known if once else known.persist()
    try:
        design = known.select(*trend.values(), *season.values(), F.col("_y") / F.lit(scale))
        design = design.toDF(*[f"c{i}" for i in range(len(trend) + len(season) + 1)])
        level, shares, noise = _fit_weights(
            design, stats["n"], np.array([prior[n] for n in trend]), np.array([prior[n] for n in season]),
            np.array([n.startswith("hinge") for n in trend]), config.seasonality_mode, rounds)
    finally:
        if not once:
            known.unpersist()
    return replace(model, trend_weights=dict(zip(trend, map(float, level))),
                   season_weights=dict(zip(season, map(float, shares))), noise=noise)


def forecast_periods(df: DataFrame, time: str, target: str, order: Sequence[str],
                     ranges: Sequence[DateRange], configs: Sequence[ForecastConfig],
                     ratio: float = 0.8, min_rows: int = 10) -> DataFrame:
    """Fit and score each period with its own configuration; a period with too few rows has a status instead of metrics."""
    parts = []
    for period, config in zip(ranges, configs):
        rows = filter_dates(df, time, period.start, period.end)
        if rows.count() < min_rows:
            continue
        split = temporal_split(rows, order, ratio)
        model = fit_forecast(split.where(F.col("split") == "train"), time, target, config)
        scored = model.transform(split)
        metrics = regression_metrics(scored, target, "yhat", ["split"])
        parts.append(metrics.withColumn("period", F.lit(period.name)))
    spark = df.sparkSession
    metrics = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame(
        [], "split string, n long, r2 double, rmse double, mae double, period string")
    named = spark.createDataFrame([(p.name,) for p in ranges], "period string")
    status = F.when(F.coalesce("train_n", "test_n").isNull(), "too few rows").otherwise("ok")
    return named.join(wide_metrics(metrics, ["period"]), "period", "left").withColumn("status", status)
