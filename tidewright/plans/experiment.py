"""The whole run: periods, resampling, split, features, scaling, augmentation, tuning, scores."""

from __future__ import annotations

import logging
import time as clock
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.models.estimators import DEFAULT_GRIDS, make_estimator
from tidewright.models.tune import grid_points, grid_search
from tidewright.operators.augment import add_noise
from tidewright.operators.columns import assemble
from tidewright.operators.features import add_features, add_split_features, add_time_features
from tidewright.operators.index import with_position
from tidewright.operators.metrics import regression_metrics
from tidewright.operators.periods import assign_periods, large_enough, pick_periods
from tidewright.operators.resample import resample_mean
from tidewright.operators.reshape import union_results
from tidewright.operators.scale import SCALERS
from tidewright.operators.split import temporal_split
from tidewright.session import materialize, scratch
from tidewright.sources.writers import predictions_frame, save_model, write_predictions
from tidewright.spec import FeaturePlan, Period, SeriesSpec, lookup_override

log = logging.getLogger(__name__)

# Name of the only period when a series is not cut into seasons.
WHOLE = "all"

RESULT_SCHEMA = (
    "Period string, Model string, Train_R2 double, Test_R2 double, Train_RMSE double, Test_RMSE double, "
    "Train_MAE double, Test_MAE double, Best_Params string, Features_Count long, Train_Samples long, "
    "Test_Samples long, Training_Time_s double, Prediction_Time_s double, Augmentation string, Resampling string, Status string")
OK, TOO_FEW = "ok", "too few rows"


@dataclass(frozen=True)
class ExperimentConfig:
    """One model on one series. Plans and rules may differ by model and period.

    Without a grid the model's usual one is searched; a parameter that the model does not know
    is an error before any work.

    With ``features_first``, the interactive variant, the whole series is one period,
    features are made before the split and rolling windows must be full.
    """

    spec: SeriesSpec
    periods: Sequence[Period]
    model: str = "KNN"
    grid: dict[str, list] | None = None
    plan: FeaturePlan = FeaturePlan()
    plan_overrides: dict = field(default_factory=dict)
    only: Sequence[str] | None = None
    resampling: str | None = None
    resampling_overrides: dict = field(default_factory=dict)
    split_ratio: float = 0.8
    min_rows: int = 50
    min_test_rows: int = 10
    scaler: str = "standard"
    copies: int = 0
    noise: float = 0.0
    folds: int = 5
    scoring: str = "r2"
    seed: int = 42
    features_first: bool = False
    predictions_path: str | None = None
    models_path: str | None = None
    parallel: int = 4

    def __post_init__(self):
        if self.grid is None:
            object.__setattr__(self, "grid", DEFAULT_GRIDS.get(self.model, {}))
        for point in grid_points(self.grid):
            make_estimator(self.model, **point)

    def plan_for(self, period: str) -> FeaturePlan:
        return lookup_override(self.plan_overrides, self.model, period, self.plan)

    def rule_for(self, period: str) -> str | None:
        return lookup_override(self.resampling_overrides, self.model, period, self.resampling)


def _by_setting(periods, setting):
    """Periods that share a setting, so that each distinct setting costs one plan."""
    groups = []
    for p in periods:
        value = setting(p.name)
        for known, members in groups:
            if known == value:
                members.append(p)
                break
        else:
            groups.append((value, [p]))
    return groups


def prepare(df: DataFrame, config: ExperimentConfig) -> DataFrame:
    """Split feature rows of all periods in one table, complete rows only.

    ``split_pos`` tells the order within a period and split; it has gaps where rows were incomplete.
    """
    spec = config.spec
    measures = [*spec.features, spec.target]
    periods = pick_periods(config.periods, config.only)
    wanted = df.select(*spec.order, *measures)
    parts = []
    for rule, members in _by_setting(periods, config.rule_for):
        rows = assign_periods(wanted, spec.time, members)
        if rule:
            rows = resample_mean(rows, rule, spec.time, measures, ["period"])
        parts.append(rows)
    # Written, as sizes and positions each read them.
    rows = materialize(union_results(*parts), "assigned")
    order = [c for c in spec.order if c in rows.columns]
    rows = large_enough(rows, ["period"], config.min_rows)
    split = temporal_split(rows, order, config.split_ratio, ["period"])
    test_rows = F.col("n_rows") - F.floor(F.col("n_rows") * F.lit(config.split_ratio))
    split = split.where(test_rows >= config.min_test_rows)
    parts = []
    for plan, members in _by_setting(periods, config.plan_for):
        part = split.where(F.col("period").isin([p.name for p in members]))
        part = add_split_features(part, plan, spec.time, ["period"])
        needed = [*measures, *plan.names(measures)]
        parts.append(part.na.drop(subset=needed))
    return union_results(*parts).drop("pos", "n_rows")


def prepare_whole(df: DataFrame, config: ExperimentConfig) -> DataFrame:
    """The same for the interactive variant: features, complete rows, then the split."""
    spec, plan = config.spec, config.plan
    measures = [*spec.features, spec.target]
    rows = add_time_features(df.select(*spec.order, *measures), spec.time, plan.hour, plan.day_of_year)
    rows = add_features(rows, plan, spec.order, full=True).na.drop("any")
    split = temporal_split(rows, spec.order, config.split_ratio).withColumn("period", F.lit(WHOLE))
    return split.drop("pos", "n_rows")


def run_experiment(df: DataFrame, config: ExperimentConfig) -> DataFrame:
    """Tune, fit and score the model for each period; one result row per period, with what became of it.

    The feature table is written once to the shared folder, partitioned by period and
    split, so each fit reads only its own rows; it and all other tables of the run are gone at the
    end. Periods run at the same time. The status of a period is ``ok``, ``too few rows``, or the error it
    ended with, which does not keep the others from their results.
    """
    spark = df.sparkSession
    whole = config.features_first
    names = [WHOLE] if whole else [p.name for p in pick_periods(config.periods, config.only)]
    with scratch(spark):
        rows = prepare_whole(df, config) if whole else prepare(df, config)
        table = materialize(rows, "experiment", ("period", "split"))
        present = {r["period"] for r in table.select("period").distinct().collect()}

        def run(name: str):
            if name not in present:
                return _unfinished(name, config, TOO_FEW)
            try:
                return (*_run_period(table.where(F.col("period") == name), name, config), OK)
            except Exception as error:
                log.exception("period %s failed", name)
                return _unfinished(name, config, f"{type(error).__name__}: {error}".splitlines()[0])

        with ThreadPoolExecutor(config.parallel) as pool:
            results = list(pool.map(run, names))
    return spark.createDataFrame(results, RESULT_SCHEMA)


def _unfinished(period: str, config: ExperimentConfig, status: str) -> tuple:
    return (period, config.model, *[None] * 12, f"{config.copies}x{config.noise}", config.rule_for(period) or "None", status)


def _run_period(rows: DataFrame, period: str, config: ExperimentConfig):
    spec, plan = config.spec, config.plan_for(period)
    features = [*spec.features, *plan.names([*spec.features, spec.target], config.features_first)]
    scaler = SCALERS[config.scaler](rows.where(F.col("split") == "train"), features)
    scaled = scaler.transform(rows)
    # Folds are cut by position, so the complete train rows are numbered without gaps.
    train = with_position(scaled.where(F.col("split") == "train"), ["split_pos"], pos="row_id")
    began = clock.monotonic()

    def augmented(frame):
        return add_noise(frame, features, ["row_id"], config.copies, config.noise, config.seed)

    if config.copies and config.noise:
        found = grid_search(assemble(train, features, spec.target, keep=["row_id", *features]), config.model,
                            config.grid, config.folds, config.scoring,
                            augment=lambda df: _noisy(df, features, config.copies, augmented))
    else:
        found = grid_search(assemble(train, features, spec.target, keep=["row_id"]), config.model,
                            config.grid, config.folds, config.scoring)
    fitted = clock.monotonic()
    # Positions start anew in each split; models that join on row_id need one number for both.
    both = assemble(scaled, features, spec.target, keep=["split", "split_pos", spec.time]).withColumn(
        "row_id", F.col("split_pos") * 2 + (F.col("split") == "test").cast("long"))
    scored = found.model.transform(both).persist()
    try:
        metrics = {r["split"]: r for r in regression_metrics(scored, by=["split"]).collect()}
        predicted = clock.monotonic()
        if config.predictions_path:
            test = scored.where(F.col("split") == "test")
            write_predictions(predictions_frame(test, spec.time, "label", "prediction", config.model, period),
                              config.predictions_path)
    finally:
        scored.unpersist()
    if config.models_path:
        save_model(found.model, config.models_path, config.model, period)
    tr, te = metrics["train"], metrics["test"]
    multiple = 1 + (config.copies if config.noise else 0)
    return (period, config.model, tr["r2"], te["r2"], tr["rmse"], te["rmse"], tr["mae"], te["mae"],
            str(found.best), len(features), tr["n"] * multiple, te["n"], round(fitted - began, 2),
            round(predicted - fitted, 4), f"{config.copies}x{config.noise}", config.rule_for(period) or "None")


def _noisy(frame: DataFrame, features: Sequence[str], copies: int, augmented) -> DataFrame:
    """Noisy copies of an assembled frame that still carries its feature columns."""
    noisy = augmented(frame.drop("features"))
    # Copies are rows of their own, so they get ids of their own.
    distinct = noisy.withColumn("row_id", F.col("row_id") * F.lit(copies + 1) + F.col("copy"))
    # Written, as a fit reads its rows several times and the noise costs more than all that.
    return materialize(assemble(distinct, features, "label", keep=["row_id"]), "noisy")
